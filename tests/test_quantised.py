"""Codes against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswright.operators import dense, quantised


def frame(spark, name, matrix, ids=None):
    rows = [(i if ids is None else ids[i], [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} bigint, vector array<float>")


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(6)
    docs = rng.normal(size=(900, 16)).astype("float32")
    docs[300:600] = docs[300]  # a third is one vector
    asked = rng.normal(size=(9, 16)).astype("float32")
    asked[0] = docs[300]
    return frame(spark, "chunk_id", docs).repartition(5), frame(spark, "query_id", asked)


def rows(df):
    return sorted((r["query_id"], r["chunk_id"], round(r["score"], 5), r["rank"]) for r in df.collect())


def test_all_candidates_rescored_is_exact(spark, space):
    docs, asked = space
    words = quantised.train_codewords(docs, parts=4, codewords=8)
    coded = quantised.with_codes(docs, words)
    got = quantised.quantised_topk(coded, asked, words, 10, refine=90)
    assert rows(got) == rows(dense.dense_topk(docs, asked, 10))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_recall_and_training_do_not_depend_on_the_partitioning(spark, space):
    docs, asked = space
    words = quantised.train_codewords(docs, parts=8, codewords=64)
    assert np.array_equal(words, quantised.train_codewords(docs.repartition(3), parts=8, codewords=64))
    found = quantised.quantised_topk(quantised.with_codes(docs, words), asked, words, 10)
    measured = quantised.recall(found, dense.dense_topk(docs, asked, 10)).first()
    assert measured["wanted"] == 90 and measured["recall"] >= 0.9


def test_broken_and_missing_vectors(spark, space):
    docs, asked = space
    words = quantised.train_codewords(docs, parts=4, codewords=8)
    odd = docs.limit(2).unionByName(spark.createDataFrame([(5000, None), (5001, [float("nan")] * 16)], "chunk_id long, vector array<float>"))
    assert quantised.with_codes(odd, words).count() == 2
    assert quantised.quantised_topk(quantised.with_codes(docs, words), asked.limit(0), words, 3).count() == 0
    with pytest.raises(ValueError):
        quantised.train_codewords(docs, parts=7)
