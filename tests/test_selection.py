"""The first n rows by rounds of histograms, against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from corpuswright.operators import ordinals, sampling, selection


@pytest.fixture
def narrow(monkeypatch):
    """Many rounds on few rows."""
    monkeypatch.setattr(selection, "RANGES", 4)
    monkeypatch.setattr(selection, "FEW", 5)


def made(spark, seed=1, n=400):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", None, "c" * 3]), rng.randrange(6)) for i in range(n)]
    rows += [(1000, "same", 3)] * 150 + [(1001 + i, "b", 2) for i in range(100)]  # equal rows, equal keys
    return rows, spark.createDataFrame(rows, "id long, word string, number int")


@pytest.mark.parametrize("n", [0, 1, 7, 150, 333, 500, 649, 650, 651, 5000])
def test_first_n_of_unique_keys(spark, narrow, n):
    rows, frame = made(spark)
    got = selection.first_n(frame, n, [F.col("number"), F.col("id")]).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, sorted(rows, key=lambda r: (r[2], r[0]))[:n]))


@pytest.mark.parametrize("n", [3, 260, 400, 648])
def test_ties_take_the_same_rows_again(spark, narrow, n):
    rows, frame = made(spark)
    once = [sorted(map(str, selection.first_n(frame.repartition(p), n, [F.col("word")]).collect())) for p in (1, 7)]
    assert once[0] == once[1] and len(once[0]) == n
    words = sorted((r[1] or "" for r in rows))[:n]
    assert sorted(r["word"] or "" for r in selection.first_n(frame, n, [F.col("word")]).collect()) == words


def test_nothing_is_sorted_into_one_task(spark):
    found = sampling.head_sample(spark.range(20000).withColumn("x", F.rand(3)), 9000, ["x"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan and "Limit" not in plan
    assert found.count() == 9000


def test_all_rows_equal(spark, narrow):
    frame = spark.range(300).select(F.lit("x").alias("w"))
    assert selection.first_n(frame, 120, [F.col("w")]).count() == 120


def test_ordinals_of_few_rows_need_no_join(spark):
    numbered = ordinals.with_ordinal(spark.range(9), "n", [-F.col("id")])
    assert "Join" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r["n"]) for r in numbered.collect()) == [(i, 9 - i) for i in range(9)]
    sums = ordinals.with_running_sums(spark.range(9), {"s": F.col("id")}, [F.col("id")], [F.col("id") % 2])
    assert {r["id"]: r["s"] for r in sums.collect()} == {i: sum(range(i % 2, i + 1, 2)) for i in range(9)}
