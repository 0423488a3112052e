"""Stored collections: exact pruned search, opened folders, and versions that survive a failed write."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswright.operators import inverted, lexical, search
from corpuswright.sources import collections

WORDS = [f"t{i}" for i in range(60)] + ["\U00010F70\U00010F71", "\U0001E4D0x", "Ꟈa", "ß", "İz"]


def corpus(spark, n, seed=1, first=0, words=WORDS):
    rng = random.Random(seed)
    skew = [1 / (i + 1) for i in range(len(words))]
    rows = [(first + i, " ".join(rng.choices(words, skew, k=rng.randrange(0, 40))) if i % 7 else "t0 t1 common", "x") for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, text string, kind string")


def questions(spark, n=25, seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 9)))) for i in range(n)] + [(900, ""), (901, None), (902, "unknown")]
    return spark.createDataFrame(rows, "query_id long, question string")


def rows(df):
    return sorted((r["query_id"], r["chunk_id"], round(r["score"], 6), r["rank"]) for r in df.collect())


@pytest.fixture
def path(spark, tmp_path):
    return str(tmp_path / "collection")


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(inverted, "SHARD_DOCUMENTS", 40)
    monkeypatch.setattr(inverted, "BLOCK", 4)


def test_pruned_search_equals_the_unpruned_one(spark, path, small_parts):
    docs, asked = corpus(spark, 300), questions(spark)
    collections.create(docs, path)
    stored = collections.open_collection(spark, path)
    for k in (1, 3, 10, 400):
        want = rows(lexical.lexical_topk(docs, "chunk_id", "text", asked, "query_id", "question", k, drop_build=0.2, drop_search=0.2))
        assert rows(stored.sparse_topk(asked, "query_id", "question", k)) == want
        for limit in (0, 300, 2000):
            assert rows(stored.sparse_topk(asked, "query_id", "question", k, broadcast_bytes=limit)) == want


def test_one_tokeniser_whatever_the_size(spark, path):
    """Letters newer than some Unicode tables give the same rows by every way."""
    docs = spark.createDataFrame([(1, "\U00010F70 alpha beta"), (2, "\U0001E4D0 alpha Ꟈ"), (3, "beta Ꟈx \U00010F70")],
                                 "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "\U00010F70"), (3, "Ꟈ \U0001E4D0")], "query_id long, question string")
    collections.create(docs, path, drop_ratio=0.0)
    stored = collections.open_collection(spark, path)
    ways = [rows(lexical.lexical_topk(docs, "chunk_id", "text", asked, "query_id", "question", 5, broadcast_bytes=b)) for b in (1 << 26, 0)]
    ways += [rows(stored.sparse_topk(asked, "query_id", "question", 5, broadcast_bytes=b)) for b in (1 << 26, 0)]
    assert all(w == ways[0] for w in ways)


def test_kernel_against_plain_sums():
    rng = np.random.default_rng(4)
    for trial in range(200):
        n, k = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        lists = {}
        for t in range(int(rng.integers(1, 9))):
            places = np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False))
            lists[f"t{t}"] = (places, rng.integers(0 if trial % 3 else 1, 4, len(places)) / 2.0)
        asked = [(t, float(w)) for t, w in zip([*lists, "absent"], rng.integers(0, 5, len(lists) + 1))]
        scores = {}
        for t, w in asked:
            for p, x in zip(*lists.get(t, ((), ()))):
                scores[p] = scores.get(p, 0.0) + w * x
        want = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
        floor = want[-1][1] if len(want) == k and trial % 2 else 0.0
        work, seen = np.zeros(n), np.zeros(n, bool)
        place, score = inverted.best_of_shard(lists, asked, k, floor, work, seen)
        got = list(zip(place.tolist(), score.tolist()))
        assert got[:len(want)] == [(int(p), float(s)) for p, s in want], (trial, got, want)
        assert not work.any() and not seen.any()


def test_blocks_out_of_reach_are_dropped(spark, path, monkeypatch):
    """A token that outweighs the rest of the question needs the blocks of its best documents only."""
    monkeypatch.setattr(inverted, "BLOCK", 4)
    made = [(i, "common " + "strong " * (30 if i < 40 else 1 if i < 400 else 0) + f"x{i % 5} " * 12) for i in range(1200)]
    docs = spark.createDataFrame(made, "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "strong common")], "query_id long, question string")
    collections.create(docs, path, drop_ratio=0.0)
    index = collections.open_collection(spark, path).index
    side = inverted.ask(index, asked, "query_id", "question", 3)
    needs = {r["token"]: r["need"] for r in side.rows.collect()}
    blocks = [r["top"] for r in index.postings.where("token = 'strong'").collect()]
    assert len(blocks) == 100 and sum(top < needs["strong"] for top in blocks) == 90
    want = rows(lexical.lexical_topk(docs, "chunk_id", "text", asked, "query_id", "question", 3))
    assert rows(inverted.index_topk(index, side, 3)) == want


def test_a_search_opens_the_asked_folders_only(spark, path):
    collections.create(corpus(spark, 200), path)
    stored = collections.open_collection(spark, path)
    asked = spark.createDataFrame([(1, "t3 t5")], "query_id long, question string")
    index = stored.index
    side = inverted.ask(index, asked, "query_id", "question", 5)
    assert 1 <= len(side.buckets) <= 2 < index.buckets
    found = inverted.index_topk(index, side, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    opened = [line for line in plan.split("\n") if "FileScan" in line and "places" in line]
    assert opened and all(re.search(r"PartitionFilters: \[.*bucket#\d+ (IN|=)", line) for line in opened), plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    files = inverted.opened(index.postings, side.buckets).select("token", "_metadata.file_path")
    for (file,) in files.select("file_path").distinct().collect():
        assert int(re.search(r"bucket=(\d+)", file).group(1)) in side.buckets


@pytest.mark.parametrize("fails", ["_publish", "_by_bucket", "_store_vectors"])
def test_half_a_write_is_never_seen(spark, path, monkeypatch, fails):
    docs, more, asked = corpus(spark, 80), corpus(spark, 50, 3, first=1000), questions(spark, 5)
    vectors = more.select("chunk_id", F.array(F.rand(1), F.lit(1.0)).cast("array<float>").alias("vector"))
    first = docs.select("chunk_id", F.array(F.lit(0.5), F.lit(1.0)).cast("array<float>").alias("vector"))
    collections.create(docs, path, vectors=first.withColumn("cell", F.lit(0)))
    before = rows(collections.open_collection(spark, path).sparse_topk(asked, "query_id", "question", 5))

    def killed(*args, **options):
        raise InterruptedError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(collections, fails, killed)
        with pytest.raises(InterruptedError):
            collections.append(more, path, vectors=vectors)
    now = collections.open_collection(spark, path)
    assert now.version == 1 and now.documents == 80 and now.texts.count() == 80 and now.vectors.count() == 80
    assert rows(now.sparse_topk(asked, "query_id", "question", 5)) == before
    report = collections.append(more, path, vectors=vectors)  # the batch runs again
    assert (report.version, report.documents, report.vectors) == (2, 50, 50)
    after = collections.open_collection(spark, path)
    assert after.texts.count() == 130 and after.vectors.count() == 130
    assert rows(collections.open_collection(spark, path, 1).sparse_topk(asked, "query_id", "question", 5)) == before


def test_batches_search_as_one(spark, path, small_parts):
    """Two batches give the rows of one, but for the mean length, which the first fixes."""
    same = [f"w{i}" for i in range(30)]
    rng = random.Random(8)
    made = [(i, " ".join(rng.choices(same, k=12))) for i in range(200)]
    docs = spark.createDataFrame(made, "chunk_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(same, k=5))) for i in range(9)], "query_id long, question string")
    collections.create(docs.where("chunk_id < 90"), path)
    report = collections.append(docs.where("chunk_id >= 90").withColumn("text", F.col("text")), path, limits={"text": 10})
    assert (report.documents, report.rejected) == (0, 110)
    collections.append(docs.where("chunk_id >= 90"), path)
    want = rows(lexical.lexical_topk(docs, "chunk_id", "text", asked, "query_id", "question", 7, drop_build=0.2, drop_search=0.2))
    assert rows(collections.open_collection(spark, path).sparse_topk(asked, "query_id", "question", 7)) == want


def test_hybrid_takes_everything_from_the_collection(spark, path):
    docs, asked = corpus(spark, 120), questions(spark, 6)
    rng = np.random.default_rng(2)
    make = lambda name, n: spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(n)], f"{name} long, vector array<float>")
    vectors, wanted = make("chunk_id", 120), make("query_id", 6)
    collections.create(docs, path, vectors=vectors, cells=4)
    stored = collections.open_collection(spark, path)
    pick = lambda df: sorted((r["query_id"], r["chunk_id"], r["rerank_score"], r["rank"]) for r in df.collect())
    want = pick(search.hybrid_search(docs, asked, vectors, wanted, retrieve_k=20, final_k=5))
    assert pick(search.stored_hybrid_search(stored, asked, wanted, retrieve_k=20, final_k=5)) == want
    assert pick(search.stored_hybrid_search(stored, asked, wanted, retrieve_k=20, final_k=5, nprobe=4)) == want
    assert stored.vectors.select("cell").distinct().count() <= 4


def test_empty_collections(spark, path):
    none = corpus(spark, 0) if False else corpus(spark, 1).limit(0)
    collections.create(none, path)
    stored = collections.open_collection(spark, path)
    assert stored.sparse_topk(questions(spark, 3), "query_id", "question", 5).count() == 0
    with pytest.raises(FileNotFoundError):
        collections.open_collection(spark, path + "-absent")


def test_blocks_hold_all_entries_without_a_shuffle(spark, path, small_parts, monkeypatch):
    """Entries are gathered in the task, in parts of any size; blocks and vocabulary equal a plain count."""
    monkeypatch.setattr(inverted, "ENTRIES", 150)
    monkeypatch.setattr(inverted, "TOPS", 3)
    monkeypatch.setattr(inverted, "ROWS_OUT", 9)
    made = corpus(spark, 130, words=WORDS[:60]).collect()
    collections.create(spark.createDataFrame(made, "chunk_id long, text string, kind string"), path)
    stored = collections.open_collection(spark, path)
    numbers = {r["chunk_id"]: (r["shard"], r["place"]) for r in stored.index.documents.collect()}
    mean = sum(len(r["text"].split()) for r in made) / len(made)
    want, found, df, tops = {}, {}, {}, {}
    for r in made:
        words = r["text"].lower().split()
        counted = sorted((words.count(w) * 2.2 / (words.count(w) + 0.3 + 0.9 / mean * len(words)), w) for w in set(words))
        for i, (weight, w) in enumerate(counted):
            df[w] = df.get(w, 0) + 1
            if i >= len(counted) * 2 // 10:
                want[w, numbers[r["chunk_id"]]] = round(weight, 9)
    for b in stored.index.postings.where("top is not null").collect():
        assert 1 <= len(b["places"]) <= 4 and b["top"] == max(b["weights"])
        tops.setdefault(b["token"], []).append(b["top"])
        for place, weight in zip(b["places"], b["weights"]):
            assert (b["token"], (b["shard"], place)) not in found
            found[b["token"], (b["shard"], place)] = round(weight, 9)
    assert found == want
    known = {r["token"]: (r["df"], r["tops"]) for r in stored.index.vocabulary.collect()}
    assert known == {w: (n, sorted(tops.get(w, []), reverse=True)[:3]) for w, n in df.items()}
    placed = stored._table("texts", stored._texts_schema())
    built = inverted.blocks(placed, "text", lexical.CorpusStats(130, mean))
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "HashAggregate" not in plan, plan
