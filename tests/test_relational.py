"""Joins, ordinals, splits, budgets and reports on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from corpuswright.functions import routes as R
from corpuswright.operators import datasets, evaluation, filters, joins, media, ordinals, reports, routing, sampling


@pytest.fixture(params=[0, 1 << 20], ids=["ranges", "windows"])
def both_ways(request, monkeypatch):
    monkeypatch.setattr(ordinals, "WINDOW_ROWS", request.param)


def test_ordinals_with_a_hot_group(spark, both_ways):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.randrange(40), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(6)
    got = {(r["i"]): r["n"] for r in ordinals.with_ordinal(df, "n", [F.col("v"), F.col("i")], [F.col("g")]).collect()}
    expected, seen = {}, {}
    for g, v, i in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[g] = seen.get(g, 0) + 1
        expected[i] = seen[g]
    assert got == expected


def test_ordinals_with_nulls_and_strings(spark, both_ways):
    df = spark.createDataFrame([(None, "b"), ("x", "a"), (None, "a"), ("é", None)], "g string, s string")
    got = ordinals.with_ordinal(df, "n", [F.col("s")], [F.col("g")]).collect()
    assert {(r["g"], r["s"], r["n"]) for r in got} == {(None, "a", 1), (None, "b", 2), ("x", "a", 1), ("é", None, 1)}
    assert ordinals.with_ordinal(df.limit(0), "n", [F.col("s")]).count() == 0


def test_running_sums(spark, both_ways):
    df = spark.range(1, 501).withColumn("v", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id"))).repartition(5)
    got = {r["id"]: r["s"] for r in ordinals.with_running_sums(df, {"s": F.col("v")}, [F.col("id")]).collect()}
    total, expected = 0, {}
    for i in range(1, 501):
        total += 0 if i % 5 == 0 else i
        expected[i] = total
    assert got == expected


def test_rejoin_takes_the_last_duplicate(spark):
    rows = spark.createDataFrame([(" q1 ", "old"), ("q2", "old"), ("q3", "old")], "question string, ground_truth string")
    verified = spark.createDataFrame([(1, "q1", "first"), (2, "q1 ", " last "), (3, "q2", " "), (4, " ", "x")],
                                     "ordinal int, question string, ground_truth string")
    got = {r["question"]: (r["ground_truth"], r["matched"]) for r in joins.rejoin_ground_truth(rows, verified).collect()}
    assert got == {" q1 ": ("last", True), "q2": ("old", False), "q3": ("old", False)}


@pytest.mark.parametrize("n, two_stage, sizes", [(9, False, (7, 0, 2)), (147, False, (117, 14, 16)), (9, True, (7, 1, 1)), (10, True, (8, 1, 1)), (1, False, (0, 0, 1))])
def test_plain_split(spark, n, two_stage, sizes):
    got = sampling.plain_split(spark.range(n), [F.col("id")], two_stage=two_stage).groupBy("split").count().collect()
    counts = {r["split"]: r["count"] for r in got}
    assert tuple(counts.get(s, 0) for s in ("train", "val", "test")) == sizes


def test_stratified_split_is_disjoint_and_stable(spark):
    df = spark.range(101).withColumn("label", F.when(F.col("id") == 7, "rare").when(F.col("id") % 3 == 0, "a").otherwise("b"))
    order = [sampling.shuffle_key("id", 42), F.col("id")]
    first = {r["id"]: r["split"] for r in sampling.stratified_split(df, "label", order).collect()}
    again = {r["id"]: r["split"] for r in sampling.stratified_split(df.repartition(7), "label", order).collect()}
    assert first == again and len(first) == 101
    train = {i for i, s in first.items() if s == "train"}
    assert train.isdisjoint({i for i, s in first.items() if s == "test"})
    assert first[7] == "test"
    assert sum(1 for i in train if i % 3 == 0) == int(34 * 0.8)


def test_balance_routes(spark):
    rows = [(i, f"q{i}?", "VISION" if i < 2 else "TEXT" if i < 10 else "REJECT") for i in range(11)]
    df = spark.createDataFrame(rows, "id int, question string, route string")
    build = lambda d: datasets.balance_routes(d, question="question", route="route", order=[F.col("id")], pick=F.col("id"), cues=["See: "])
    got = {r["id"]: (r["question"], r["route"]) for r in build(df).collect()}
    assert len(got) == 10 and sum(r == "VISION" for _, r in got.values()) == 11 // 2
    assert got[0] == ("See: q0?", "VISION") and got[4] == ("See: q4?", "VISION") and got[5] == ("q5?", "TEXT")
    mostly_vision = df.withColumn("route", F.when(F.col("id") < 8, "VISION").otherwise("TEXT"))
    assert build(mostly_vision).filter("route = 'TEXT'").count() == 3


def test_sample_to_target_restarts(spark):
    drawn = sampling.sample_to_target(spark.range(10), 25, "id", []).collect()
    assert len(drawn) == 25
    assert sorted(r["id"] for r in drawn if r["draw"] == 0) == list(range(10))
    assert sorted(r["id"] for r in drawn if r["draw"] == 1) == list(range(10))
    assert sampling.sample_to_target(spark.range(0), 5, "id", []).count() == 0


def test_media_budget(spark):
    hits = spark.createDataFrame([(1, 1, "d1", 0), (1, 2, "unknown", 3), (1, 3, "d2", 5), (1, 4, "d1", 1)],
                                 "query_id int, rank int, doc_id string, page_num int")
    files = spark.createDataFrame([("d1", "a.pdf"), ("d1", "b.png"), ("d1", "c.hwp"), ("d2", "z.PDF"), ("unknown", "u.png")]
                                  + [("d2", f"img{i}.jpg") for i in range(9)], "doc_id string, path string")
    got = [(r["doc_id"], r["path"], r["page"]) for r in media.media_budget(hits, files, cap=10).orderBy("slot").collect()]
    assert got[:3] == [("d1", "b.png", 0), ("d1", "a.pdf", 1), ("d1", "a.pdf", 2)]
    assert len(got) == 10 and got[3:] == [("d2", f"img{i}.jpg", 0) for i in range(7)]
    counted = files.withColumn("page_count", F.when(F.col("path") == "a.pdf", 1))
    assert ("d1", "a.pdf", 2) not in [(r["doc_id"], r["path"], r["page"]) for r in media.media_budget(hits, counted, cap=10).collect()]


def test_media_budget_docs(spark):
    rows = [(1, i + 1, f"rules/{d}.md", p) for i, (d, p) in enumerate([("a", 1), ("a", 1), ("a", 2), ("b", 3), ("c", 4), ("d", 5), ("b", 9)])]
    rows += [(1, 8, "[공지사항-일반] 77", 1), (1, 9, "no target", 1), (1, 10, "[web] 12", 1)]
    hits = spark.createDataFrame(rows, "query_id int, rank int, source string, page_num int")
    separate = {(r["target"], r["page"]) for r in media.media_budget_docs(hits, 3, 2, combined=False).collect()}
    assert separate == {("a.pdf", 1), ("a.pdf", 2), ("b.pdf", 3), ("c.pdf", 4), ("77", None)}
    together = {(r["target"], r["page"]) for r in media.media_budget_docs(hits, 3, 2, combined=True).collect()}
    assert together == {("a.pdf", 1), ("a.pdf", 2), ("b.pdf", 3), ("b.pdf", 9), ("c.pdf", 4)}


def test_confusion_counts_unknown_as_the_other_class(spark):
    pairs = [("TEXT", "TEXT"), ("TEXT", "UNKNOWN"), ("VISION", "UNKNOWN"), ("VISION", "VISION"), ("VISION", None)]
    df = spark.createDataFrame(pairs, "a string, p string")
    matrix = reports.confusion_matrix(df, "a", "p")
    assert {r["actual"]: (r["pred_text"], r["pred_vision"]) for r in matrix.collect()} == {"TEXT": (1, 1), "VISION": (2, 1)}
    row = reports.accuracy_by_class(matrix).first()
    assert (row["samples"], row["accuracy"], row["text_accuracy"]) == (5, 40.0, 50.0)
    assert reports.accuracy_by_class(reports.confusion_matrix(df.limit(0), "a", "p")).first()["accuracy"] == 0.0


def test_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([("TEXT", "TEXT"), ("VISION", "TEXT")], "a string, p string")
    got = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in reports.classification_report(df, "a", "p").collect()}
    assert got["VISION"] == (0.0, 0.0, 0.0, 1) and got["TEXT"] == (0.5, 1.0, 0.666667, 1)
    assert got["macro avg"][3] == 2


def test_metric_means_skip_nan(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "m double")
    row = reports.metric_means(df, ["m", "absent"]).first()
    assert (row["m"], row["absent"]) == (2.0, 0.0)
    assert filters.drop_unscored(df, ["m"]).count() == 2


def test_doc_path_lookup_forms(spark):
    entries = spark.createDataFrame([("1", '["a.pdf", 3]'), ("2", '{"path": "b.pdf", "page_num": 2}'), ("3", "c.png"), ("4", '{"page_num": 7}')],
                                    "doc_id string, e string")
    stored = entries.select("doc_id", joins.parse_path_entry(F.col("e")).alias("p")).select("doc_id", "p.*")
    got = {r["doc_id"]: (r["path"], r["page_num"]) for r in joins.doc_path_lookup(spark.createDataFrame([(str(i),) for i in range(1, 6)], "doc_id string"), stored).collect()}
    assert got == {"1": ("a.pdf", 3), "2": ("b.pdf", 2), "3": ("c.png", None), "4": ("unknown", 7), "5": (None, None)}


def test_bounded_retry_runs_twice_at_most(spark):
    asked = spark.createDataFrame([(1, .9), (2, .8), (3, .5), (4, None)], "query_id int, first double")
    calls = []

    def run(rows, number):
        calls.append((number, rows.count()))
        return rows.withColumn("score", F.col("first") if number == 1 else F.lit(.5))

    got = {r["query_id"]: (r["score"], r["retry_count"]) for r in routing.bounded_retry(asked, run).collect()}
    assert got == {1: (.9, 1), 2: (.8, 1), 3: (.5, 2), 4: (.5, 2)}
    assert calls == [(1, 4), (2, 2)]


def test_read_score(spark):
    df = spark.createDataFrame([(" 0.8\n",), ("score 1",), (None,)], "raw string")
    assert [r[0] for r in df.select(routing.read_score(F.col("raw"))).collect()] == [0.8, 0.5, 0.5]


def test_judge_rejects_missing_truth(spark):
    df = spark.createDataFrame([("a b", "x", "a b"), ("x", "a b", "a b"), ("x", "y", "a b"), ("", "", ""), ("a", "a", None)],
                               "t string, v string, g string")
    got = [r[0] for r in df.select(routing.judge_route(F.col("t"), F.col("v"), F.col("g"))).collect()]
    assert got == ["TEXT", "VISION", "REJECT", "REJECT", "REJECT"]
    assert spark.range(1).select(routing.known_route(F.lit(" vision "))).first()[0] == R.VISION
    assert spark.range(1).select(routing.known_route(F.lit("maybe"))).first()[0] == R.REJECT


def test_join_chunks_in_blocks(spark):
    pieces = [("s", i, f"{i},") for i in range(700)] + [("e", 0, "x"), ("e", 1, "[end]"), ("e", 2, "y")]
    df = spark.createDataFrame(pieces, "s string, n int, t string").repartition(4)
    got = {r["s"]: r["answer"] for r in evaluation.join_chunks(df, "s", "n", "t", end=F.col("t") == "[end]", per_block=64).collect()}
    assert got == {"s": "".join(f"{i}," for i in range(700)), "e": "x"}


def test_date_cutoff(spark):
    df = spark.createDataFrame([(1, "2023-12-31", False), (2, "2024-01-01", False), (3, "2020-01-01", True), (4, None, None)],
                               "id int, d string, pinned boolean")
    kept = df.filter(filters.on_or_after(F.col("d").cast("date"), F.lit("2024-01-01").cast("date"), F.col("pinned")))
    assert sorted(r["id"] for r in kept.collect()) == [2, 3]


def test_length_limits_count_bytes(spark):
    df = spark.createDataFrame([("a" * 20, "x"), ("é" * 11, "x"), (None, "x")], "year string, category string")
    got = filters.length_violations(df, {"year": 20, "category": 500}).collect()
    assert [(r["year"], r["offending"]) for r in got] == [("é" * 11, ["year"])]
