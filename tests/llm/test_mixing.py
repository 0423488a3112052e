"""Mixing to targets: quotas against a plain seat-by-seat count, plans against their rules."""

import heapq
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from corpuswright.llm import mixing


def seat_by_seat(weights, seats):
    out, heap = [0] * len(weights), [(-float(w), i) for i, w in enumerate(weights) if w > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i = heapq.heappop(heap)
        out[i] += 1
        heapq.heappush(heap, (-(weights[i] / (2 * out[i] + 1)), i))
    return out


def filled(sizes, repeats=3):
    """Targets by freezing one source after the other."""
    frozen, total = set(), sum(sizes)
    weights = [i % 3 + 1 for i in range(len(sizes))]
    while True:
        free = [i for i in range(len(sizes)) if i not in frozen]
        left = total - sum(repeats * sizes[i] for i in frozen)
        share = {i: Fraction(weights[i] * left, sum(weights[j] for j in free)) for i in free}
        over = {i for i in free if share[i] > repeats * sizes[i]}
        if not over:
            return [float(repeats * s) if i in frozen else float(share[i]) for i, s in enumerate(sizes)]
        frozen |= over


def test_highest_quotients():
    rng = np.random.default_rng(3)
    cases = [[5, 5, 5], [1, 0, 1], [1000] + [1] * 30, [0, 0], []] + [list(rng.integers(0, 99, 12)) for _ in range(30)]
    for weights in cases:
        for seats in (0, 1, 2, 7, 50, 201):
            assert list(mixing.highest_quotients(np.array(weights, float), seats)) == seat_by_seat(weights, seats), (weights, seats)


def rows(spark, sizes, per_doc=7):
    """One source per size, its words over documents of at most ``per_doc`` words."""
    out, doc = [], 0
    for i, n in enumerate(sizes):
        while n > 0:
            k = min(per_doc, n)
            out.append((doc, " ".join(f"w{doc}.{j}" for j in range(k)), f"s{i:03d}"))
            n, doc = n - k, doc + 1
    return spark.createDataFrame(out, "doc_id long, text string, source string")


def test_targets_quotas_and_places(spark):
    sizes = [3, 4000, 50, 2, 900, 7, 1, 2600, 33]  # several reach their limit in several rounds
    planned = mixing.plan(rows(spark, sizes), shard=64).collect()
    want = filled(sizes)
    taken = defaultdict(int)
    for r in planned:
        i = int(r["source"][1:])
        assert r["source_size"] == sizes[i] and abs(r["target"] - want[i]) < 1e-9 * want[i]
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == sum((p["end"] - p["start"]) * p["times"] for p in r["pieces"])
        assert all(0 <= p["start"] < p["end"] <= r["size"] for p in r["pieces"])
        taken[i] += r["taken"]
    for i, target in enumerate(want):
        assert abs(taken[i] - target) <= 1, (i, taken[i], target)


def test_quotas_over_sources(spark):
    targets = [5.0, 0.0, 17.0, 17.0, 300.5, 2.25]
    frame = spark.createDataFrame(list(enumerate(targets, 1)), "i long, target double")
    for seats in (0, 1, 3, 40, 1000):
        got = {r["i"]: r["quota"] for r in mixing.quotas(frame, seats).collect()}
        assert [got[i] for i in range(1, 7)] == seat_by_seat(targets, seats)


def test_mix_holds_the_planned_words(spark):
    docs = rows(spark, [40, 300, 9])
    said = Counter(w for r in mixing.mixed(docs).collect() for w in r["text"].split(" "))
    planned = mixing.plan(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    want = Counter()
    for r in planned:
        listed = r["text"].split(" ")
        for p in r["pieces"]:
            for w in listed[p["start"]:p["end"]]:
                want[w] += p["times"]
    assert said == want and max(said.values()) <= 3


def test_odd_rows(spark, docs, nothing):
    first = sorted(map(str, mixing.plan(docs).drop("place").collect()))
    again = sorted(map(str, mixing.plan(docs.repartition(7)).drop("place").collect()))
    assert first == again and len(first) == docs.count()
    by_id = {(r["doc_id"], r["size"]): r for r in mixing.plan(docs).collect()}
    assert by_id[1, 0]["taken"] == 0 and by_id[1, 0]["pieces"] == []
    order = {r["source"]: r["target"] / r["source_size"] for r in mixing.plan(docs).collect()}
    assert set(order) == {"r", "s", None}
    assert mixing.plan(nothing).count() == 0
    assert mixing.plan(docs.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0] == 0


def test_weights_go_by_code_point_with_null_last(spark):
    text = " ".join(["w"] * 600)
    frame = spark.createDataFrame([(1, text, None), (2, text, "\U0001F600"), (3, text, "�"), (4, text, "")],
                                  "doc_id long, text string, source string")
    got = {r["source"]: r["target"] for r in mixing.plan(frame).collect()}
    assert got[""] < got["�"] < got["\U0001F600"] and got[None] == got[""]
