"""The prefix trie against rebuilt texts, with long and hot conversations over many ranges."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswright.llm import prefix_trie as trie


def brute(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    said = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    nodes = defaultdict(list)
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        path = said.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + said[c][h:]
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append((c, d == len(path)))
    out = {}
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)
    for path in sorted(nodes, key=len, reverse=True):
        members = sorted(c for c, _ in nodes[path])
        below = [out[p] for p in children[path]]
        saved = (len(members) - 1) * (len(path[-1][1].encode()) if path else 0) + sum(b[6] for b in below)
        ends = hashlib.sha256(",".join(str(c) for c in sorted(c for c, e in nodes[path] if e)).encode()).hexdigest()
        up = min(c for c, _ in nodes[path[:-1]]) if path else None
        out[path] = (members[0], len(path), up, len(members), len(below), sum(b[5] for b in below) or 1, saved, ends)
    return sorted(out.values(), key=str)


def run(rows, spark):
    frame = rows if not isinstance(rows, list) else spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = trie.prefix_trie(frame).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                         "saved_tokens", "ends_sha256")
    return sorted(map(tuple, got.collect()), key=str)


def made(seed=4):
    rng = np.random.default_rng(seed)
    texts = ["", "a", "é漢", "hello", "b" * 900, None]
    rows = [(c, t if t else None, ["user", "assistant", None][t % 3], texts[int(rng.integers(0, 6))])
            for c in [*range(60), -7, -5, 1005, 1007] for t in range(int(rng.integers(1, 14)))]
    rows += [(c, t, "user", "same") for c in range(100, 400) for t in range(3)]  # a hot first turn, equal conversations
    rows += [(c, t, "user", f"t{t % 50}") for c in (500, 501, 502) for t in range(700)]  # long ones that share their heads
    return rows + [(None, 1, "user", "x"), (None, None, None, None)]


def test_equals_rebuilt_texts(spark):
    rows = made()
    assert run(rows, spark) == brute(rows)


def test_long_conversation_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(trie, "MEMBERS", 2)  # several listed runs a node
    rows = made(9) + [(c, t, "user", f"u{t % 7}") for c in (777, 778) for t in range(2500)]
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "37", "spark.sql.shuffle.partitions": "13",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert run(rows, spark) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_fingerprints_that_meet_start_again(spark, monkeypatch):
    """With a modulus of 5 different prefixes meet: the check must see it."""
    seeds = []
    real = trie._sound
    monkeypatch.setattr(trie, "_sound", lambda n, c, s: seeds.append(real(n, c, s)) or seeds[-1])
    monkeypatch.setattr(trie, "bases", lambda seed: (0, 0) if seed == 1 else (12345, 67891))
    rows = [(c, t, "user", f"{c % 4}{t}") for c in range(12) for t in range(3)]
    assert run(rows, spark) == brute(rows)
    assert seeds == [False, True]


@pytest.mark.parametrize("n", [1, 5, 70000])
def test_monoid(n):
    rng = np.random.default_rng(n)
    a, b = (rng.integers(0, trie.PRIME, n, dtype=np.uint64) for _ in range(2))
    assert [int(x) for x in trie.product(a, b)][:500] == [int(x) * int(y) % trie.PRIME for x, y in zip(a, b)][:500]
    assert [int(x) for x in trie.difference(a, b)][:500] == [(int(x) - int(y)) % trie.PRIME for x, y in zip(a, b)][:500]
    assert int(trie.Powers(12345).at(np.array([n]))[0]) == pow(12345, n, trie.PRIME)
    sums = trie.running(a, np.array([0, n // 2]) if n > 1 else np.array([0]))
    assert int(sums[-1]) == sum(int(x) for x in a[n // 2 if n > 1 else 0:]) % trie.PRIME


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert run(empty, spark) == []
    frame = spark.createDataFrame([(5, 1, None, None)], "conv_id long, turn long, role string, text string")
    for name in ("depth", "f1", "part", "pos", "h", "base"):
        frame = frame.withColumn(name, F.lit(1))
    assert run(frame, spark) == brute([(5, 1, None, None)])
