"""Source divergence against plain counting."""

import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from corpuswright.llm import divergence

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, k):
    counts, held, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        sources[lang].add(source)
        counts[lang, source].update(found)
        held[lang].update(set(found))
    out = []
    for lang, names in sources.items():
        kept = sorted(t for t, n in held[lang].items() if n >= min_docs)
        total = Counter()
        for s in names:
            total.update({t: counts[lang, s][t] for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(counts[lang, s]) for s in names}, share(total)
        for s in names:
            parts = {"pair": [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in names if o != s],
                     "term": [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                for rank, (value, _, item) in enumerate(sorted(items), 1):
                    if part == "pair" or rank <= k:
                        out.append((lang, s, part, item, -value, rank))
    return sorted(out)


def made(spark):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a, b in product(["Wort", "élan", "漢", "x", "\U0001F600", "�z"], "ABCDEFGHIJKLMNOPQRSTU".lower())]
    rows = []
    for lang, source in product(["de", "fr", None], ["a", "b", "é", "\U0001F600", "�", None]):
        for _ in range(int(rng.integers(1, 30))):
            some = rng.choice(words, int(rng.integers(0, 60)), p=(lambda w: w / w.sum())(rng.random(len(words)) ** 4))
            rows.append((" 1-".join(some), lang, source))
    rows += [(None, "only", "one"), ("", "two", "a"), ("Q", "two", "b"), (" ".join(words) * 300, "de", "a")] + [("x y", "de", "a")] * 40
    return rows, spark.createDataFrame(rows, "text string, lang string, source string").withColumn("n", F.lit(1)).withColumn("p", F.lit(2))


def test_equals_plain_counting(spark, monkeypatch):
    rows, frame = made(spark)
    for k, min_docs in ((50, 30), (3, 2), (1, 1)):
        got = sorted(map(tuple, divergence.audit(frame.repartition(5), min_docs=min_docs, k=k).collect()))
        assert got == brute(rows, min_docs, k)


def test_tiles_and_blocks(spark, monkeypatch):
    rows, frame = made(spark)
    for name, value in (("TILE", 2), ("BLOCK", 7), ("STEP", 50), ("PENDING", 3)):
        monkeypatch.setattr(divergence, name, value)
    assert sorted(map(tuple, divergence.audit(frame, min_docs=2).collect())) == brute(rows, 2, 50)


def test_skyband_is_what_fewer_than_k_dominate():
    rng = np.random.default_rng(8)
    for n, k in ((0, 2), (1, 1), (700, 1), (1500, 5)):
        group, lang = rng.integers(0, 30, n), rng.integers(0, 30, n)
        terms = [f"{x:06d}" for x in rng.permutation(n)]
        want = [sum(group[a] >= group[b] and lang[a] <= lang[b] and terms[a] < terms[b] for a in range(n)) < k
                for b in range(n)] if n < 1000 else None
        got = divergence.undominated(group, lang, pa.array(terms, pa.string()), k)
        if want is None:
            t = np.array(terms).astype(int)
            want = list(((group[:, None] >= group) & (lang[:, None] <= lang) & (t[:, None] < t)).sum(axis=0) < k)
        assert list(got) == want


def test_odd_rows(spark, docs, nothing):
    assert divergence.audit(nothing).count() == 0
    got = divergence.audit(docs, min_docs=1).collect()
    want = brute([(r["text"], r["lang"], r["source"]) for r in docs.collect()], 1, 50)
    assert sorted(map(tuple, got)) == want


def test_a_task_counts_many_terms_in_bounded_memory():
    """Texts of ever new terms: what waits in a task stays small, and no count is lost."""
    rows = 160
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"] * rows, "source": [f"s{i % 5}" for i in range(rows)],
                                           "text": [" ".join(f"{a}q{_letters(b * rows * 600 + i * 600 + j)}" for j, a in enumerate(["x", "y", "z"] * 200))
                                                    for i in range(rows)]}) for b in range(24)]
    usual = pa.default_memory_pool()
    pool = pa.proxy_memory_pool(usual)
    pa.set_memory_pool(pool)
    try:
        total = sum(pc.sum(out.column("n")).as_py() for out in divergence._count(iter(batches)))
    finally:
        pa.set_memory_pool(usual)
    assert total == 24 * rows * 600
    assert pool.max_memory() < 48 << 20, pool.max_memory()


def _letters(n: int) -> str:
    return "".join(chr(97 + int(d)) for d in str(n))
