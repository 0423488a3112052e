"""How the sources of a language differ: pairwise distances of term shares, and the terms each source overuses.

The terms a source overuses are found without ranking all of them. A term that
stands more often in the group, less often in the language and earlier in UTF-8
than another one comes before it whatever the totals are; a term that ``k``
others precede so is out. Partitions keep the terms fewer than ``k`` others
dominate (their skyband), skybands are merged and cut again, and only what is
left is ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import join_side, stored

BETWEEN_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # all of ASCII but letters
SCALE = 1_000_000_000
SMOOTHING = 5
STEP = 1 << 22  # bytes of text counted together; a longer text comes alone and whole
WAITING = 1 << 18  # counts a task merges before it hands them on; with STEP, what bounds its memory
TILE = 256  # sources of a tile, on average
BLOCK = 2048  # terms of a block, on average
SALTS = 32
PENDING = 2048  # terms of a group that wait before its skyband is cut again


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STEP, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group, added up over the task's texts."""
    waiting: list[pa.Table] = []

    def merged() -> pa.Table:
        summed = pa.concat_tables(waiting).group_by(["lang", "source", "term"], use_threads=False).aggregate(
            [("n", "sum"), ("docs", "sum")])
        return summed.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])

    for rows in _counted(batches):
        waiting.append(pa.Table.from_batches([rows]))
        if sum(map(len, waiting)) > 2 * WAITING:
            waiting = [merged()]
            if len(waiting[0]) > WAITING:
                yield from waiting.pop().to_batches()
    if waiting:
        yield from merged().to_batches()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _steps(batch):
            lists = pc.split_pattern_regex(pc.ascii_lower(part.column("text")), BETWEEN_TERMS)
            flat = lists.flatten()
            doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            real = pc.not_equal(flat, "")
            doc = doc[real.to_numpy(zero_copy_only=False)]
            if not len(doc):
                continue
            encoded = flat.filter(real).dictionary_encode()
            term, size = encoded.indices.to_numpy().astype(np.int64), len(encoded.dictionary)
            langs, sources = (part.column(c).dictionary_encode() for c in ("lang", "source"))
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            key, n = np.unique(group[doc] * size + term, return_counts=True)
            once = np.sort(doc * size + term)
            once = once[np.r_[True, once[1:] != once[:-1]]]  # a document counts once
            held = np.unique(group[once // size] * size + once % size, return_counts=True)[1]
            place = key // size
            yield pa.RecordBatch.from_arrays([
                langs.dictionary.take(pa.array(place // len(sources.dictionary))),
                sources.dictionary.take(pa.array(place % len(sources.dictionary))),
                encoded.dictionary.take(pa.array(key % size)), pa.array(n.astype(np.int64)), pa.array(held.astype(np.int64)),
            ], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term in each group and the documents that hold it.

    Terms are runs of ASCII letters and characters beyond ASCII, only A-Z
    lower-cased; null text, lang and source count as empty.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = plain.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> Column:
    """``1 + floor(SCALE * (count + 5) / (total + 5 * terms))``, exact in decimals."""
    return F.expr(f"1 + (cast({SCALE} as decimal(19,0)) * (cast({count} as decimal(18,0)) + {SMOOTHING}))"
                  f" div (cast({total} as decimal(20,0)) + {SMOOTHING} * cast({terms} as decimal(18,0)))")


# --- the overused terms ---

def undominated(group: np.ndarray, lang: np.ndarray, terms: pa.Array, k: int) -> np.ndarray:
    """Which rows fewer than ``k`` others dominate by ``group`` at least as high, ``lang`` at
    least as low and a term earlier in UTF-8; equal terms never dominate one another."""
    place = np.empty(len(terms), np.int64)
    place[pc.sort_indices(terms.cast(pa.binary())).to_numpy()] = np.arange(len(terms))
    order = np.lexsort((place, lang, -group))  # whatever dominates a row stands before it
    g, l, t = group[order], lang[order], place[order]
    held = [np.zeros(0, np.int64)]  # places of the rows kept so far: they alone decide
    keep = np.zeros(len(order), bool)
    for a in range(0, len(order), 512):
        b = min(a + 512, len(order))
        before = np.r_[np.concatenate(held), np.arange(a, b)]
        beaten = ((g[before, None] >= g[None, a:b]) & (l[before, None] <= l[None, a:b]) & (t[before, None] < t[None, a:b])).sum(axis=0)
        keep[a:b] = beaten < k
        held.append(a + np.flatnonzero(keep[a:b]))
    out = np.zeros(len(order), bool)
    out[order] = keep
    return out


def _skyband(k: int):
    """Cuts each group of a sorted partition to its skyband; the state is one group's skyband and some rows that wait."""
    def cut(table: pa.Table) -> pa.Table:
        flags = undominated(table.column("n").to_numpy(), table.column("lang_n").to_numpy(),
                            table.column("term").combine_chunks(), k)
        return table.filter(pa.array(flags))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, limit = None, [], PENDING
        for batch in batches:
            table = pa.Table.from_batches([batch])
            langs, sources = table.column("lang").combine_chunks(), table.column("source").combine_chunks()
            if not batch.num_rows:
                continue
            new = pc.or_(pc.not_equal(langs[1:], langs[:-1]), pc.not_equal(sources[1:], sources[:-1]))
            edges = np.r_[0, np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1, batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                here = (langs[int(a)].as_py(), sources[int(a)].as_py())
                if here != name:
                    if state:
                        yield from cut(pa.concat_tables(state)).to_batches()
                    name, state, limit = here, [], PENDING
                state.append(table.slice(int(a), int(b - a)))
                if sum(map(len, state)) > limit:
                    state = [cut(pa.concat_tables(state))]
                    limit = 2 * len(state[0]) + PENDING
        if state:
            yield from cut(pa.concat_tables(state)).to_batches()

    return run


def skyband(counts: DataFrame, k: int) -> DataFrame:
    """The rows ``lang, source, term, n, lang_n`` fewer than ``k`` others of their group dominate.

    Three levels: each partition for itself, then each group in ``SALTS`` parts,
    then each group. A group's rows pass a task as a sorted stream.
    """
    out = counts.select("lang", "source", "term", "n", "lang_n")
    levels = ([], ["lang", "source", F.pmod(F.xxhash64("term"), F.lit(SALTS))], ["lang", "source"])
    for keys in levels:
        dealt = out.repartition(*keys) if keys else out
        out = dealt.sortWithinPartitions("lang", "source").mapInArrow(_skyband(k), out.schema)
    return out


# --- the distances of sources ---

def _distances(table: pa.Table) -> pa.Table:
    """Partial distances of the sources of two tiles over one block of terms.

    A source without a term has its floor there. Terms the block does not show
    differ by the floors alone, which block 0 adds for all terms at once.
    """
    floors = dict(zip(table.column("source").to_pylist(), table.column("floor").to_pylist()))
    tiles = dict(zip(table.column("source").to_pylist(), table.column("tile").to_pylist()))
    names = sorted(floors, key=str.encode)
    number = {s: i for i, s in enumerate(names)}
    floor = np.array([floors[s] for s in names], np.int64)
    real = table.filter(pc.is_valid(table.column("term")))
    terms = real.column("term").combine_chunks().dictionary_encode()
    shares = np.repeat(floor[:, None], len(terms.dictionary), axis=1)
    shares[[number[s] for s in real.column("source").to_pylist()], terms.indices.to_numpy()] = real.column("p").to_numpy()
    tile = np.array([tiles[s] for s in names])
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    total = table.column("terms")[0].as_py() if table.column("block")[0].as_py() == 0 else 0
    first, second, value = [], [], []
    for i in range(len(names) - 1):
        rest = np.arange(i + 1, len(names))
        if low != high:
            rest = rest[tile[rest] != tile[i]]
        if len(rest):
            gap = np.abs(floor[rest] - floor[i])
            sums = np.abs(shares[rest] - shares[i]).sum(axis=1) + gap * (total - len(terms.dictionary))
            first += [names[i]] * len(rest)
            second += [names[j] for j in rest]
            value.append(sums)
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(first), pa.string()),
                     "a": pa.array(first, pa.string()), "b": pa.array(second, pa.string()),
                     "value": pa.array(np.concatenate(value) if value else [], pa.int64())})


def distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every ordered pair of sources of a language.

    Terms are dealt into blocks and sources into tiles; a task holds one block
    for two tiles as a dense table and returns one number a pair of sources.
    """
    tiled = (groups.withColumn("tiles", F.ceil(F.col("sources") / TILE).cast("int"))
             .withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
             .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / BLOCK)).cast("int"))
             .withColumn("floor", F.when(F.col("terms") > 0, share("0", "total", "terms")).otherwise(0)))
    side = tiled.select("lang", "source", "tiles", "tile", "blocks", "floor", "total", "terms")
    told = (counts.select("lang", "source", "term", "n").join(join_side(side), ["lang", "source"])
            .withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
            .withColumn("p", share("n", "total", "terms")))
    plain = side.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"term": F.lit(None).cast("string"), "p": F.col("floor")})
    names = ["lang", "source", "term", "p", "floor", "tile", "tiles", "block", "terms"]
    rows = (told.select(*names).unionByName(plain.select(*names))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("other", "tiles"))
    parts = rows.groupBy("lang", "low", "high", "block").applyInArrow(
        _distances, "lang string, a string, b string, value bigint")
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return summed.select("lang", both.alias("e"), "value").select("lang", "e.source", "e.item", "value")


def audit(docs: DataFrame, *, min_docs: int = 30, k: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every group (lang, source) of ``docs(text, lang, source)``.

    Each language keeps the terms at least ``min_docs`` of its documents hold;
    each group and language gives a kept term an exact integer share, smoothed
    by 5. Part ``pair``: the other sources of the language by the sum of
    differences of shares, all ranks. Part ``term``: the kept terms the group
    has and gives a higher share than its language, by the difference, ``k`` ranks.

    Nulls count as empty strings. Repeated rows count each time. A language
    without kept terms has pairs of value 0 and no terms; a source alone in its
    language has no pairs; an empty table gives no rows. Ties go by item in UTF-8.
    """
    counts = stored(term_counts(docs), "terms")
    kept = (counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
            .where(F.col("docs") >= min_docs).drop("docs"))
    counts = stored(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-terms")
    of_lang = counts.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sources = named.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    groups = stored(named.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").join(sources, "lang")
                    .na.fill(0, ["total", "terms", "lang_total"]), "groups")
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = distances(counts, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                                             F.row_number().over(ranked).alias("rank"))
    over = (skyband(counts, k).join(join_side(groups), ["lang", "source"])
            .withColumn("value", share("n", "total", "terms") - share("lang_n", "lang_total", "terms"))
            .where("value > 0").withColumnRenamed("term", "item"))
    terms = over.select("lang", "source", F.lit("term").alias("part"), "item", "value",
                        F.row_number().over(ranked).alias("rank")).where(F.col("rank") <= k)
    return pairs.unionByName(terms)
