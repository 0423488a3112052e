"""Mixing sources to target weights: equal blocks of words go to sources by highest quotients.

A source's documents stand in a seeded order and are cut into shards; a shard is
one run of words in blocks of equal length. Sources get whole blocks by the
highest quotients ``target / (2 * seats + 1)``, shards of a source share its
blocks by the same rule, and a shard takes its quota as whole rounds over all
its words and one run of blocks from a seeded place. What a document gives
follows from its place alone, so no block is ever a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ordinals import with_ordinal
from .common import join_side, stored

WORD = r"[^ \t-\r]+"
SEED = 17
BLOCK = 512  # words of a block at most
PARTS = 1000  # blocks the smallest source has at least, where it has the words
SHARD = 1 << 14  # words of a shard, on average
SHARDS = 4096  # shards of a source at most; beyond that they grow
REPEATS = 3  # times a word may be taken
SLACK = 1e-9  # the bounds below are widened by more than doubles round


def seat_bounds(total: float, parts: int, seats: int) -> tuple[float, float]:
    """Two quotients: all seats above the first are won, no seat below the second is.

    A divisor ``t`` gives ``floor((x / t + 1) / 2)`` seats to weight ``x``, at most half a seat
    a part away from ``total / 2t``.
    """
    won = total / (2 * seats - parts) * (1 + SLACK) if 2 * seats > parts else float("inf")
    return won, total / (2 * seats + parts) * (1 - SLACK)


def highest_quotients(weights: np.ndarray, seats: int) -> np.ndarray:
    """Seats of each weight by the ``seats`` highest quotients ``weight / (2k - 1)``; ties go to the earlier weight."""
    out = np.zeros(len(weights), np.int64)
    some = np.flatnonzero(weights > 0)
    if not len(some) or seats <= 0:
        return out
    x = weights[some].astype(float)
    won, lost = seat_bounds(x.sum(), len(x), seats)
    sure = np.floor((x / won + 1) / 2).astype(np.int64)
    more = np.floor((x / lost + 1) / 2).astype(np.int64) - sure
    who = np.repeat(np.arange(len(x)), more)
    seat = sure[who] + np.arange(len(who)) - np.repeat(np.cumsum(more) - more, more) + 1
    first = np.lexsort((who, -(x[who] / (2 * seat - 1))))[:seats - sure.sum()]
    out[some] = sure + np.bincount(who[first], minlength=len(x))
    return out


def _hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, place``: words of every text (null: none) and its place in the seeded order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), _place(seed).alias("place"))


def _place(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("")), F.lit(":"),
                          F.coalesce(F.col("text"), F.lit(""))))


def targets(sources: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Adds ``target`` to ``sources(weight, size)``: shares of all sizes by weight, none above
    ``repeats`` times its size; what is above goes to the others by weight.

    Each round freezes all sources above their limit and raises the level of the
    rest; only sums reach the driver. All comparisons are exact.
    """
    limit = F.col("size") * repeats
    total = int(sources.agg(F.sum("size").alias("n")).first()["n"] or 0)
    words, weight, frozen = total, None, None
    while True:
        over = F.lit(False) if weight is None else (
            limit.cast("decimal(19,0)") * F.lit(weight).cast("decimal(19,0)")
            < F.col("weight").cast("decimal(19,0)") * F.lit(words).cast("decimal(19,0)"))
        row = sources.agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, limit)).alias("words"),
                          F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if row["n"] == frozen or not row["weight"]:
            break
        frozen, words, weight = row["n"], total - int(row["words"] or 0), int(row["weight"])
    share = F.col("weight") * F.lit(words).cast("double") / F.lit(weight or 1)
    return sources.withColumn("target", F.when(over, limit.cast("double")).otherwise(share))


def quotas(sources: DataFrame, seats: int) -> DataFrame:
    """Adds ``quota`` to ``sources(i, target)``: the ``seats`` highest quotients over all sources; ties go to the smaller ``i``.

    Seats above a bound are counted, those near it (at most two a source) are ranked.
    """
    row = sources.where("target > 0").agg(F.sum("target").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not row["n"] or seats <= 0:
        return sources.withColumn("quota", F.lit(0).cast("bigint"))
    won, lost = seat_bounds(row["t"], row["n"], seats)
    count = lambda t: F.floor((F.col("target") / F.lit(t) + 1) / 2).cast("bigint")
    bounded = sources.withColumn("sure", count(won)).withColumn("may", F.when(F.col("target") > 0, count(lost)).otherwise(0))
    left = seats - bounded.agg(F.sum("sure").alias("n")).first()["n"]
    near = bounded.where("may > sure").select("i", "target", F.explode(F.sequence(F.col("sure") + 1, F.col("may"))).alias("seat"))
    near = near.withColumn("quotient", F.col("target") / (2 * F.col("seat") - 1))
    placed = with_ordinal(near, "nth", [-F.col("quotient"), F.col("i")]).where(F.col("nth") <= left)
    more = placed.groupBy("i").agg(F.count(F.lit(1)).alias("more"))
    return (bounded.join(more, "i", "left").withColumn("quota", F.col("sure") + F.coalesce("more", F.lit(0)))
            .drop("sure", "may", "more"))


def _share_out(table: pa.Table) -> pa.Table:
    """Quotas of one source's shards (at most ``SHARDS`` rows)."""
    table = table.sort_by("shard")
    quota = highest_quotients(table.column("words").to_numpy(), table.column("quota")[0].as_py())
    return table.select(["i", "shard", "words"]).append_column("blocks", pa.array(quota))


def plan(docs: DataFrame, *, seed: int = SEED, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, pieces, place``: what each document of
    ``docs(doc_id, text, source)`` gives to the mix.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. ``pieces``
    are runs of words ``[start, end)`` and how often the mix takes them. A block
    has ``block`` words, or fewer so that the smallest source has ``PARTS``; a
    source's taken words differ from its target by the rounding to blocks.

    Texts without words (null, empty) give and take nothing. Rows equal in id and
    text may change places with one another. An empty table gives no rows. A rerun gives
    the same rows, whatever the partitioning.
    """
    rows = stored(sized(docs, seed), "sizes")
    plain = rows.groupBy("source").agg(F.sum("size").alias("size"))
    numbered = with_ordinal(plain, "i", [F.col("source").isNull(), F.col("source")])
    sources = stored(targets(numbered.withColumn("weight", (F.col("i") - 1) % 3 + 1)), "sources")
    row = sources.agg(F.sum("size").alias("all"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")).first()
    block = max(1, min(block, (row["least"] or 0) // PARTS))
    shards = F.greatest(F.lit(1), F.least(F.lit(SHARDS), F.ceil(F.col("size") / shard))).cast("bigint")
    sources = stored(quotas(sources, ((row["all"] or 0) + block // 2) // block).withColumn("shards", shards), "quotas")
    side = sources.select(F.col("source").alias("_source"), "i", F.col("size").alias("source_size"), "target", "quota", "shards")
    dealt = (rows.join(join_side(side), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
             .withColumn("shard", F.when(F.col("size") > 0, F.conv(F.substring("place", 1, 8), 16, 10).cast("bigint") % F.col("shards"))))
    some = dealt.where("size > 0")
    totals = some.groupBy("i", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))
    shared = totals.groupBy("i").applyInArrow(_share_out, "i bigint, shard bigint, words bigint, blocks bigint")
    runs = (shared.withColumn("take", F.least(F.col("blocks") * block, F.col("words") * REPEATS))
            .withColumn("rounds", F.floor(F.col("take") / F.col("words")))
            .withColumn("more", F.col("take") - F.col("rounds") * F.col("words"))
            .withColumn("from", block * (_hash(F.concat_ws(":", F.lit(seed), "i", "shard")) % F.ceil(F.col("words") / block)))
            .drop("blocks", "take"))
    before = Window.partitionBy("i", "shard").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    laid = (some.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
            .join(join_side(stored(runs, "runs")), ["i", "shard"]))
    cut = lambda shift: F.struct(F.greatest(F.col("from") - shift - F.col("at"), F.lit(0)).cast("bigint").alias("start"),
                                 F.least(F.col("from") - shift + F.col("more") - F.col("at"), F.col("size")).cast("bigint").alias("end"),
                                 F.lit(1).cast("bigint").alias("times"))
    whole = F.struct(F.lit(0).cast("bigint").alias("start"), F.col("size").alias("end"), F.col("rounds").alias("times"))
    pieces = F.filter(F.array(whole, cut(F.col("words")), cut(F.lit(0))), lambda p: (p["times"] > 0) & (p["end"] > p["start"]))
    names = ["doc_id", "source", "size", "source_size", "target", "taken", "pieces", "place"]
    taken = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda s, p: s + (p["end"] - p["start"]) * p["times"])
    laid = laid.withColumn("pieces", pieces).withColumn("taken", taken).select(*names)
    empty = dealt.where("size = 0").withColumn("taken", F.lit(0).cast("bigint")).withColumn(
        "pieces", F.array().cast("array<struct<start:bigint,end:bigint,times:bigint>>")).select(*names)
    return laid.unionByName(empty)


def mixed(docs: DataFrame, *, seed: int = SEED, **options) -> DataFrame:
    """``doc_id, source, text``: the mix itself, one row for each time a run of words is taken, words parted by one space."""
    planned = plan(docs, seed=seed, **options).select("doc_id", "source", "place", F.explode("pieces").alias("p"))
    texts = docs.select(_place(seed).alias("place"), F.coalesce(F.col("text"), F.lit("")).alias("text")).groupBy("place").agg(
        F.first("text").alias("text"))
    run = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), (F.col("p.start") + 1).cast("int"),
                               (F.col("p.end") - F.col("p.start")).cast("int")), " ")
    return planned.join(texts, "place").select("doc_id", "source", run.alias("text"),
                                               F.explode(F.sequence(F.lit(1), F.col("p.times"))).alias("copy")).drop("copy")
