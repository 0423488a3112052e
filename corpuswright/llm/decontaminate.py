"""Benchmark decontamination by SimHash and a multi-index over Hamming blocks (DataFrame functions only).

1. Windows of an item's size are laid where a document shares a word shingle
   with the benchmark. Only such windows can be similar at all. The diagonals of
   shared shingles are tried; with several gaps in a passage a window between two
   diagonals could be more similar than either. Equal windows are kept once.
2. Window and item fingerprints have ``BITS`` bits. A shingle's occurrences are
   numbered and each votes by its own hash, so weighted similarity is the plain
   similarity of two sets and no repeated shingle moves all sums together.
3. Fingerprints are cut into ``radius + 1`` blocks. Two that differ in at most
   ``radius`` bits agree in one block, so joining on blocks of equal window size
   loses none of them. Items of less than ``SMALL`` shingles, whose few votes
   scatter more than the radius allows for, meet their windows by shared shingles.
4. Candidates are verified by their exact weighted similarity,
   the sum of smaller over the sum of larger shingle counts.

Words are runs of letters and digits of the lower-cased text. An item shorter
than five words has one shingle of all its words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, join_side, stored, text_rows, window_hashes

SHINGLE = 5
SIMILARITY = 0.8
BITS = 64
# A pair at similarity 0.8 has an angle of 27 degrees: about 9.7 of 64 bits differ, standard deviation 2.9.
RADIUS = 19
SMALL = 24  # items with fewer shingles are joined exactly
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def _items(benchmark: DataFrame) -> DataFrame:
    """``item_id, n, k, h``: words, shingle size and shingle hashes of every item that has words."""
    rows = (benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
            .select("item_id", _words(F.col("text")).alias("_w")).withColumn("n", F.size("_w")).where("n > 0")
            .withColumn("k", F.least("n", F.lit(SHINGLE))))
    sizes = [window_hashes(rows.where(F.col("k") == k), "_w", k, "h").select("item_id", "n", "k", "h")
             for k in range(1, SHINGLE + 1)]
    return reduce(DataFrame.union, sizes)


def _hashed(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, body, h``: shingle hashes of every row; ``body`` tells texts of one ``doc_id`` apart."""
    df = docs.withColumn("_w", _words(F.col("text"))).withColumn("body", F.xxhash64("text"))
    return window_hashes(df, "_w", k, "h").select("doc_id", "body", "h")


def _windows(docs: DataFrame, shingles: DataFrame, k: int) -> DataFrame:
    """``doc_id, body, start, n, window, w``: every candidate window of ``k``-word shingles, by diagonal.

    The outer explode keeps Spark from deriving a filter on the whole hash
    expression and pushing it below the columns it shares. The first scan finds the diagonals, the second reads the windows of the few
    documents that have any.
    """
    mine = join_side(shingles.where(F.col("k") == k).select("h", "place", "n"))
    hits = (_hashed(docs, k).select("doc_id", "body", F.posexplode_outer("h").alias("at", "h")).join(mine, "h")
            .select("doc_id", "body", "n", (F.col("at") - F.col("place")).alias("from")).distinct())
    hits = stored(hits.groupBy("doc_id", "body").agg(F.collect_set(F.struct("n", "from")).alias("hits")), "hits")
    found = docs.withColumn("_body", F.xxhash64("text")).join(
        join_side(hits.withColumnRenamed("doc_id", "_doc")),
        F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_body") == F.col("body")))
    found = found.withColumn("_w", _words(F.col("text"))).drop("text")
    found = window_hashes(found, "_w", k, "h").select("doc_id", "body", "h", F.explode("hits").alias("hit"))
    first = F.greatest(F.col("hit.from"), F.lit(0))
    length = F.least(F.col("hit.from") + F.col("hit.n") - (k - 1), F.size("h")) - first
    return (found.select("doc_id", "body", F.col("hit.n").alias("n"), first.cast("bigint").alias("start"),
                         F.slice("h", first + 1, length).alias("w"))
            .groupBy("doc_id", "body", "n", "start", F.xxhash64("w").alias("window")).agg(F.first("w").alias("w")))


def _occurrences(rows: DataFrame, key: str, array: str) -> DataFrame:
    """``key, s``: the hash of every shingle and the number of its occurrence, from 1."""
    counts = rows.select(key, F.explode(array).alias("h")).groupBy(key, "h").agg(F.count(F.lit(1)).alias("c"))
    return counts.select(key, "h", F.explode(F.sequence(F.lit(1).cast("bigint"), "c")).alias("i")).select(
        key, F.xxhash64("h", "i").alias("s"))


def _fingerprints(rows: DataFrame, key: str, array: str) -> DataFrame:
    """``key, fp``: the sign of 64 sums of the votes of numbered shingles."""
    votes = _occurrences(rows, key, array)
    sums = votes.groupBy(key).agg(*[
        F.sum(F.expr(f"(shiftright(s, {b}) & 1L) * 2 - 1")).alias(f"b{b}") for b in range(BITS)])
    bits = reduce(lambda a, b: a.bitwiseOR(b), [
        F.when(F.col(f"b{b}") > 0, F.expr(f"shiftleft(1L, {b})")).otherwise(F.lit(0).cast("bigint"))
        for b in range(BITS)])
    return sums.select(key, bits.alias("fp"))


def _blocks(radius: int) -> Column:
    """``radius + 1`` numbered pieces of the column ``fp``."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    pieces = [F.struct(F.lit(i).alias("block"), F.expr(
        f"shiftrightunsigned(fp, {a}) & {(1 << (b - a)) - 1}L").alias("value"))
        for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return F.explode(F.array(*pieces))


def _small_pairs(bodies: DataFrame, marks: DataFrame, items: DataFrame, item_marks: DataFrame, similarity: float) -> DataFrame:
    """``window, item_id, n, hamming`` of the windows that share one of an item's first shingles.

    Of ``m`` numbered shingles a similar window lacks at most ``m - similarity * m``, so it holds one of any
    subset with one more.
    """
    first = (_occurrences(items, "item_id", "h").groupBy("item_id").agg(F.sort_array(F.collect_set("s")).alias("a"))
             .select("item_id", F.explode(F.slice(
                 "a", F.lit(1), F.size("a") - F.ceil(F.size("a") * similarity - 1e-9).cast("int") + 1)).alias("s"))
             .join(item_marks.select("item_id", "n", "k", F.col("fp").alias("item_fp")), "item_id"))
    held = _occurrences(bodies.dropDuplicates(["window"]), "window", "w")
    found = held.join(join_side(stored(first, "first")), "s").select("window", "item_id", "n", "k", "item_fp").distinct()
    return found.join(marks, ["window", "n", "k"]).select(
        "window", "item_id", "n", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("hamming"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
                 radius: int = RADIUS) -> DataFrame:
    """``doc_id, item_id, similarity, hamming, start, n_words``: documents with a window like a benchmark item.

    One row per document and item: the most similar window, the first of equal
    ones; ``start`` counts words from 0. Null and empty texts hold no window,
    rows that repeat a document give its result once, all rows without ``doc_id`` count as
    one document, items without words are ignored and two items of one text are both
    reported. An empty table on either side gives no rows. A window cut off by
    the document's end is compared as it is.
    """
    rows = _similar(docs, benchmark, similarity, radius)
    best = F.max_by(F.struct("similarity", "hamming", "start", "n"),
                    F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("hamming")).alias("h")))
    return rows.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", "best.similarity", F.col("best.hamming").cast("bigint").alias("hamming"),
        "best.start", F.col("best.n").cast("bigint").alias("n_words"))


def _similar(docs: DataFrame, benchmark: DataFrame, similarity: float, radius: int) -> DataFrame:
    """``doc_id, body, start, n, item_id, hamming, similarity``: every window like an item; ``body`` is a hash of the row's text."""
    items = stored(_items(benchmark), "items")
    shingles = stored(items.select("n", "k", F.posexplode("h").alias("place", "h")).distinct(), "shingles")
    sizes = sorted(r["k"] for r in shingles.select("k").distinct().collect())  # at most five
    texts = text_rows(docs)
    found = reduce(DataFrame.union, [
        _windows(texts, shingles, k).withColumn("k", F.lit(k)) for k in sizes or [SHINGLE]])
    found = stored(found, "windows")
    bodies = stored(found.groupBy("window", "n", "k").agg(F.first("w").alias("w")), "bodies")
    once = bodies.dropDuplicates(["window"]).select("window", "w")  # one text may be a window of several sizes
    marks = stored(bodies.select("window", "n", "k").join(_fingerprints(once, "window", "w"), "window"), "window-marks")
    item_marks = stored(items.select("item_id", "n", "k").join(_fingerprints(items, "item_id", "h"), "item_id"), "marks")
    few = F.col("n") - F.col("k") + 1 < SMALL
    left = marks.where(~few).select("window", "n", "k", "fp", _blocks(radius).alias("b")).select("window", "n", "k", "fp", "b.*")
    right = item_marks.where(~few).select("item_id", "n", "k", "fp", _blocks(radius).alias("b")).select(
        "item_id", "n", "k", F.col("fp").alias("item_fp"), "b.*")
    near = (left.join(join_side(right), ["n", "k", "block", "value"])
            .withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
            .where(F.col("hamming") <= radius).select("window", "item_id", "n", "hamming").distinct())
    near = stored(near.union(_small_pairs(bodies.where(few), marks, items.where(few), item_marks, similarity)), "near")
    counts = bodies.select("window", "n", F.size("w").alias("total"), F.explode("w").alias("s")) \
        .groupBy("window", "n", "total", "s").agg(F.count(F.lit(1)).alias("c"))
    item_counts = items.select("item_id", F.size("h").alias("item_total"), F.explode("h").alias("s")) \
        .groupBy("item_id", "item_total", "s").agg(F.count(F.lit(1)).alias("item_c"))
    exact = (near.join(counts, ["window", "n"]).join(join_side(stored(item_counts, "counts")), ["item_id", "s"])
             .groupBy("window", "n", "item_id", "hamming", "total", "item_total")
             .agg(F.sum(F.least("c", "item_c")).alias("both"))
             .withColumn("similarity", F.col("both") / (F.col("total") + F.col("item_total") - F.col("both")))
             .where(F.col("similarity") >= similarity)
             .select("window", "n", "item_id", "hamming", F.round("similarity", 6).alias("similarity")))
    return found.select("doc_id", "body", "start", "n", "window").join(join_side(stored(exact, "exact")), ["window", "n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no window like a benchmark item.

    Rows are told apart by ``doc_id`` and a hash of their text: of rows that share an id, or have none, only those with a
    window go. Null and empty texts stay; an empty benchmark removes nothing.
    """
    doc, body = fresh(docs, "doc", "body")
    bad = _similar(docs, benchmark, similarity, radius).select(F.col("doc_id").alias(doc), F.col("body").alias(body)).distinct()
    same = (F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col(body)))
    return docs.join(join_side(stored(bad, "bad")), same, "left_anti")
