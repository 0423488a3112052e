"""Quality rules with adaptive limits from mergeable quantile sketches (DataFrame functions only).

Every measure of a document falls into a logarithmic bucket. The counts per
language, source, measure and bucket are the sketch: two sketches merge by
adding counts, so a hot source is summed map-side and small sources fall back
to the merged sketch of their language, then of all rows. A quantile read from
the buckets is within ``GAMMA - 1`` of the true value, relatively.

A limit lies a factor ``FENCE`` beyond an outer quantile of the rows that pass
the base rules, zeros counted as values, so one source may have a tighter or a
looser limit than another. ``MEASURES`` holds the rails no limit leaves: a
source full of junk cannot loosen its limits past them, nor a narrow one tighten them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import join_side, stored, text_rows, window_hashes, words

GAMMA = 1.02
LEAST_ROWS = 200  # a source or language with fewer rows uses the wider sketch
FENCE = 2.0       # limits lie this factor beyond the outer quantiles
# Each measure: of how many rows one lies outside the quantile (few for a measure whose junk is frequent), then the rails:
# the tightest and the loosest upper limit, the loosest and the tightest lower one.
MEASURES = {
    "symbol_rate": (10, 0.10, 0.30),
    "dup_line_rate": (100, 0.20, 0.50),
    "repeat_rate": (100, 0.08, 0.20),
    "word_length": (20, 10.0, 20.0, 2.0, 3.0),
}
ZERO = -100000    # the bucket of zero


def base_columns(docs: DataFrame) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` to every row.

    All inside the row. Windows of five words are compared by 64-bit hash; the
    positions of repeated ones are found by one sort, and only in texts that
    have any.
    """
    df = docs.withColumn("_w", words(F.col("text"))).withColumn("n_words", F.size("_w").cast("bigint"))
    df = window_hashes(df, "_w", 5, "_h")
    df = df.withColumn("_s", F.expr(
        "case when size(array_distinct(_h)) < size(_h) then sort_array(transform(_h, (x, i) -> struct(x as h, i as i)))"
        " end"))
    df = df.withColumn("_p", F.expr(
        "sort_array(transform(filter(_s, (e, k) -> (k > 0 and _s[k - 1].h = e.h)"
        " or (k < size(_s) - 1 and _s[k + 1].h = e.h)), e -> e.i))"))
    df = df.withColumn("n_repeat_words", F.expr(
        "coalesce(aggregate(transform(_p, (x, k) -> if(k = 0, 5, least(5, x - _p[k - 1]))), 0L, (a, x) -> a + x), 0L)"))
    df = df.withColumn("_l", F.expr(
        "transform(filter(split(text, '\\n'), x -> x rlike '[^ \\\\t-\\\\r]'), x -> xxhash64(x))"))
    return df.select(
        *docs.columns, "n_words",
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words", F.size("_l").cast("bigint").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def measures() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"symbol_rate": F.col("n_symbols") / n,
            "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
            "repeat_rate": F.col("n_repeat_words") / n,
            "word_length": F.col("word_chars") / n}


def _bucket(value: Column) -> Column:
    import math
    return F.when(value > 0, F.ceil(F.round(F.log(value) / math.log(GAMMA), 6))).otherwise(ZERO).cast("int")


def sketch(measured: DataFrame) -> DataFrame:
    """``lang, source, measure, bucket, n``: the mergeable sketch of every group.

    Rows that fail a base rule count 0: they go anyway and say nothing of the others, and a group of such rows
    alone has the wider sketch's limits.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), _bucket(v).alias("bucket"))
                                for k, v in measures().items()]))
    return (measured.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
                            F.when(base_failed(), 0).otherwise(1).alias("one"), cells.alias("c"))
            .groupBy("lang", "source", F.col("c.measure").alias("measure"), F.col("c.bucket").alias("bucket"))
            .agg(F.sum("one").alias("n")))


def _outer(cells: DataFrame, *group: str) -> DataFrame:
    """Buckets of the outer quantiles and row count of every group; groups hold a bounded number of buckets."""
    by = Window.partitionBy(*group, "measure")
    run = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    parts = F.lit(None)
    for name, (part, *_) in MEASURES.items():
        parts = F.when(F.col("measure") == name, part).otherwise(parts)
    return (cells.withColumn("_total", F.sum("n").over(by)).withColumn("_run", F.sum("n").over(run) * parts)
            .groupBy(*group, "measure").agg(
                F.max("_total").alias("rows"),
                F.min(F.when(F.col("_run") >= F.col("_total"), F.col("bucket"))).alias("low"),
                F.min(F.when(F.col("_run") >= F.col("_total") * (parts - 1), F.col("bucket"))).alias("high")))


def limits(cells: DataFrame, least_rows: int = LEAST_ROWS, fence: float = FENCE) -> DataFrame:
    """One row per language and source: ``<measure>_max`` and, where it has rails for one, ``<measure>_min``."""
    total = F.sum("n").alias("n")
    by_lang = _outer(cells.groupBy("lang", "measure", "bucket").agg(total), "lang")
    everything = _outer(cells.groupBy("measure", "bucket").agg(total).withColumn("_all", F.lit(1)), "_all")
    names = ("rows", "low", "high")
    wide = (_outer(cells, "lang", "source")
            .join(by_lang.select("lang", "measure", *[F.col(c).alias(f"l_{c}") for c in names]), ["lang", "measure"])
            .join(everything.select("measure", *[F.col(c).alias(f"a_{c}") for c in names]), ["measure"]))

    def pick(name: str) -> Column:
        return (F.when(F.col("rows") >= least_rows, F.col(name))
                .when(F.col("l_rows") >= least_rows, F.col(f"l_{name}")).otherwise(F.col(f"a_{name}")).cast("double"))

    def value(name: str) -> Column:
        return F.when(pick(name) > ZERO, F.pow(F.lit(GAMMA), pick(name))).otherwise(0.0)

    wide = wide.select("lang", "source", "measure", (value("low") / fence).alias("lower"), (value("high") * fence).alias("upper"))
    out = []
    for name, (_, *rails) in MEASURES.items():
        of = F.col("measure") == name
        for side, limit, least, most in zip(("max", "min"), ("upper", "lower"), rails[::2], rails[1::2]):
            out.append(F.max(F.when(of, F.least(F.greatest(limit, F.lit(least)), F.lit(most)))).alias(f"{name}_{side}"))
    return wide.groupBy("lang", "source").agg(*out)


def within() -> Column:
    """True where every measure lies inside the row's limits."""
    good = F.lit(True)
    for name, value in measures().items():
        good &= value <= F.col(f"{name}_max")
        if len(MEASURES[name]) > 3:
            good &= value >= F.col(f"{name}_min")
    return good


def verdict() -> Column:
    """One predicate on both sides of the join: half of it pushed below would measure each text twice."""
    return F.when(base_failed(), False).otherwise(within())


def with_limits(measured: DataFrame, table: DataFrame) -> DataFrame:
    side = join_side(table.withColumnsRenamed({"lang": "_lang", "source": "_source"}))
    return measured.join(side, (F.coalesce("lang", F.lit("")) == F.col("_lang"))
                         & (F.coalesce("source", F.lit("")) == F.col("_source")), "left")


def quality_report(docs: DataFrame) -> DataFrame:
    """Counts, base verdict and adaptive verdict of every row of ``docs``.

    ``kept`` is false where a base rule fails or a measure lies outside the
    limits of the row's language and source. A null text counts as empty, a
    null language or source is a group of its own; repeated rows each give a
    row and count each in the sketch. An empty table gives no rows.
    """
    measured = stored(base_columns(text_rows(docs, "lang", "source")).drop("text"), "quality")
    table = stored(limits(sketch(measured)), "limits")
    return with_limits(measured, table).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), verdict().alias("kept"),
        *[c for c in table.columns if c not in ("lang", "source")])


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_report` keeps, with their columns.

    The limits come from all rows; a second scan measures each row again next
    to its text, so texts are not shuffled when the limits fit a broadcast.
    """
    columns = docs.columns
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), "lang", "source",
                       F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    table = stored(limits(sketch(base_columns(rows.drop("_row")))), "limits")
    kept = with_limits(base_columns(rows), table).where(verdict())
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in columns])
