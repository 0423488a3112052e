"""Row numbers and running sums without a single-task window.

A plain ``row_number()`` over an unpartitioned (or badly skewed) window sorts
everything in one task. Here the rows are cut into key ranges first: each range
is numbered on its own and the totals of the ranges before it are added. A hot
group spreads over as many ranges as its share of the rows asks for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.core import let
from ..sizing import _width, broadcast_if_small

SAMPLES_PER_RANGE = 24
WINDOW_ROWS = 1 << 20  # groups of at most so many rows and bytes, as measured, are numbered by one window each
WINDOW_BYTES = 128 << 20
_GROUP, _KEY, _RANGE = "__group", "__key", "__range"


def _range_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _fit_windows(df: DataFrame, group: Sequence[Column]) -> bool:
    """Whether the largest group is small enough for one task. The counts are added map-side; two numbers are returned."""
    if not group:
        return False
    width = reduce(lambda a, b: a + b, [_width(f.name, f.dataType) for f in df.schema.fields])
    counts = df.groupBy(*[g.alias(f"g{i}") for i, g in enumerate(group)]).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(width.cast("bigint")).alias("__bytes"))
    largest = counts.agg(F.max("__n").alias("n"), F.max("__bytes").alias("bytes")).first()
    return (largest["n"] or 0) <= WINDOW_ROWS and (largest["bytes"] or 0) <= WINDOW_BYTES


def _with_ranges(df: DataFrame, group: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """Add the group struct, the sort key and the number of the key range.

    Range limits come from a hash-ordered sample of bounded size and enter the
    plan as constants, so every evaluation sees the same limits. Any limits give
    right results; good ones give even ranges. A table the sample holds whole and that makes one range gets no
    range column.
    """
    keyed = df.withColumn(_GROUP, F.struct(*[g.alias(f"g{i}") for i, g in enumerate(group)])
                          if group else F.struct(F.lit(0).alias("g0")))
    keyed = keyed.withColumn(_KEY, F.struct(F.col(_GROUP).alias("g"),
                                            *[o.alias(f"o{i}") for i, o in enumerate(order)]))
    wanted = _range_count(df)
    key_type = keyed.schema[_KEY].dataType
    sample = (keyed.select(_KEY).orderBy(F.xxhash64(_KEY), _KEY).limit(wanted * SAMPLES_PER_RANGE)
              .orderBy(_KEY).select(*_leaves(F.col(_KEY), key_type)).collect())
    ranges = min(wanted, len(sample) // SAMPLES_PER_RANGE)
    limits = [sample[i * len(sample) // ranges] for i in range(1, ranges)]
    if not limits:  # too few rows to cut: one window does
        return keyed
    return keyed.withColumn(_RANGE, _range_of(F.col(_KEY), [_constant(iter(r), key_type) for r in limits]))


def _leaves(value: Column, dtype: T.DataType) -> list[Column]:
    if isinstance(dtype, T.StructType):
        return [leaf for f in dtype.fields for leaf in _leaves(value[f.name], f.dataType)]
    return [value.cast("string")]


def _constant(texts: Iterator[str | None], dtype: T.DataType) -> str:
    """SQL constant of the key type from its leaves as text."""
    if isinstance(dtype, T.StructType):
        fields = ", ".join(f"'{f.name}', {_constant(texts, f.dataType)}" for f in dtype.fields)
        return f"named_struct({fields})"
    text = next(texts)
    quoted = "NULL" if text is None else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"CAST({quoted} AS {dtype.simpleString()})"


def _range_of(key: Column, limits: list[str]) -> Column:
    """How many of the sorted limits are at or below the key: first among the heads of
    blocks of limits, then inside one block, so the work grows with the root of their number."""
    block = math.isqrt(len(limits)) + 1
    blocks = [limits[i:i + block] for i in range(0, len(limits), block)]
    heads = F.expr("array(" + ", ".join(b[0] for b in blocks) + ")")
    listed = F.expr("array(" + ", ".join("array(" + ", ".join(b) + ")" for b in blocks) + ")")

    def place(k: Column) -> Column:
        def at_or_below(edges: Column) -> Column:
            return F.size(F.filter(edges, lambda e: e <= k))

        return let(at_or_below(heads), lambda head: F.when(head == 0, 0).otherwise(
            (head - 1) * block + at_or_below(F.get(listed, head - 1))))

    return let(key, place)


def _with_prefix(ranged: DataFrame, totals: dict[str, Column], grouped: bool) -> DataFrame:
    """Join each row with the totals of the ranges before its own."""
    per_range = ranged.groupBy(_GROUP, _RANGE).agg(*[t.alias(n) for n, t in totals.items()])
    before = Window.partitionBy(_GROUP).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    prefix = per_range.select(
        _GROUP, _RANGE, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in totals]
    )
    # Without groups there is one prefix row per range: a bounded side.
    side = prefix if grouped else F.broadcast(prefix)
    return ranged.join(side, [_GROUP, _RANGE])


def with_ordinal(df: DataFrame, out: str, order: Sequence[Column],
                 group: Sequence[Column] = ()) -> DataFrame:
    """Dense 1-based position of each row in ``order`` (ascending) within ``group``.

    ``order`` must identify a row; add the id as its last column. Groups that all fit a window cost one shuffle;
    otherwise every group is cut into ranges.
    """
    if _fit_windows(df, group):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint"))
    ranged = _with_ranges(df, group, order)
    if _RANGE not in ranged.columns:
        return ranged.withColumn(out, F.row_number().over(Window.partitionBy(_GROUP).orderBy(_KEY)).cast("bigint")).drop(_GROUP, _KEY)
    joined = _with_prefix(ranged, {"__before": F.count(F.lit(1))}, bool(group))
    inside = Window.partitionBy(_GROUP, _RANGE).orderBy(_KEY)
    return joined.withColumn(
        out, (F.row_number().over(inside) + F.col("__before")).cast("bigint")
    ).drop(_GROUP, _KEY, _RANGE, "__before")


def with_running_sums(df: DataFrame, sums: dict[str, Column], order: Sequence[Column],
                      group: Sequence[Column] = ()) -> DataFrame:
    """Inclusive running sums of the given expressions; nulls count as 0."""
    if _fit_windows(df, group):
        so_far = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(F.coalesce(expr, F.lit(0))).over(so_far) for name, expr in sums.items()})
    filled = {f"__v{i}": F.coalesce(expr, F.lit(0)) for i, expr in enumerate(sums.values())}
    ranged = _with_ranges(df.withColumns(filled), group, order)
    if _RANGE not in ranged.columns:
        whole = Window.partitionBy(_GROUP).orderBy(_KEY).rowsBetween(Window.unboundedPreceding, 0)
        return ranged.withColumns({name: F.sum(f"__v{i}").over(whole) for i, name in enumerate(sums)}).drop(_GROUP, _KEY, *filled)
    names = {f"__p{i}": F.sum(f"__v{i}") for i in range(len(sums))}
    joined = _with_prefix(ranged, names, bool(group))
    inside = (Window.partitionBy(_GROUP, _RANGE).orderBy(_KEY)
              .rowsBetween(Window.unboundedPreceding, 0))
    out = {name: F.sum(f"__v{i}").over(inside) + F.col(f"__p{i}") for i, name in enumerate(sums)}
    return joined.withColumns(out).drop(_GROUP, _KEY, _RANGE, *filled, *names)


def with_group_size(df: DataFrame, out: str, group: Sequence[str]) -> DataFrame:
    """Attach the group's row count by an aggregate and a join, not by a window: a hot
    group then stays spread over its tasks."""
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias(out))
    return df.join(broadcast_if_small(counts), list(group))


def top_k(df: DataFrame, k: int, group: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Up to ``spark.sql.optimizer.windowGroupLimitThreshold`` (1,000 by default) Spark cuts
    every task to ``k`` per group before the shuffle, so a hot group costs ``k`` rows per task; a larger ``k``
    shuffles the whole group."""
    window = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn(rank, F.row_number().over(window).cast("bigint"))
            .filter(F.col(rank) <= k))
