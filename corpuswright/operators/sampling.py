"""Order, samples, splits and batches, all decided by hashes or ids, never by ``rand()``."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ordinals import with_group_size, with_ordinal, with_running_sums
from .selection import first_n


def head_sample(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows in the given order, as a set: no task gathers them."""
    return first_n(df, n, [F.col(o) for o in order])


def shuffle_key(row_id: str, seed: int) -> Column:
    """Place of a row in the seeded order: an MD5, which any engine computes alike."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))


def seeded_shuffle(df: DataFrame, row_id: str, seed: int = 42, out: str = "position") -> DataFrame:
    """Reproducible order that does not depend on partitioning; ``out`` numbers it from 1."""
    return with_ordinal(df, out, [shuffle_key(row_id, seed), F.col(row_id)])


def sample_to_target(df: DataFrame, n: int, unit: str, order: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows: whole units (files, pages) drawn without replacement, again
    from the start when all are used up. ``draw`` numbers the round. Full rounds take
    every row; the last one takes the first in a seeded order of its own."""
    available = df.count()
    if not available:
        return df.withColumn("draw", F.lit(0)).limit(0)
    full, rest = divmod(n, available)
    draws = F.sequence(F.lit(0), F.lit(full - 1)) if full else F.array().cast("array<int>")
    whole = df.withColumn("draw", F.explode(draws))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(full)), F.col(unit).cast("string")))
    last = first_n(df, rest, [place, F.col(unit), *[F.col(o) for o in order]])
    return whole.unionByName(last.withColumn("draw", F.lit(full)))


def renumber(df: DataFrame, out: str, order: Sequence[Column], start: int = 0) -> DataFrame:
    """Dense new ids in source order."""
    return with_ordinal(df, out, order).withColumn(out, F.col(out) - 1 + start)


def batch_number(df: DataFrame, n: int, order: Sequence[Column], out: str = "batch") -> DataFrame:
    """Groups of ``n`` consecutive rows, numbered from 0."""
    return with_ordinal(df, out, order).withColumn(out, F.floor((F.col(out) - 1) / F.lit(n)).cast("bigint"))


def running_progress(df: DataFrame, correct: Column, latency: str, order: Sequence[Column],
                     group: Sequence[Column] = ()) -> DataFrame:
    """Accuracy and mean latency over all rows so far."""
    summed = with_running_sums(df, {
        "processed": F.lit(1).cast("bigint"),
        "correct_so_far": correct.cast("bigint"),
        "__latency": F.col(latency).cast("double"),
    }, order, group)
    return summed.withColumns({
        "accuracy_so_far": F.round(F.col("correct_so_far") / F.col("processed"), 4),
        "latency_so_far": F.round(F.col("__latency") / F.col("processed"), 4),
    }).drop("__latency")


def plain_split(df: DataFrame, order: Sequence[Column], *, two_stage: bool = False,
                train: float = 0.8, val: float = 0.1, out: str = "split") -> DataFrame:
    """Train / val / test by position. Plain: ``int(n*train)``, ``int(n*val)``, the rest.
    Two-stage: a rounded-up share ``1 - train`` is cut off and its rounded-up half is the test set."""
    n = df.count()
    if two_stage:
        held = math.ceil(round(n * (1 - train), 9))
        n_train, n_val = n - held, held - math.ceil(held * 0.5)
    else:
        n_train, n_val = int(n * train), int(n * val)
    numbered = with_ordinal(df, "__position", order)
    return numbered.withColumn(out, _by_position(F.lit(n_train), F.lit(n_train + n_val))).drop("__position")


def _by_position(first: Column, second: Column) -> Column:
    place = F.col("__position")
    return F.when(place <= first, "train").when(place <= second, "val").otherwise("test")


def stratified_split(df: DataFrame, label: str, order: Sequence[Column], *, train: float = 0.8,
                     val: float = 0.1, out: str = "split") -> DataFrame:
    """The same shares within every label."""
    numbered = with_ordinal(df, "__position", order, [F.col(label)])
    sized = with_group_size(numbered, "__n", [label])
    n_train = F.floor(F.round(F.col("__n") * F.lit(train), 9))
    n_val = F.floor(F.round(F.col("__n") * F.lit(val), 9))
    return sized.withColumn(out, _by_position(n_train, n_train + n_val)).drop("__position", "__n")


def concat_datasets(parts: Sequence[DataFrame], part_column: str | None = None) -> DataFrame:
    """Union of all parts; missing columns become null. ``part_column`` numbers the
    parts, so that the order can be restored."""
    out = None
    for i, part in enumerate(parts):
        rows = part if part_column is None else part.withColumn(part_column, F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
