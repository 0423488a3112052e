"""The first ``n`` rows of an order, found by rounds of range histograms.

A sorted limit brings ``n`` rows into one task. Here each round cuts the keys
that are still in question into ranges by a bounded sample, counts the ranges in
one aggregate, and goes on inside the range that holds the ``n``-th key. Once few
keys are left they are read and the ``n``-th is known; the result is a filter, so
its rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .ordinals import _constant, _leaves, _range_of

RANGES = 256  # ranges of a round
FEW = 4096    # keys that may be read
_KEY = "__key"


def first_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """Exactly the ``n`` first rows (all, if fewer), unsorted and wherever they lie.

    Rows that ``order`` does not tell apart go by a hash of the whole row, so a rerun takes the same; rows equal in
    everything are taken as often as they fit.
    """
    columns = df.columns
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    keyed = df.withColumn(_KEY, key)
    if n <= 0:
        return df.limit(0)
    found = _edge(keyed, n)
    if found is None:
        return df
    edge, before = found
    key_type = keyed.schema[_KEY].dataType
    limit = F.expr(_constant(iter(edge), key_type))
    below = keyed.filter(F.col(_KEY) < limit)
    # Rows at the edge are equal in all columns: one of them stands for as many as are still missing.
    at = keyed.filter(F.col(_KEY) == limit).dropDuplicates([_KEY]).withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(n - before))))
    return below.select(*columns).unionByName(at.select(*columns))


def _edge(keyed: DataFrame, n: int) -> tuple[list[str | None], int] | None:
    """Leaves of the ``n``-th key as text, and how many keys lie before it; nothing if there are at most ``n`` rows."""
    key_type: T.DataType = keyed.schema[_KEY].dataType
    inside, before, size = keyed.select(_KEY), 0, None
    while size is None or size > FEW:
        sample = (inside.orderBy(F.xxhash64(_KEY), _KEY).limit(RANGES * 8).orderBy(_KEY).select(*_leaves(F.col(_KEY), key_type)).collect())
        edges = list(dict.fromkeys(tuple(sample[i * len(sample) // RANGES]) for i in range(RANGES))) if sample else []
        limits = [_constant(iter(e), key_type) for e in edges]
        if not limits:
            return None
        counts = {r["r"]: r["count"] for r in inside.groupBy(_range_of(F.col(_KEY), limits).alias("r")).count().collect()}
        if size is None and sum(counts.values()) <= n:
            return None
        for r in range(len(limits) + 1):
            if before + counts.get(r, 0) >= n:
                break
            before += counts.get(r, 0)
        # Range r holds the keys from limit r - 1 up to, not including, limit r.
        if r:
            inside = inside.filter(F.col(_KEY) >= F.expr(limits[r - 1]))
        if r < len(limits):
            inside = inside.filter(F.col(_KEY) < F.expr(limits[r]))
        if r and len(limits) == 1 and counts.get(1) == sum(counts.values()):
            break  # one key is left, however often it stands there
        size = counts.get(r, 0)
        if r and size > FEW:  # a key with very many equal rows: is it the edge itself?
            equal = inside.filter(F.col(_KEY) == F.expr(limits[r - 1])).count()
            if before + equal >= n:
                return list(edges[r - 1]), before
            inside, before, size = inside.filter(F.col(_KEY) > F.expr(limits[r - 1])), before + equal, size - equal
    else:
        keys = inside.orderBy(_KEY).select(*_leaves(F.col(_KEY), key_type)).collect()
        edge = tuple(keys[n - before - 1])
        return list(edge), before + next(i for i, k in enumerate(keys) if tuple(k) == edge)
    return list(edges[0]), before
