"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_finite(vector: Column) -> Column:
    """Neither null nor empty, and no component null, NaN or infinite."""
    return F.coalesce(
        (F.size(vector) > 0)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                   & (F.abs(x) < F.lit(float("inf")).cast("float"))),
        F.lit(False),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    def part(x: Column, y: Column) -> Column:
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return F.aggregate(F.zip_with(a, b, part), F.lit(0.0), lambda s, x: s + x)


def prefix_l2(a: Column, b: Column, dims: int) -> Column:
    return F.sqrt(squared_l2(F.slice(a, 1, dims), F.slice(b, 1, dims)))
