"""Checked broadcasts: a side is broadcast only after its size was measured."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

BROADCAST_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class Measured:
    rows: int
    bytes: int

    def fits(self, limit: int = BROADCAST_BYTES) -> bool:
        return self.bytes <= limit


def _width(name: str, dtype: T.DataType) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + F.lit(16)
    if isinstance(dtype, T.ArrayType) and not isinstance(
        dtype.elementType, (T.StringType, T.StructType, T.ArrayType, T.MapType)
    ):
        return F.greatest(F.size(column), F.lit(0)) * F.lit(8) + F.lit(16)
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + F.lit(16)
    return F.lit(8)


def measure(df: DataFrame) -> Measured:
    """Row count and an upper estimate of the bytes, in one aggregate job."""
    total = F.lit(0)
    for field in df.schema.fields:
        total = total + _width(field.name, field.dataType)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(total.cast("bigint")).alias("b")).first()
    return Measured(int(row["n"]), int(row["b"] or 0))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the measured size allows it, else leave the plan to Spark."""
    return F.broadcast(df) if measure(df).fits(limit) else df
