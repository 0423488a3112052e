"""Sinks. All are idempotent overwrites of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from .. import fixed
from ..operators.filters import length_violations
from .folders import in_tasks, write_folders


def write_json(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), *, many_folders: bool = False) -> None:
    """JSON lines. ``many_folders`` is for about one folder a row: the tasks write them, the rows of a folder to one file."""
    if many_folders and in_tasks(df.sparkSession, path):
        line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in partition_by]))
        write_folders(df.select(*partition_by, line.alias("__json")), path, partition_by, "__json", "json")
        return
    df.write.mode("overwrite").partitionBy(*partition_by).json(path)


write_jsonl = write_json


def write_csv_report(df: DataFrame, path: str) -> None:
    """Report with a header; reports are small, still no row passes the driver."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_batch(df: DataFrame, path: str, batch: int) -> None:
    """Keep cumulative results: each batch is a folder of its own, so a repeated batch
    replaces itself instead of doubling its rows."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def build_collection(chunks: DataFrame, path: str, *, cell: str = "cluster_id",
                     limits: dict[str, int] | None = None) -> tuple[int, int]:
    """Write a collection afresh, one folder per cell, so that a search reads only the
    probed cells; return the numbers of rows stored and rejected.

    Rows over the store limits go, with the ``offending`` columns, to the folder
    ``path`` with ``-rejected`` behind. The rebalance hint lets Spark split a cell that holds a large part
    of the corpus into several write tasks and join small ones.
    """
    limits = {c: n for c, n in (limits or fixed.NOTICE_LIMITS).items() if c in chunks.columns}
    kept = chunks
    for column, n in limits.items():
        kept = kept.filter(F.coalesce(F.octet_length(F.col(column)), F.lit(0)) <= n)
    stored, rejected = Observation(), Observation()
    count = F.count(F.lit(1)).alias("rows")
    kept.observe(stored, count).hint("rebalance", cell).write.mode("overwrite").partitionBy(cell).parquet(path)
    rejected_rows(chunks, limits).observe(rejected, count).write.mode("overwrite").parquet(f"{path}-rejected")
    return stored.get.get("rows", 0), rejected.get.get("rows", 0)


def rejected_rows(chunks: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """The rows ``build_collection`` leaves out, with the offending columns."""
    chosen = {c: n for c, n in (limits or fixed.NOTICE_LIMITS).items() if c in chunks.columns}
    return length_violations(chunks, chosen)


def read_collection(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
