"""A training corpus from ``documents``: quality rules, near-copies, benchmark leaks, personal data, token ids.

Each stage works on all rows its predecessor kept. The last returns one row per
document that is left, with its ids and the text they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuswright.llm import bpe, decontaminate, ngram_join, pii, quality
from corpuswright.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the adaptive limits keep."""
    return quality.quality_filter(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return ngram_join.keep_one(docs, shingle=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage like a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind."""
    return pii.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and the text they decode to, with digests."""
    return bpe.round_trip(docs).select(
        "doc_id", "n_tokens", "ids", "decoded", F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [("quality_rules", quality_rules), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks),
          ("personal_data", personal_data), ("token_ids", token_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one stage keeps is written and read by the next.

    Rows are told apart by ``doc_id`` and text, null ids and texts included; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
