"""The registered queries of this package: each operator over its whole table, digests derived from its output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (arrow_ids, bpe, decontaminate, divergence, extract, language_model, licenses, mixing, ngram_join, oracles, pii,
               prefix_trie, quality, suffix_dedup)

JOINED = "array_join(transform({c}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"  # in the operator's order


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract(spark.read.parquet(f"{folder}/pages.parquet"))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(spark.read.parquet(f"{folder}/documents.parquet")).drop("detections")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(spark.read.parquet(f"{folder}/documents.parquet"))


def op4_arrow_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return arrow_ids.digests(arrow_ids.write_ids(spark.read.parquet(f"{folder}/documents.parquet")))


def op5_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(spark.read.parquet(f"{folder}/documents.parquet")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark.read.parquet(f"{folder}/documents.parquet")).drop("kept")


def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score(spark.read.parquet(f"{folder}/documents.parquet"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(spark.read.parquet(f"{folder}/documents.parquet"),
                                      spark.read.parquet(f"{folder}/benchmark.parquet"))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.pii_spans(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(F.expr(JOINED.format(c="base")), 256).alias("base_sha256"), F.expr(JOINED.format(c="spans")).alias("spans"))


def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.linked(spark.read.parquet(f"{folder}/documents.parquet"))


def op11_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan(spark.read.parquet(f"{folder}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet")).drop("ref_conv", "ref_pos", "ref_turn")


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(spark.read.parquet(f"{folder}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_extraction, op2_license_scan, op3_quality_rules, op4_arrow_token_ids, op5_bpe_round_trip,
                            op6_suffix_dedup, op7_lm_scoring, op8_decontamination, op9_pii, op10_ngram_join,
                            op11_source_mixing, op12_prefix_trie, op13_source_divergence)}
ORACLES: dict[str, str] = {"op11_source_mixing": oracles.SOURCE_MIXING, "op12_prefix_trie": oracles.PREFIX_TRIE,
                           "op13_source_divergence": oracles.SOURCE_DIVERGENCE}
