"""Equi-joins between datasets, hits, pages and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.contexts import page_window
from ..functions.core import norm_ws, strip
from ..session import materialise
from ..sizing import broadcast_if_small


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last duplicate wins. An aggregate, so duplicates collapse before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    latest = F.max_by(F.struct(*rest), F.struct(*order)) if rest else F.count(F.lit(1))
    return df.groupBy(*key).agg(latest.alias("__last")).select(*key, *[F.col(f"__last.{c}").alias(c) for c in rest])


def rejoin_ground_truth(rows: DataFrame, verified: DataFrame, *, question: str = "question",
                        truth: str = "ground_truth", order: str = "ordinal") -> DataFrame:
    """Override the truth by the verified one with the same stripped question.

    Blank questions and truths never match; the last verified duplicate wins.
    ``matched`` tells which rows changed hands.
    """
    source = verified.select(strip(question).alias("__q"), strip(truth).alias("__truth"), F.col(order).alias("__o"))
    source = source.filter((F.col("__q") != "") & (F.col("__truth") != ""))
    latest = keep_last(source, ["__q"], [F.col("__o")]).drop("__o")
    joined = rows.withColumn("__q", strip(question)).join(latest, "__q", "left")
    return (joined.withColumn("matched", F.col("__truth").isNotNull())
            .withColumn(truth, F.coalesce("__truth", truth)).drop("__q", "__truth"))


def match_coverage(asked: DataFrame, known: DataFrame, asked_col: str, known_col: str) -> DataFrame:
    """How many asked keys occur among the known ones, stripped and white-space-normalised."""
    raw = known.select(strip(known_col).alias("__raw")).distinct().withColumn("__raw_hit", F.lit(1))
    normal = known.select(norm_ws(known_col).alias("__norm")).distinct().withColumn("__norm_hit", F.lit(1))
    keyed = asked.select(strip(asked_col).alias("__raw"), norm_ws(asked_col).alias("__norm"))
    joined = keyed.join(raw, "__raw", "left").join(normal, "__norm", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("asked"),
        F.count("__raw_hit").alias("raw_hits"),
        F.count("__norm_hit").alias("normalised_hits"),
        F.count_if(F.col("__norm_hit").isNull()).alias("misses"),
    )


def coverage_misses(asked: DataFrame, known: DataFrame, asked_col: str, known_col: str) -> DataFrame:
    keys = known.select(norm_ws(known_col).alias("__norm")).distinct()
    return asked.withColumn("__norm", norm_ws(asked_col)).join(keys, "__norm", "left_anti").drop("__norm")


def reverse_eval_pairs(vision: DataFrame, text: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Pair two result sets on an explicit key and promote the vision answer to the
    truth. First dataset: the text answers; second: the original truths as answers."""
    gold = vision.select(key, F.col("answer").alias("vision_answer"))
    paired = text.join(gold, key)

    def dataset(answer: str) -> DataFrame:
        return paired.select(key, "question", F.col(answer).alias("answer"), "contexts",
                             F.col("vision_answer").alias("ground_truth"))

    return dataset("answer"), dataset("ground_truth")


def add_latency(summary: DataFrame, latencies: DataFrame, pipeline: str = "pipeline") -> DataFrame:
    """Mean latency per pipeline; both sides have one row per pipeline."""
    return summary.join(latencies, pipeline, "left")


def expand_to_neighbours(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Hit pages plus the pages before and after, as an equi-join on (doc_id, page).

    The wanted pages are written once and measured; where they fit a broadcast, the page texts stay put.
    """
    wanted = materialise(hits.select("query_id", "doc_id", F.explode(page_window(F.col("page_num"))).alias("page_num")).distinct(),
                         "wanted-pages")
    return pages.join(broadcast_if_small(wanted), ["doc_id", "page_num"])


def chunk_to_parent(chunks: DataFrame, parents: DataFrame, parent: str = "parent_id") -> DataFrame:
    return chunks.join(parents, parent)


def resume_anti(items: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Items not produced yet."""
    return items.join(done.select(*key), list(key), "left_anti")


def unused_pages(documents: DataFrame, used: DataFrame) -> DataFrame:
    """All pages ``1..pages`` of every document minus the used ``(doc_id, page)``."""
    every = documents.filter(F.col("pages") > 0).select(
        "doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("pages").cast("bigint"))).alias("page"))
    return every.join(used.select("doc_id", "page"), ["doc_id", "page"], "left_anti")


def used_page(context: Column, pattern: str = r"(\d+)페이지") -> Column:
    """Page number parsed out of a stored context note, null if there is none."""
    return F.nullif(F.regexp_extract(context, pattern, 1), F.lit("")).try_cast("bigint")


def repair_rows(rows: DataFrame, fixed_rows: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Replace the given columns where a repaired row exists."""
    renamed = fixed_rows.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(renamed, list(key), "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def doc_path_lookup(ids: DataFrame, paths: DataFrame, key: str = "doc_id") -> DataFrame:
    """Resolve ids through ``paths(doc_id, path, page_num)``; pages default to null
    (a single image). See ``parse_path_entry`` for the stored forms."""
    return ids.join(paths, key, "left")


def parse_path_entry(entry: Column) -> Column:
    """One struct ``(path, page_num)`` from a JSON entry: plain path, ``[path, page]`` or
    ``{"path": .., "page_num": ..}`` (page 1 when the object names none)."""
    text = F.trim(entry)
    listed = F.from_json(text, "array<string>")
    named = F.from_json(text, "struct<path:string,page_num:int>")
    return (
        F.when(text.startswith("["), F.struct(
            F.get(listed, F.lit(0)).alias("path"), F.get(listed, F.lit(1)).try_cast("int").alias("page_num")))
        .when(text.startswith("{"), F.struct(
            F.coalesce(named["path"], F.lit("unknown")).alias("path"),
            F.coalesce(named["page_num"], F.lit(1)).alias("page_num")))
        .otherwise(F.struct(F.regexp_replace(text, '^"|"$', "").alias("path"),
                            F.lit(None).cast("int").alias("page_num"))))


def choose_by_route(rows: DataFrame, route: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Per question, the text or the vision value: ``{out: (text_col, vision_col)}``.
    Anything but TEXT takes the vision side."""
    return rows.withColumns({
        out: F.when(F.col(route) == "TEXT", F.col(text)).otherwise(F.col(vision))
        for out, (text, vision) in pairs.items()})
