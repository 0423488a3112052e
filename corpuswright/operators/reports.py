"""Counts, means and comparison tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import null_if_nan
from ..functions.text import fixed_decimals, format_metric

DIGITS = 6


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def corpus_profile(notices: DataFrame) -> DataFrame:
    """Totals over ``notices(has_info, attachments, images)``, one row. Folders without
    their information file count in the total only; ``missing_info`` lists them."""
    known = F.col("has_info")
    files, images = F.coalesce(F.size("attachments"), F.lit(0)), F.coalesce(F.size("images"), F.lit(0))
    return notices.agg(
        F.count(F.lit(1)).alias("total_notices"),
        F.count_if(~known).alias("missing_info"),
        F.count_if(known & (files > 0)).alias("with_attachments"),
        F.count_if(known & (images > 0)).alias("with_images"),
        F.coalesce(F.sum(F.when(known, F.greatest(files, F.lit(0)))), F.lit(0)).cast("bigint").alias("attachment_files"),
        F.coalesce(F.sum(F.when(known, F.greatest(images, F.lit(0)))), F.lit(0)).cast("bigint").alias("image_files"),
    )


def missing_info(notices: DataFrame, notice_id: str = "notice_id") -> DataFrame:
    """Ids without an information file, as rows: the list may be long."""
    return notices.filter(~F.col("has_info")).select(notice_id)


def label_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def metric_means(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean per metric over the present values; an absent column gives 0."""
    means = [(F.round(F.avg(null_if_nan(m)), DIGITS) if m in df.columns else F.lit(0.0)).alias(m) for m in metrics]
    return df.groupBy(*by).agg(*means)


def metric_long_form(reports: dict[str, DataFrame], metrics: Sequence[str]) -> DataFrame:
    """Reports side by side as ``(condition, metric, score)`` means."""
    out = None
    for condition, report in reports.items():
        wide = metric_means(report, metrics).withColumn("condition", F.lit(condition))
        part = wide.unpivot(["condition"], list(metrics), "metric", "score")
        out = part if out is None else out.unionByName(part)
    return out


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Two-by-two counts; a prediction that is not the true class counts as the other one."""
    truth = F.when(F.col(actual).contains("TEXT"), "TEXT").otherwise("VISION")
    right = F.coalesce(F.col(predicted) == truth, F.lit(False))
    other = F.when(truth == "TEXT", "VISION").otherwise("TEXT")
    read = df.select(truth.alias("actual"), F.when(right, truth).otherwise(other).alias("predicted"))
    return read.groupBy("actual").agg(
        F.count_if(F.col("predicted") == "TEXT").alias("pred_text"),
        F.count_if(F.col("predicted") == "VISION").alias("pred_vision"))


def accuracy_by_class(matrix: DataFrame) -> DataFrame:
    """Overall and per-class accuracy in percent from ``confusion_matrix``; 0 for an empty class."""
    def cell(actual: str, predicted: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("actual") == actual, F.col(predicted))), F.lit(0))

    cells = matrix.agg(cell("TEXT", "pred_text").alias("tt"), cell("TEXT", "pred_vision").alias("tv"),
                       cell("VISION", "pred_vision").alias("vv"), cell("VISION", "pred_text").alias("vt"))

    def percent(part: Column, whole: Column) -> Column:
        return F.round(_share(part, whole) * 100, DIGITS)

    tt, tv, vv, vt = (F.col(c) for c in ("tt", "tv", "vv", "vt"))
    return cells.select(
        (tt + tv + vv + vt).alias("samples"),
        percent(tt + vv, tt + tv + vv + vt).alias("accuracy"),
        percent(tt, tt + tv).alias("text_accuracy"), percent(vv, vv + vt).alias("vision_accuracy"))


def classification_report(df: DataFrame, actual: str, predicted: str,
                          classes: Sequence[str] = ("TEXT", "VISION")) -> DataFrame:
    """Precision, recall, F1 and support per class, macro and weighted. Divisions by
    zero give 0. ``classes`` is the closed label set."""
    pairs = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    per_class = pairs.withColumn("label", F.explode(F.array(*[F.lit(c) for c in classes])))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    is_a, is_p = F.col("a") == F.col("label"), F.coalesce(F.col("p") == F.col("label"), F.lit(False))
    counted = per_class.groupBy("label").agg(
        total(is_a & is_p).alias("hit"), total(is_p).alias("named"), total(is_a).alias("support"))
    scored = counted.withColumns({"precision": _share(F.col("hit"), F.col("named")),
                                  "recall": _share(F.col("hit"), F.col("support"))})
    scored = scored.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"),
                                            F.col("precision") + F.col("recall")))
    measures = ("precision", "recall", "f1")
    rows = scored.select("label", *measures, "support")
    macro = scored.agg(*[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support")) \
        .select(F.lit("macro avg").alias("label"), *measures, "support")
    weighted = scored.agg(
        *[_share(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures],
        F.sum("support").alias("support"),
    ).select(F.lit("weighted avg").alias("label"), *measures, "support")
    return rows.unionByName(macro).unionByName(weighted).select(
        "label", *[F.round(m, DIGITS).alias(m) for m in measures], F.col("support").cast("bigint").alias("support"))


def route_eval_summary(df: DataFrame) -> DataFrame:
    """One row over ``(question, ground_truth, route_gold, route_pred, text/vision/tv latency)``:
    skips, route accuracy on rows with a gold route, mean latencies, four digits."""
    from .filters import evaluable

    state = evaluable(F.col("question"), F.col("ground_truth"))
    kept = F.col("state") == "ok"
    gold = kept & (F.coalesce(F.col("route_gold"), F.lit("")) != "")
    right = gold & (F.col("route_gold") == F.col("route_pred"))

    def mean(c: str) -> Column:
        return F.round(F.coalesce(F.avg(F.when(kept, F.col(c))), F.lit(0.0)), 4)

    return df.withColumn("state", state).agg(
        F.count_if(kept).alias("processed"),
        F.count_if(F.col("state") == "no_question").alias("skipped_no_question"),
        F.count_if(F.col("state") == "no_truth").alias("skipped_no_truth"),
        F.count_if(gold).alias("route_total"),
        F.count_if(F.coalesce(right, F.lit(False))).alias("route_correct"),
        F.round(_share(F.count_if(F.coalesce(right, F.lit(False))), F.count_if(gold)), 4).alias("route_accuracy"),
        mean("text_latency").alias("avg_text_latency"),
        mean("vision_latency").alias("avg_vision_latency"),
        mean("tv_latency").alias("avg_tv_latency"),
    )


def prediction_precision(df: DataFrame, actual: str, predicted: str, target: str = "VISION") -> DataFrame:
    """Hits and false alarms among the rows predicted as ``target``."""
    named = df.filter(F.col(predicted) == target)
    hit = F.col(actual) == target
    return named.agg(
        F.count(F.lit(1)).alias("predicted"), F.count_if(hit).alias("hits"),
        F.count_if(~hit).alias("false_alarms"),
        F.round(_share(F.count_if(hit), F.count(F.lit(1))), DIGITS).alias("precision"))


def speedup_summary(df: DataFrame, baseline: str, staged: str) -> DataFrame:
    ratio = F.try_divide(F.col(baseline), F.col(staged))
    return df.agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg(ratio), DIGITS).alias("mean_speedup"),
                  F.round(F.avg(staged), DIGITS).alias("mean_staged"))


def chunk_stats(chunks: DataFrame, parent: str = "parent_id") -> DataFrame:
    per_parent = chunks.groupBy(parent).agg(F.count(F.lit(1)).alias("n"))
    return per_parent.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("chunks"),
                          F.max("n").alias("most"), F.round(F.avg("n"), DIGITS).alias("chunks_per_document"))


def sources_per_query(hits: DataFrame) -> DataFrame:
    """Distinct sources, sorted; hits per query are bounded by the search's ``final_k``."""
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def batch_outcome(df: DataFrame, ok: Column, by: Sequence[str] = ()) -> DataFrame:
    """Processed, succeeded and failed counts; ``failed_items`` lists the failures."""
    good = F.coalesce(ok, F.lit(False))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("processed"), F.count_if(good).alias("succeeded"),
                               F.count_if(~good).alias("failed"))


def failed_items(df: DataFrame, ok: Column, item: str) -> DataFrame:
    return df.filter(~F.coalesce(ok, F.lit(False))).select(item)


def zero_shot_accuracy(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    right = F.coalesce(F.col(expected) == F.col(predicted), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(right).alias("correct"),
                  F.round(_share(F.count_if(right), F.count(F.lit(1))), DIGITS).alias("accuracy"))


def comparison_table(summary: DataFrame, latencies: DataFrame, accuracy: DataFrame, metrics: Sequence[str], *,
                     routed: str) -> DataFrame:
    """Formatted table: one row per pipeline, route accuracy only on the routed one.

    ``summary(pipeline, metrics..)``, ``latencies(pipeline, latency)``,
    ``accuracy(pipeline, route_accuracy)``: all with one row per pipeline.
    """
    joined = summary.join(latencies, "pipeline", "left").join(accuracy, "pipeline", "left")
    shown = F.when(F.col("pipeline") == routed,
                   F.concat(fixed_decimals(F.coalesce(F.col("route_accuracy"), F.lit(0.0)) * 100, 1), F.lit("%"))).otherwise("-")
    return joined.select(
        "pipeline", shown.alias("routing_accuracy"),
        *[format_metric(F.col(m)).alias(m) for m in metrics],
        format_metric(F.col("latency"), 2).alias("latency"))
