"""Routing, judging and the bounded retry."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.core import is_blank, strip
from ..functions.measures import covered_share, token_f1
from ..functions.routes import REJECT, TEXT, VISION
from ..functions.text import distinct_tokens
from ..session import materialise
from ..sizing import broadcast_if_small


def dispatch(rows: DataFrame, route: str, text: Callable[[DataFrame], DataFrame],
             vision: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Send VISION rows through one branch, all others through the other."""
    is_vision = F.coalesce(F.col(route) == VISION, F.lit(False))
    return text(rows.filter(~is_vision)).unionByName(vision(rows.filter(is_vision)))


def judge_route(text_answer: Column, vision_answer: Column, truth: Column, threshold: float = 0.5) -> Column:
    """TEXT when the text answer agrees with the truth, else VISION when the vision
    answer does, else REJECT. A missing truth or answer never agrees."""
    def agrees(answer: Column) -> Column:
        return F.coalesce(token_f1(answer, truth) >= threshold, F.lit(False)) & ~is_blank(truth)

    return F.when(agrees(text_answer), TEXT).when(agrees(vision_answer), VISION).otherwise(REJECT)


def known_route(label: Column) -> Column:
    """Judge labels outside the closed set count as REJECT."""
    upper = F.upper(strip(label))
    return F.when(upper.isin(TEXT, VISION), upper).otherwise(REJECT)


def critic_score(question: Column, answer: Column, threshold: float = 0.5,
                 sentinels: Sequence[str] = (fixed.NO_ANSWER, fixed.FAILED_ANSWER)) -> Column:
    """1.0 for an answer that covers the question, else 0.5."""
    poor = is_blank(answer) | strip(answer).isin(*sentinels)
    return F.when(F.coalesce(poor, F.lit(True)), 0.5).when(
        covered_share(question, answer) < threshold, 0.5).otherwise(1.0)


def read_score(raw: Column, fallback: float = 0.5) -> Column:
    """Score from a judge's text; unreadable text counts as the fallback."""
    return F.coalesce(strip(raw).try_cast("double"), F.lit(fallback))


def bounded_retry(questions: DataFrame, run_pass: Callable[[DataFrame, int], DataFrame], *, score: str = "score",
                  threshold: float = fixed.SCORE_TO_ACCEPT, max_passes: int = fixed.MAX_PASSES,
                  key: str = "query_id") -> DataFrame:
    """At most ``max_passes`` passes; rows below the threshold run again from routing.

    ``run_pass(questions, number)`` answers and scores; number counts from 1. Every
    pass is written once, so the next one starts from a table.
    """
    open_rows, accepted = questions, None
    for number in range(1, max_passes + 1):
        done = run_pass(open_rows, number).withColumn("retry_count", F.lit(number).cast("bigint"))
        if number < max_passes:
            done = materialise(done, "retry-pass")
            poor = F.coalesce(F.col(score) < threshold, F.lit(True))
            keep, again = done.filter(~poor), done.filter(poor)
        else:
            keep, again = done, None
        accepted = keep if accepted is None else accepted.unionByName(keep)
        if again is None or again.isEmpty():
            break
        open_rows = questions.join(again.select(key), key, "left_semi")
    return accepted


def three_way_wide(rows: DataFrame, route: str = "route_pred") -> DataFrame:
    """Routed answer, contexts and latency next to the text and the vision ones."""
    from .joins import choose_by_route

    return choose_by_route(rows, route, {
        "routed_answer": ("text_answer", "vision_answer"),
        "routed_contexts": ("text_contexts", "vision_contexts"),
        "routed_latency": ("text_latency", "vision_latency"),
    })


def three_way_long(wide: DataFrame, keep: Sequence[str],
                   names: Sequence[str] = ("always_text", "always_vision", "routed")) -> DataFrame:
    """One row per question and pipeline, from the wide form in one pass."""
    arms = F.array(*[
        F.struct(F.lit(name).alias("pipeline"), F.col(f"{arm}_answer").alias("answer"),
                 F.col(f"{arm}_contexts").alias("contexts"), F.col(f"{arm}_latency").alias("latency"))
        for name, arm in zip(names, ("text", "vision", "routed"))])
    return wide.select(*keep, F.inline(arms))


def agent_benchmark(parts: Sequence[DataFrame], per_part: int | None, order: str,
                    run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Questions of all parts (optionally the first ``per_part`` of each), alternate key
    names resolved, through the agent ``run``; keeps question, truth, answer, contexts.
    Blank questions are not asked."""
    from .sampling import concat_datasets, head_sample

    def resolved(part: DataFrame) -> DataFrame:
        def either(*names: str) -> Column:
            present = [F.col(n) for n in names if n in part.columns]
            return F.coalesce(*present, F.lit(""))

        chosen = part if per_part is None else head_sample(part, per_part, [order])
        return chosen.select(F.col(order).alias("query_id"),
                             either("question", "query").alias("question"),
                             either("ground_truth", "answer").alias("ground_truth")).filter(F.trim("question") != "")

    return run(concat_datasets([resolved(p) for p in parts], "part"))


MICRO = 1_000_000  # weights are whole millionths, so sums do not depend on their order


@dataclass(frozen=True)
class Router:
    """``weights(token, weight)`` and the prior of a two-class router, in millionths of a natural logarithm."""

    weights: DataFrame
    prior: int


def train_router(rows: DataFrame, text: str, is_vision: Column, *, min_rows: int = 1) -> Router:
    """Two-class router in closed form: smoothed log ratios of the rows that hold a token.

    A token weighs ``ln((v + 1) / (V + 2)) - ln((t + 1) / (T + 2))`` where ``v`` of ``V`` VISION rows and ``t`` of ``T``
    TEXT rows hold it; tokens that fewer than ``min_rows`` rows hold are left out. Two aggregates make
    the model; nothing is iterated or collected but the class sizes.
    """
    labelled = rows.select(F.coalesce(is_vision, F.lit(False)).alias("v"), distinct_tokens(text).alias("ts"))
    sizes = labelled.agg(F.count(F.when(F.col("v"), 1)).alias("v"), F.count(F.when(~F.col("v"), 1)).alias("t")).first()
    held = labelled.select("v", F.explode("ts").alias("token")).groupBy("token").agg(
        F.count(F.when(F.col("v"), 1)).alias("v"), F.count(F.when(~F.col("v"), 1)).alias("t"))

    def ratio(part: Column, whole: int) -> Column:
        return F.log((part + 1.0) / F.lit(whole + 2.0))

    weight = F.round((ratio(F.col("v"), sizes["v"]) - ratio(F.col("t"), sizes["t"])) * MICRO).cast("bigint")
    weights = held.filter(F.col("v") + F.col("t") >= min_rows).select("token", weight.alias("weight"))
    return Router(materialise(weights, "router"), round(MICRO * (math.log(sizes["v"] + 1.0) - math.log(sizes["t"] + 1.0))))


def predicted_route(model: Router, rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """Adds ``route_score`` (prior plus the weights of the distinct tokens) and ``route_pred``: VISION above 0.

    ``row_id`` identifies a row. Tokens are added up map-side, so a common token costs one sum a row.
    """
    held = rows.select(F.col(row_id).alias("__id"), F.explode(distinct_tokens(text)).alias("token"))
    sums = held.join(broadcast_if_small(model.weights), "token").groupBy("__id").agg(F.sum("weight").alias("__sum"))
    score = F.lit(model.prior) + F.coalesce("__sum", F.lit(0))
    out = rows.join(sums, F.col(row_id) == F.col("__id"), "left").withColumn("route_score", score.cast("bigint"))
    return out.withColumn("route_pred", F.when(F.col("route_score") > 0, VISION).otherwise(TEXT)).drop("__id", "__sum")
