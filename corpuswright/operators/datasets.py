"""Labelled datasets: balancing, formatting, completing, comparing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.routes import TEXT, VISION, other_route
from ..functions.text import inject_cue
from .filters import complete
from .ordinals import with_ordinal
from .sampling import renumber

ROUTER_INSTRUCTION = "Decide whether the question needs TEXT or VISION retrieval. Answer with one word."


def balance_routes(df: DataFrame, *, question: str, route: str, order: Sequence[Column], pick: Column,
                   cues: Sequence[str]) -> DataFrame:
    """Bring VISION to half of all rows: the first TEXT rows in ``order`` are converted,
    every VISION row gets a visual cue. No row is converted when VISION already has
    half; rows of other routes count in the total and are dropped."""
    upper = F.upper(F.col(route))
    total, vision = df.agg(F.count(F.lit(1)), F.count_if(upper == VISION)).first()
    needed = max(0, total // 2 - vision)
    rows = df.withColumn(route, upper).filter(F.col(route).isin(TEXT, VISION))
    numbered = with_ordinal(rows, "__position", order, [F.col(route)])
    converted = (F.col(route) == VISION) | (F.col("__position") <= needed)
    return numbered.withColumns({
        question: F.when(converted, inject_cue(F.col(question), pick, cues)).otherwise(F.col(question)),
        route: F.when(converted, VISION).otherwise(TEXT),
    }).drop("__position")


def sft_rows(question: Column, route: Column, *, instruction: str = ROUTER_INSTRUCTION,
             prefix: str = fixed.QUESTION_PREFIX) -> dict[str, Column]:
    return {"instruction": F.lit(instruction), "input": F.concat(F.lit(prefix), question),
            "output": F.upper(route)}


def preference_pairs(prompt: Column, route: Column) -> dict[str, Column]:
    """Prompt, chosen label and the other label as rejected."""
    return {"prompt": prompt, "chosen": route, "rejected": other_route(route)}


def complete_testset(parts: Sequence[DataFrame], order: str) -> DataFrame:
    """Union of the parts in order, incomplete rows dropped, dense new ids from 0."""
    rows = None
    for i, part in enumerate(parts):
        numbered = part.select(F.lit(i).alias("__part"), order, "question", "ground_truth", "context_used")
        rows = numbered if rows is None else rows.unionByName(numbered)
    kept = rows.filter(complete(F.col("question"), F.col("ground_truth"), F.col("context_used")))
    return renumber(kept, "id", [F.col("__part"), F.col(order)]).select(
        "id", "question", "ground_truth", "context_used")


def compare_dataset(questions: DataFrame, answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions with both answers and the distinct retrieved sources (bounded by the
    search's ``final_k``)."""
    sources = hits.groupBy("query_id").agg(F.sort_array(F.collect_set("source")).alias("retrieved_sources"))
    return (questions.join(answers, "query_id").join(sources, "query_id", "left")
            .withColumn("retrieved_sources", F.coalesce("retrieved_sources", F.array().cast("array<string>"))))


def qa_seed_text(chunks: Column, layout: str = "[%d] ") -> Column:
    """Numbered chunks of one document as one text, built inside the row."""
    return F.array_join(F.transform(
        chunks, lambda c, i: F.concat(F.format_string(layout, i + 1), c)), "\n\n")
