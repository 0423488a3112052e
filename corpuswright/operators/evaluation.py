"""Evaluation measures over datasets ``(question, answer, ground_truth, contexts)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import measures
from ..functions.contexts import fill_answer, fill_contexts, fill_truth
from .joins import reverse_eval_pairs
from .ordinals import with_ordinal

MEASURES = ("token_f1", "answer_support", "context_recall_lex", "context_ap", "question_answer_cosine")


def with_measures(df: DataFrame, names: tuple[str, ...] = MEASURES) -> DataFrame:
    """All lexical measures in one pass over the rows; nothing is shuffled."""
    question, answer = F.col("question"), F.col("answer")
    truth, contexts = F.col("ground_truth"), F.col("contexts")
    formulas = {
        "token_f1": lambda: measures.token_f1(answer, truth),
        "answer_support": lambda: measures.answer_support(answer, contexts),
        "context_recall_lex": lambda: measures.context_recall_lex(truth, contexts),
        "context_ap": lambda: measures.context_ap(truth, contexts),
        "question_answer_cosine": lambda: measures.question_answer_cosine(question, answer),
    }
    return df.withColumns({n: formulas[n]() for n in names})


def fill_eval_defaults(df: DataFrame) -> DataFrame:
    """Empty answers, contexts and truths get their placeholder; alternate names are
    ``generated_answer`` and ``retrieved_contexts``."""
    def maybe(name: str, dtype: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(dtype)

    return df.withColumns({
        "answer": fill_answer(maybe("answer", "string"), maybe("generated_answer", "string")),
        "contexts": fill_contexts(maybe("contexts", "array<string>"), maybe("retrieved_contexts", "array<string>")),
        "ground_truth": fill_truth(maybe("ground_truth", "string")),
    })


def reverse_eval(vision: DataFrame, text: DataFrame, key: str) -> DataFrame:
    """The measures with the vision answer as the truth, for both reverse datasets."""
    against_text, against_truth = reverse_eval_pairs(vision, text, key)
    return with_measures(against_text.withColumn("dataset", F.lit("text_answer"))).unionByName(
        with_measures(against_truth.withColumn("dataset", F.lit("original_truth"))))


def session_history(messages: DataFrame, session: str, order: list[Column]) -> DataFrame:
    """Messages of every session with their position; long sessions spread over tasks."""
    return with_ordinal(messages, "position", order, [F.col(session)])


def join_chunks(pieces: DataFrame, session: str, seq: str, text: str, *, end: Column | None = None,
                separator: str = "", per_block: int = 256) -> DataFrame:
    """Reassemble streamed answer pieces per session, up to the first end mark.

    Pieces are joined in blocks first, then the blocks, so no task collects more
    than ``per_block`` raw pieces of a session at a time.
    """
    rows = pieces
    if end is not None:
        stops = rows.filter(end).groupBy(session).agg(F.min(seq).alias("__stop"))
        rows = (rows.join(stops, session, "left")
                .filter(F.col("__stop").isNull() | (F.col(seq) < F.col("__stop"))).drop("__stop"))
    blocked = rows.withColumn("__block", F.floor(F.col(seq) / F.lit(per_block)))

    def joined(at: str, value: str) -> Column:
        parts = F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("value"))))
        return F.array_join(F.transform(parts, lambda p: p["value"]), separator)

    return (blocked.groupBy(session, "__block").agg(joined(seq, text).alias("__part"),
                                                    F.count(F.lit(1)).alias("__pieces"))
            .groupBy(session).agg(joined("__block", "__part").alias("answer"),
                                  F.sum("__pieces").alias("pieces")))
