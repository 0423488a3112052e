"""Lexical answer and context measures, each computed inside the row.

They are reproducible stand-ins for model-graded scores and carry their own
names so nobody mistakes one for the other.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .core import let
from .text import distinct_tokens, numbered_tokens, token_counts

SCORE_DIGITS = 6


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def token_f1(answer: Column, truth: Column) -> Column:
    """Multiset token F1."""
    def score(a: Column, t: Column) -> Column:
        common = F.size(F.array_intersect(a, t))
        return F.round(_ratio(2 * common, F.size(a) + F.size(t)), SCORE_DIGITS)

    return let(numbered_tokens(answer), lambda a: let(numbered_tokens(truth), lambda t: score(a, t)))


def covered_share(wanted: Column, present: Column) -> Column:
    """Share of the distinct tokens of ``wanted`` that occur in ``present``; 0 if there are none."""
    return let(distinct_tokens(wanted), lambda w: covered_of(w, distinct_tokens(present)))


def covered_of(wanted: Column, present: Column) -> Column:
    """``covered_share`` of lists of distinct tokens."""
    return F.round(_ratio(F.size(F.array_intersect(wanted, present)), F.size(wanted)), SCORE_DIGITS)


def answer_support(answer: Column, contexts: Column) -> Column:
    return covered_share(answer, F.array_join(contexts, "\n"))


def context_recall_lex(truth: Column, contexts: Column) -> Column:
    return covered_share(truth, F.array_join(contexts, "\n"))


def average_precision(relevant: Column) -> Column:
    """Sum of precision at the relevant positions over their number, from ``array<boolean>``."""
    start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("hits"), F.lit(0.0).alias("total"))

    def step(state: Column, flag: Column) -> Column:
        seen = state["seen"] + 1
        hits = state["hits"] + F.when(flag, 1).otherwise(0)
        gain = F.when(flag, hits.cast("double") / seen).otherwise(F.lit(0.0))
        return F.struct(seen.alias("seen"), hits.alias("hits"), (state["total"] + gain).alias("total"))

    return F.aggregate(relevant, start, step,
                       lambda s: F.round(_ratio(s["total"], s["hits"]), SCORE_DIGITS))


def context_ap(truth: Column, contexts: Column, threshold: float = 0.5) -> Column:
    """Average precision where a context counts when it covers enough of the truth."""
    def relevant(wanted: Column) -> Column:
        return F.transform(contexts, lambda c: _ratio(
            F.size(F.array_intersect(wanted, distinct_tokens(c))), F.size(wanted)) >= threshold)

    return let(distinct_tokens(truth), lambda w: average_precision(relevant(w)))


def _norm(counts: Column) -> Column:
    return F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x["tf"] * x["tf"]))


def question_answer_cosine(question: Column, answer: Column) -> Column:
    """Cosine of the raw term-frequency vectors.

    Both count lists go into one sorted list, where equal tokens are adjacent;
    one pass multiplies the neighbours.
    """
    def tagged(counts: Column) -> Column:
        return F.transform(counts, lambda x: F.struct(x["token"].alias("token"), x["tf"].alias("tf")))

    def dot(q: Column, a: Column) -> Column:
        merged = F.sort_array(F.concat(tagged(q), tagged(a)))
        start = F.struct(F.lit("").alias("token"), F.lit(0).cast("bigint").alias("tf"),
                         F.lit(0.0).alias("total"))

        def step(state: Column, x: Column) -> Column:
            gain = F.when(state["token"] == x["token"], (state["tf"] * x["tf"]).cast("double"))
            return F.struct(x["token"].alias("token"), x["tf"].alias("tf"),
                            (state["total"] + F.coalesce(gain, F.lit(0.0))).alias("total"))

        return F.aggregate(merged, start, step, lambda s: s["total"])

    return let(token_counts(question), lambda q: let(token_counts(answer), lambda a: F.round(
        _ratio(dot(q, a), _norm(q) * _norm(a)), SCORE_DIGITS)))
