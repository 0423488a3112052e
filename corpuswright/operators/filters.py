"""Row predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.core import is_blank, null_if_nan, strip


def verified(question: Column, required: Sequence[Column], min_length: int = 5) -> Column:
    """Required values present and the question longer than ``min_length``."""
    keep = question.isNotNull() & (F.length(question) > min_length)
    for value in required:
        keep = keep & value.isNotNull()
    return F.coalesce(keep, F.lit(False))


def verify_counts(df: DataFrame, keep: Column) -> DataFrame:
    """Accepted and rejected rows, one row."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(keep).alias("accepted"),
                  F.count_if(~keep).alias("rejected"))


def complete(*columns: Column) -> Column:
    """All values non-blank after trimming."""
    keep = F.lit(True)
    for column in columns:
        keep = keep & ~is_blank(column)
    return keep


def keep_labels(df: DataFrame, route: str, labels: Sequence[str] = ("TEXT", "VISION")) -> DataFrame:
    return df.filter(F.col(route).isin(*labels))


def has_error(*answers: Column, marks: Sequence[str] = fixed.ERROR_MARKS) -> Column:
    """Any answer holds an error mark; a missing answer counts as no error."""
    found = F.lit(False)
    for answer in answers:
        for mark in marks:
            found = found | F.coalesce(answer.contains(mark), F.lit(False))
    return found


def needs_ocr(page_text: Column, n: int = fixed.LOW_TEXT_LENGTH) -> Column:
    return F.length(strip(F.coalesce(page_text, F.lit("")))) < n


def file_matches(name: Column, extensions: Sequence[str], excluded: str | None = None) -> Column:
    """Extension test without regard to case; ``excluded`` is a pattern on the name."""
    lower = F.lower(name)
    keep = F.lit(False)
    for extension in extensions:
        keep = keep | lower.endswith(extension)
    return keep if excluded is None else keep & ~name.rlike(excluded)


def on_or_after(date: Column, limit: Column, pinned: Column) -> Column:
    """Pinned rows stay; others only from the limit date on."""
    return F.coalesce(pinned, F.lit(False)) | F.coalesce(date >= limit, F.lit(False))


def drop_unscored(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Rows with every metric present; NaN counts as missing."""
    return df.withColumns({m: null_if_nan(m) for m in metrics}).na.drop(subset=list(metrics))


def evaluable(question: Column, truth: Column) -> Column:
    """``ok``, ``no_question`` or ``no_truth``, the question being checked first."""
    return (F.when(is_blank(question), "no_question").when(is_blank(truth), "no_truth").otherwise("ok"))


def length_violations(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows a store would refuse, with the names of the offending columns.

    Store limits count bytes of UTF-8.
    """
    names = F.array_compact(F.array(*[
        F.when(F.octet_length(F.col(c)) > n, F.lit(c)) for c, n in sorted(limits.items())]))
    return df.withColumn("offending", names).filter(F.size("offending") > 0)
