"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Every character ``str.strip`` and ``str.split`` treat as white space.
WHITE_SPACE = (" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
               "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
ANY_SPACE = f"[{WHITE_SPACE}]+"
TOKEN_BREAK = r"[^\p{L}0-9]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    Lambda bodies re-evaluate captured expressions per element; binding the
    value as a lambda variable avoids that.
    """
    return F.transform(F.array(value), body)[0]


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def norm_ws(c: Column | str) -> Column:
    """Trim, collapse runs of white space; null becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), ANY_SPACE, " "))


def nonblank(c: Column | str) -> Column:
    """The stripped text, or null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == F.lit("")


def null_if_nan(c: Column | str) -> Column:
    """Missing metrics arrive as NaN; aggregates must skip them."""
    return F.nullif(col(c).cast("double"), F.lit(float("nan")))


def run_starts(sorted_items: Column) -> Column:
    """1-based positions where a new value starts in a sorted array."""
    return F.when(
        F.size(sorted_items) > 0,
        F.filter(
            F.sequence(F.lit(1), F.size(sorted_items)),
            lambda i: (i == 1) | (sorted_items[i - 1] != sorted_items[F.greatest(i - 2, F.lit(0))]),
        ),
    ).otherwise(F.array().cast("array<int>"))


def run_end(starts: Column, position: Column, total: Column) -> Column:
    """Last position of the run that starts at ``starts[position]`` (0-based position)."""
    return F.coalesce(F.get(starts, position + 1) - 1, total)
