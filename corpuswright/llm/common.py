"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise, shared_folder
from ..sizing import BROADCAST_BYTES, measure

SPACES = r"[ \t-\r]+"  # the white space that parts words: space and U+0009 to U+000D


def text_rows(docs: DataFrame, *others: str) -> DataFrame:
    """``doc_id`` (long), ``text`` (null: empty) and the ``others``; all other columns go."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"), *others)


def words(text: Column) -> Column:
    """Words between white space, in order; none for an empty text."""
    return F.array_remove(F.split(text, SPACES), "")


def window_hashes(df: DataFrame, array: str, k: int, out: str) -> DataFrame:
    """Adds ``out``: the 64-bit hash of every window of ``k`` (1 to 5) items of ``array``, in order.

    Pairs of items are hashed, then pairs of pairs: a fixed number of passes over
    each array, with no random access. Fewer than ``k`` items give an empty array.
    """
    df = df.withColumn("_h1", F.transform(array, lambda x: F.xxhash64(x)))
    step = lambda a, b, shift: (f"zip_with({a}, slice({b}, {shift + 1}, greatest(size({b}) - {shift}, 0)),"
                                " (x, y) -> xxhash64(x, y))")
    if k >= 2:
        df = df.withColumn("_h2", F.expr(step("_h1", "_h1", 1)))
    chain = {1: "_h1", 2: "_h2", 3: step("_h2", "_h1", 2), 4: step("_h2", "_h2", 2)}
    chain[5] = step(chain[4], "_h1", 4)
    df = df.withColumn(out, F.expr(f"slice({chain[k]}, 1, greatest(size(_h1) - {k - 1}, 0))"))
    return df.drop("_h1", "_h2")


def join_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The small side of a join: a broadcast where its measured size allows it, else Spark's choice."""
    return F.broadcast(df) if measure(df).fits(limit) else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the folder that all executors share."""
    return materialise(df, f"llm-{name}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def kept_in_process(name: str, make: Callable[[], object]) -> object:
    """The object a worker process made under ``name`` before, so that its next task finds the caches warm."""
    import sys
    import types
    shelf = sys.modules.setdefault("_corpuswright_kept", types.ModuleType("_corpuswright_kept"))
    if not hasattr(shelf, name):
        setattr(shelf, name, make())
    return getattr(shelf, name)


def releasing(run: Callable) -> Callable:
    """The task ``run``, which gives the memory Arrow holds but does not use back at its end: the worker process stays and takes other tasks."""
    def task(batches):
        import pyarrow as pa
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
    return task


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the rows ``(a, b)``: ``node``, ``component`` (its smallest node).

    Each round every node takes the smallest label around it and then that
    label's own label, so long chains shorten geometrically. Labels are written
    to the shared folder each round; only the count of changes reaches the
    driver. Nulls and self-links are dropped; no edges give no rows.
    """
    both = stored(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct()
                  .toDF("node", "near"), "links")
    labels = stored(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("component")), "labels")
    for _ in range(rounds):
        around = (both.join(labels.toDF("near", "other"), "near").groupBy("node").agg(F.min("other").alias("other")))
        step = labels.join(around, "node", "left").select(
            "node", "component", F.least("component", "other").alias("hop"))
        jump = step.join(labels.toDF("hop", "far"), "hop", "left").select(
            "node", F.least("hop", F.coalesce("far", "hop")).alias("next"), "component")
        after = stored(jump, "labels")
        changed = after.where("next <> component").limit(1).count()
        labels = after.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")


__all__ = ["SPACES", "text_rows", "words", "window_hashes", "join_side", "stored", "fresh", "kept_in_process", "releasing", "mix", "components", "shared_folder"]
