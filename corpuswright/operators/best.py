"""Running best ``k`` items per query inside one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

DIGITS = 6


def _places(groups: np.ndarray) -> np.ndarray:
    """Position of every row within its run of equal (sorted) groups, from 0."""
    starts = np.r_[0, np.flatnonzero(np.diff(groups)) + 1] if len(groups) else np.array([], dtype="int64")
    lengths = np.diff(np.r_[starts, len(groups)])
    return np.arange(len(groups)) - np.repeat(starts, lengths)


class Best:
    """Keeps, per query, the ``k`` highest scores; equal scores go by item id.

    The state is bounded by queries times ``k``, whatever the task reads.
    """

    def __init__(self, k: int, queries: int):
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.q = np.array([], dtype="int64")
        self.score = np.array([], dtype="float64")
        self.ids: np.ndarray | None = None

    def offer(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, item: np.ndarray) -> None:
        """Triples (query, score, ``ids[item]``)."""
        keep = score >= self.floor[q]
        q, score, item = q[keep], score[keep], item[keep]
        if not len(q):
            return
        order = np.lexsort((-score, q))
        q, score, item = q[order], score[order], item[order]
        # Cut by score alone, ties at the edge included, before ids are compared.
        last = np.flatnonzero(_places(q) == self.k - 1)
        edge = np.full(len(self.floor), -np.inf)
        edge[q[last]] = score[last]
        keep = score >= edge[q]
        q, score, fresh = q[keep], score[keep], ids[item[keep]]
        if self.ids is not None:
            q, score = np.r_[self.q, q], np.r_[self.score, score]
            fresh = np.concatenate([self.ids, fresh])
        order = np.lexsort((fresh, -score, q))
        q, score, fresh = q[order], score[order], fresh[order]
        place = _places(q)
        keep = place < self.k
        self.q, self.score, self.ids = q[keep], score[keep], fresh[keep]
        full = place[keep] == self.k - 1
        self.floor[self.q[full]] = self.score[full]

    def offer_matrix(self, scores: np.ndarray, columns: np.ndarray, ids: np.ndarray) -> None:
        """One row of ``scores`` per id, one column per query number in ``columns``."""
        limit = self.floor[columns]
        if len(ids) > self.k:
            limit = np.maximum(limit, np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k])
        item, column = np.nonzero(scores >= limit)
        self.offer(columns[column], scores[item, column], ids, item)

    def batch(self, names: list, schema: pa.Schema) -> pa.RecordBatch:
        ids = [] if self.ids is None else self.ids.tolist()
        return pa.RecordBatch.from_arrays([
            pa.array([names[i] for i in self.q], type=schema.field(0).type),
            pa.array(ids, type=schema.field(1).type),
            pa.array(self.score, type=pa.float64())], schema=schema)


def id_array(column: pa.Array) -> np.ndarray:
    """Ids as a sortable numpy array."""
    return np.array(column.to_pylist())
