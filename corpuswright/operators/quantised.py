"""Dense top-k over product-quantised codes, rescored exactly.

A vector is cut into parts and each part is replaced by the number of its nearest
codeword, so a scan reads a few bytes a document instead of the vector. A task
adds up table entries for every question, keeps its best candidates, and only
these meet their vectors again. The corpus is scanned in place, never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sizing import BROADCAST_BYTES, measure
from .best import DIGITS, Best, id_array
from .dense import SCORES_PER_STEP, _matrix, finite_vectors
from .ordinals import top_k
from .selection import first_n

PARTS = 16
CODEWORDS = 256
TRAINING = 20_000  # rows the codewords are fitted on, the first of a seeded order: a documented bound
ROUNDS = 12
REFINE = 10        # candidates rescored per wanted hit
BYTES_PER_CANDIDATE = 64


def _nearest(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words ** 2).sum(axis=1) - 2 * rows @ words.T, axis=1)


def train_codewords(vectors: DataFrame, vector: str = "vector", *, parts: int = PARTS, codewords: int = CODEWORDS,
                    training: int = TRAINING, seed: int = 7) -> np.ndarray:
    """Codewords ``(parts, codewords, width / parts)`` by Lloyd rounds on at most ``training`` rows.

    Fewer rows than codewords give as many codewords as rows. The width must be a multiple of ``parts``.
    """
    rows = finite_vectors(vectors.select(vector), vector)
    sample = first_n(rows, training, [F.xxhash64(F.col(vector), F.lit(seed))]).toArrow()
    if not len(sample):
        return np.zeros((parts, 0, 0))
    data = _matrix(sample.column(0))
    data = data[np.lexsort(data.T)]  # the same start whatever the partitioning
    if data.shape[1] % parts:
        raise ValueError(f"width {data.shape[1]} is no multiple of {parts} parts")
    rng, width, out = np.random.default_rng(seed), data.shape[1] // parts, []
    for p in range(parts):
        piece = data[:, p * width:(p + 1) * width]
        words = piece[rng.permutation(len(piece))[:codewords]].copy()
        for _ in range(ROUNDS):
            near = _nearest(piece, words)
            count = np.bincount(near, minlength=len(words))
            sums = np.zeros_like(words)
            np.add.at(sums, near, piece)
            words[count > 0] = sums[count > 0] / count[count > 0, None]
        out.append(words)
    return np.stack(out)


def with_codes(vectors: DataFrame, codewords: np.ndarray, vector: str = "vector", out: str = "code") -> DataFrame:
    """Adds the codes of every finite vector, one byte a part; other rows go."""
    rows = finite_vectors(vectors, vector)
    schema = T.StructType(rows.schema.fields + [T.StructField(out, T.BinaryType())])
    place, parts = rows.columns.index(vector), len(codewords)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data = _matrix(batch.column(place))
            width = data.shape[1] // parts
            codes = np.stack([_nearest(data[:, p * width:(p + 1) * width], codewords[p]) for p in range(parts)], axis=1)
            packed = pa.array([row.tobytes() for row in codes.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], schema=to_arrow_schema(schema))

    return rows.mapInArrow(run, schema)


def quantised_topk(coded: DataFrame, queries: DataFrame, codewords: np.ndarray, k: int, *, refine: int = REFINE) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: the best ``k`` of the ``refine * k`` best candidates by code, with exact scores.

    ``coded(chunk_id, vector, code)``, ``queries(query_id, vector)``, measured to fit into a task. Ties go by id. A
    larger ``refine`` finds more of the exact hits; with ``refine * k`` at least the number of rows it finds all.
    """
    asked = finite_vectors(queries, "vector").select("query_id", "vector")
    if not measure(asked).fits():
        raise ValueError("questions are scanned in one go; ask them in blocks that fit into a task")
    table = asked.orderBy("query_id").toArrow()
    names, most = table.column("query_id").to_pylist(), refine * k
    out = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType),
                        T.StructField("chunk_id", coded.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())])
    schema = to_arrow_schema(out)
    matrix = _matrix(table.column("vector")) if names else np.zeros((0, 0))
    parts = len(codewords)
    width = matrix.shape[1] // parts if names else 0
    entries = [matrix[:, p * width:(p + 1) * width] @ codewords[p].T for p in range(parts)] if names else []
    shared = coded.sparkSession.sparkContext.broadcast((names, entries))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, entries = shared.value
        if not names:
            return
        best, every = Best(most, len(names)), np.arange(len(names))
        step = max(1, SCORES_PER_STEP // len(names))
        for batch in batches:
            ids = id_array(batch.column(0))
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(ids), -1)
            for at in range(0, len(ids), step):
                part = codes[at:at + step]
                scores = sum(entry[:, part[:, p]] for p, entry in enumerate(entries))
                best.offer_matrix(np.round(scores.T, DIGITS), every, ids[at:at + step])
        yield best.batch(names, schema)

    found = top_k(coded.select("chunk_id", "code").mapInArrow(scan, out), most, ["query_id"],
                  [F.col("score").desc(), F.col("chunk_id")]).select("query_id", "chunk_id")
    side = F.broadcast(found) if len(names) * most * BYTES_PER_CANDIDATE <= BROADCAST_BYTES else found
    exact = (coded.select("chunk_id", F.col("vector").alias("__d")).join(side, "chunk_id")
             .join(F.broadcast(asked.select("query_id", F.col("vector").alias("__q"))), "query_id"))
    product = F.aggregate(F.zip_with("__d", "__q", lambda d, q: d.cast("double") * q.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = exact.select("query_id", "chunk_id", F.round(product, DIGITS).alias("score"))
    return top_k(scored, k, ["query_id"], [F.col("score").desc(), F.col("chunk_id")])


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(wanted, found, recall)``: how many of the exact hits an approximate search returns."""
    hits = exact.select("query_id", "chunk_id").join(
        found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"),
                    F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))
