"""Dense top-k: exact, cell-pruned and progressive-width search.

Scores come from one matrix product per Arrow batch; a task keeps only the best
``k`` per query, so query-document pairs never become rows. A measured question
set goes to every task; a larger one is cut into blocks that meet blocks of
documents in co-grouped tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vectors import is_finite, prefix_l2
from ..session import materialise
from ..sizing import BROADCAST_BYTES, Measured, broadcast_if_small, measure
from .best import DIGITS, Best, id_array
from .ordinals import top_k

SCORES_PER_STEP = 4_000_000
BLOCK_BYTES = 32 * 1024 * 1024


def finite_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is complete and finite."""
    return df.filter(is_finite(F.col(vector)))


def _matrix(vectors: pa.Array) -> np.ndarray:
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    widths = pc.unique(pc.list_value_length(lists))
    if len(widths) > 1:
        raise ValueError(f"vectors of one collection need one width, found {widths.to_pylist()}")
    values = lists.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return values.reshape(len(lists), -1)


def _score_into(best: Best, ids: np.ndarray, docs: np.ndarray, queries: np.ndarray, columns: np.ndarray) -> None:
    step = max(1, SCORES_PER_STEP // max(1, len(columns)))
    for at in range(0, len(ids), step):
        scores = np.round(docs[at:at + step] @ queries[columns].T, DIGITS)
        best.offer_matrix(scores, columns, ids[at:at + step])


def _scan(docs: DataFrame, queries: DataFrame, k: int, out: T.StructType, arrow_schema: pa.Schema) -> DataFrame:
    """One pass over the documents with the whole (measured) question set in every task."""
    collected = queries.toArrow()
    names = collected.column("query_id").to_pylist()
    cells = np.array(collected.column("cell").to_pylist(), dtype="int64")
    shared = docs.sparkSession.sparkContext.broadcast(
        (names, cells, _matrix(collected.column("vector")) if names else None))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, query_cells, matrix = shared.value
        if not names:
            return
        by_cell = {c: np.flatnonzero(query_cells == c) for c in np.unique(query_cells)}
        best = Best(k, len(names))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = id_array(batch.column("chunk_id"))
            vectors = _matrix(batch.column("vector"))
            doc_cells = np.array(batch.column("cell").to_pylist(), dtype="int64")
            for cell in np.unique(doc_cells):
                columns = by_cell.get(cell)
                if columns is not None:
                    rows = np.flatnonzero(doc_cells == cell)
                    _score_into(best, ids[rows], vectors[rows], matrix, columns)
        yield best.batch(names, arrow_schema)

    return docs.mapInArrow(scan, out)


def _blocks(df: DataFrame, size: Measured, key: str) -> tuple[DataFrame, DataFrame]:
    """Cut every cell into hash blocks of bounded bytes; also return the blocks per cell."""
    row_bytes = max(1, size.bytes // max(1, size.rows))
    per_block = max(1, BLOCK_BYTES // row_bytes)
    blocks = df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(per_block)).cast("int").alias("blocks"))
    blocks = broadcast_if_small(blocks)
    cut = df.join(blocks, "cell").withColumn(
        "block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).drop("blocks")
    return cut, blocks


def _grid(docs: DataFrame, queries: DataFrame, k: int, out: T.StructType, arrow_schema: pa.Schema) -> DataFrame:
    """Blocks of documents meet blocks of queries, cell by cell; every task holds one
    block of each, however large a cell is."""
    doc_cut, doc_blocks = _blocks(docs, measure(docs), "chunk_id")
    query_cut, query_blocks = _blocks(queries, measure(queries), "query_id")
    doc_side = (doc_cut.withColumnRenamed("block", "db").join(query_blocks, "cell")
                .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"))
    query_side = (query_cut.withColumnRenamed("block", "qb").join(doc_blocks, "cell")
                  .withColumn("db", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = right.column("query_id").to_pylist()
        best = Best(k, len(names))
        if left.num_rows and names:
            _score_into(best, id_array(left.column("chunk_id")), _matrix(left.column("vector")),
                        _matrix(right.column("vector")), np.arange(len(names)))
        return pa.Table.from_batches([best.batch(names, arrow_schema)])

    keys = ["cell", "db", "qb"]
    return doc_side.groupBy(*keys).cogroup(query_side.groupBy(*keys)).applyInArrow(meet, out)


def vector_topk(docs: DataFrame, queries: DataFrame, k: int, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Best ``k`` documents per query by inner product, within equal ``cell``.

    ``docs(chunk_id, vector, cell)`` and ``queries(query_id, vector, cell)``; a
    query that probes several cells comes once per cell. Returns
    ``(query_id, chunk_id, score, rank)``, ties by id.
    """
    docs = docs.select("chunk_id", "vector", F.col("cell").cast("bigint").alias("cell"))
    queries = queries.select("query_id", "vector", F.col("cell").cast("bigint").alias("cell"))
    out = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("chunk_id", docs.schema["chunk_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    small = measure(queries).fits(broadcast_bytes)
    parts = (_scan if small else _grid)(docs, queries, k, out, to_arrow_schema(out))
    return top_k(parts, k, ["query_id"], [F.col("score").desc(), F.col("chunk_id")])


def dense_topk(docs: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    """Exact inner-product top-k over ``docs(chunk_id, vector)``; broken vectors are dropped."""
    return vector_topk(finite_vectors(docs, "vector").withColumn("cell", F.lit(0)),
                       finite_vectors(queries, "vector").withColumn("cell", F.lit(0)), k, **options)


def train_cells(vectors: DataFrame, vector: str, cells: int = 128, seed: int = 42,
                max_rounds: int = 10, train_share: float | None = None) -> tuple[DataFrame, DataFrame]:
    """K-means cells: the vectors with a ``cell`` column, and the centroids ``(cell, centroid)``.

    ``train_share`` fits the centroids on a seeded share of the rows; every row
    gets its cell either way.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    featured = vectors.withColumn("__features", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=cells, seed=seed, maxIter=max_rounds, featuresCol="__features",
                   predictionCol="cell").fit(
        featured if train_share is None else featured.sample(train_share, seed))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centroids = vectors.sparkSession.createDataFrame(rows, "cell bigint, centroid array<double>")
    placed = model.transform(featured).drop("__features").withColumn("cell", F.col("cell").cast("bigint"))
    return placed, centroids


def mean_vectors(vectors: DataFrame, group: str, vector: str, dims: int) -> DataFrame:
    """Component means per group, summed map-side."""
    means = F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(dims)])
    return vectors.groupBy(group).agg(means.alias("centroid"))


def probe_cells(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """One row per query and probed cell: the ``nprobe`` centroids with the largest product."""
    nearest = dense_topk(centroids.select(F.col("cell").alias("chunk_id"), F.col("centroid").alias("vector")),
                         queries, nprobe)
    return nearest.select("query_id", F.col("chunk_id").alias("cell")).join(
        queries.select("query_id", "vector"), "query_id")


def probed(queries: DataFrame, centroids: DataFrame, nprobe: int) -> list[int]:
    """All cells any query probes, at most as many as there are centroids."""
    probes = probe_cells(finite_vectors(queries, "vector"), centroids, nprobe)
    return sorted(r["cell"] for r in probes.select("cell").distinct().collect() if r["cell"] is not None)


def ivf_topk(docs: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, nprobe: int = 10,
             **options) -> DataFrame:
    """Top-k inside the ``nprobe`` nearest cells; ``docs(chunk_id, vector, cell)``.

    Documents of cells nobody probes are left out by a literal filter, so on a
    collection stored by cell their folders are not read. The cells are read to
    the driver: at most as many as there are centroids, which were broadcast before.
    """
    probes = materialise(probe_cells(finite_vectors(queries, "vector"), centroids, nprobe), "probes")
    wanted = sorted(r["cell"] for r in probes.select("cell").distinct().collect() if r["cell"] is not None)
    return vector_topk(finite_vectors(docs.filter(F.col("cell").isin(wanted)), "vector"), probes, k, **options)


def progressive_search(docs: DataFrame, queries: DataFrame, stages: list[tuple[int, int]], first_k: int = 100, *,
                       centroids: DataFrame | None = None, nprobe: int = 10) -> DataFrame:
    """Full-width top ``first_k``, then per stage ``(dims, keep)`` the nearest by L2 on
    the first ``dims`` components. Returns the last stage's ``(query_id, chunk_id, distance, rank)``.

    With ``centroids`` the first stage looks into the ``nprobe`` nearest cells of ``docs(.., cell)`` only, and the
    later stages read the folders of probed cells alone."""
    if centroids is None:
        hits = dense_topk(docs, queries, first_k)
    else:
        docs = docs.filter(F.col("cell").isin(probed(queries, centroids, nprobe)))
        hits = ivf_topk(docs, queries, centroids, first_k, nprobe)
    hits = hits.select("query_id", "chunk_id")
    bound = measure(queries).rows * first_k * 64
    small = F.broadcast(hits) if bound <= BROADCAST_BYTES else hits
    current = (docs.select("chunk_id", F.col("vector").alias("__d")).join(small, "chunk_id")
               .join(queries.select("query_id", F.col("vector").alias("__q")), "query_id"))
    for dims, keep in stages:
        current = top_k(
            current.withColumn("distance", F.round(prefix_l2(F.col("__q"), F.col("__d"), dims), DIGITS)),
            keep, ["query_id"], [F.col("distance"), F.col("chunk_id")])
    return current.select("query_id", "chunk_id", "distance", "rank")


def embed(df: DataFrame, embedder, text: str, out: str = "vector") -> DataFrame:
    """Embedder hook: ``embedder()`` builds, once per task, a function from a pandas
    Series of texts to a list of vectors."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = embedder()
        for frame in frames:
            yield frame.assign(**{out: list(encode(frame[text]))})

    return df.mapInPandas(run, schema)


