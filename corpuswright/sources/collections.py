"""Stored collections: texts, postings and vectors behind one manifest.

Every batch is a segment: folders of its own under each table, written in full
before one row of the manifest names it. The manifest is a table of versions; a row
is one file that appears at once when its job commits. Readers take the newest version
and only the segments it names, so half a write is never seen, an older
version stays readable, and a batch that failed can simply run again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.utils import AnalysisException

from .. import fixed
from ..operators import dense, inverted
from ..operators.filters import length_violations
from ..functions.text import tokens
from ..operators.lexical import CorpusStats

SEGMENT = ("array<struct<name:string,documents:bigint,rejected:bigint,shards:int,vectors:bigint,tokens:bigint>>")
MANIFEST = (f"version bigint, segments {SEGMENT}, buckets int, mean_length double, drop_ratio double, cells int,"
            " texts_schema string, vectors_schema string")
BUCKET_TOKENS = 1 << 24  # tokens of the first batch to a bucket
FEWEST_BUCKETS, MOST_BUCKETS = 16, 4096


@dataclass(frozen=True)
class Report:
    """What one batch did: the version it made, rows stored and rejected, vectors stored."""

    version: int
    segment: str
    documents: int
    rejected: int
    vectors: int


class Collection:
    """One version of a stored collection."""

    def __init__(self, spark: SparkSession, path: str, manifest):
        self.spark, self.path, self.manifest = spark, path, manifest
        self.version = manifest["version"]

    def _table(self, name: str, schema: str | T.StructType, some: Column | None = None) -> DataFrame:
        """The rows of the named segments; folders of other segments are pruned by the partition column."""
        kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        rows = self.spark.read.schema(T.StructType([*kinds.fields, T.StructField("segment", T.StringType())])).parquet(
            f"{self.path}/{name}")
        return rows.filter(F.col("segment").isin([s["name"] for s in self.manifest["segments"]])).drop("segment")

    @property
    def texts(self) -> DataFrame:
        """The stored chunks with all their columns."""
        return self._table("texts", self._texts_schema()).drop("shard", "place", "length")

    def _texts_schema(self) -> T.StructType:
        import json
        return T.StructType.fromJson(json.loads(self.manifest["texts_schema"]))

    @property
    def vectors(self) -> DataFrame | None:
        """``chunk_id, vector, cell`` of the chunks that have one, one folder per cell."""
        if self.manifest["vectors_schema"] is None:
            return None
        import json
        return self._table("vectors", T.StructType.fromJson(json.loads(self.manifest["vectors_schema"])))

    @property
    def centroids(self) -> DataFrame | None:
        if self.manifest["vectors_schema"] is None:
            return None
        return self.spark.read.schema("cell bigint, centroid array<double>").parquet(f"{self.path}/centroids")

    @property
    def documents(self) -> int:
        return sum(s["documents"] for s in self.manifest["segments"])

    @cached_property
    def index(self) -> inverted.Index:
        texts = self._texts_schema()
        ids = T.StructType([texts[c] for c in ("chunk_id", "shard", "place")])
        stats = CorpusStats(self.documents, self.manifest["mean_length"])
        return inverted.Index(
            self._table("postings", "token string, shard int, top double, places array<int>, weights array<double>, bucket int"),
            self._table("vocabulary", "token string, df bigint, tops array<double>, bucket int"), self._table("texts", ids), stats,
            self.manifest["buckets"], sum(s["shards"] for s in self.manifest["segments"]))

    def sparse_topk(self, queries: DataFrame, query_id: str, question: str, k: int, **options) -> DataFrame:
        """Sparse top-k from the stored postings; questions are pruned like the stored vectors."""
        index = self.index
        asked = inverted.ask(index, queries, query_id, question, k, self.manifest["drop_ratio"])
        return inverted.index_topk(index, asked, k, **options)

    def dense_topk(self, question_vectors: DataFrame, k: int, nprobe: int | None = None) -> DataFrame:
        """Dense top-k over the stored vectors: exact, or inside the ``nprobe`` nearest cells."""
        if nprobe is None:
            return dense.dense_topk(self.vectors, question_vectors, k)
        return dense.ivf_topk(self.vectors, question_vectors, self.centroids, k, nprobe)


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        rows = spark.read.schema(MANIFEST).json(f"{path}/manifest")
        return rows
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def open_collection(spark: SparkSession, path: str, version: int | None = None) -> Collection:
    """The newest version, or an older one by number."""
    rows = _versions(spark, path)
    if rows is not None:
        wanted = rows if version is None else rows.filter(F.col("version") == version)
        found = wanted.orderBy(F.col("version").desc()).limit(1).collect()
        if found:
            return Collection(spark, path, found[0].asDict(recursive=True))
    raise FileNotFoundError(f"no {'collection' if version is None else f'version {version}'} at {path}")


def _publish(spark: SparkSession, path: str, manifest: dict) -> None:
    """One row, one file: it is there as a whole or not at all."""
    spark.createDataFrame([manifest], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")


def create(chunks: DataFrame, path: str, *, vectors: DataFrame | None = None, text: str = "text", cells: int = 16,
           limits: dict[str, int] | None = None, drop_ratio: float = fixed.SPARSE_DROP_RATIO) -> Report:
    """Store ``chunks(chunk_id, text, ...)`` as a new collection; a collection that exists gets a new first segment.

    ``vectors(chunk_id, vector[, cell])`` are stored by cell; without a ``cell`` column cells are
    trained. Rows over the store ``limits`` (UTF-8 bytes) go to the folder ``rejected``
    with the offending columns. The mean length of this batch scales the weights of all later ones.
    ``chunk_id`` identifies a row.
    """
    return _write(chunks, path, None, vectors, text, cells, limits, drop_ratio)


def append(chunks: DataFrame, path: str, *, vectors: DataFrame | None = None, text: str = "text",
           limits: dict[str, int] | None = None) -> Report:
    """Add a batch as one more segment. Ids must be new; vectors go to the nearest stored centroid. One writer at a time."""
    current = open_collection(chunks.sparkSession, path)
    return _write(chunks, path, current, vectors, text, current.manifest["cells"], limits, current.manifest["drop_ratio"])


def _write(chunks: DataFrame, path: str, current: Collection | None, vectors: DataFrame | None, text: str, cells: int,
           limits: dict[str, int] | None, drop_ratio: float) -> Report:
    spark, name = chunks.sparkSession, uuid.uuid4().hex
    known = _versions(spark, path)
    version = 1 + ((known.agg(F.max("version")).first()[0] or 0) if known is not None else 0)
    limits = {c: n for c, n in (limits or {}).items() if c in chunks.columns}
    kept = chunks
    for column, most in limits.items():
        kept = kept.filter(F.coalesce(F.octet_length(F.col(column)), F.lit(0)) <= most)
    rejected = 0
    if limits:
        length_violations(chunks, limits).write.parquet(f"{path}/rejected/segment={name}")
        rejected = spark.read.parquet(f"{path}/rejected/segment={name}").count()
    documents = kept.count()
    before = sum(s["shards"] for s in current.manifest["segments"]) if current else 0
    shards = max(1, -(-documents // inverted.SHARD_DOCUMENTS))
    placed = inverted.numbered(kept, shards, before)
    placed = placed.withColumn("length", F.size(tokens(text)))
    placed.sortWithinPartitions("shard", "place").write.parquet(f"{path}/texts/segment={name}")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/texts/segment={name}")
    total = stored.agg(F.sum("length").alias("n")).first()["n"] or 0
    if current:
        buckets, mean = current.manifest["buckets"], current.manifest["mean_length"]
    else:
        buckets = max(FEWEST_BUCKETS, min(MOST_BUCKETS, total // BUCKET_TOKENS))
        mean = total / documents if documents else 0.0
    found = inverted.blocks(stored, text, CorpusStats(documents, mean), drop_ratio)
    found = found.withColumn("bucket", inverted.bucket_of(F.col("token"), buckets))
    _by_bucket(found, f"{path}/postings/segment={name}", "shard")
    listed = spark.read.schema(found.schema).parquet(f"{path}/postings/segment={name}")
    _by_bucket(inverted.vocabulary(listed), f"{path}/vocabulary/segment={name}")
    n_vectors, vectors_schema = 0, current.manifest["vectors_schema"] if current else None
    if vectors is not None:
        n_vectors, vectors_schema = _store_vectors(vectors, stored, path, name, cells, current)
    manifest = {
        "version": version, "buckets": buckets, "mean_length": mean, "drop_ratio": drop_ratio, "cells": cells,
        "texts_schema": placed.schema.json(), "vectors_schema": vectors_schema,
        "segments": (current.manifest["segments"] if current else []) + [
            {"name": name, "documents": documents, "rejected": rejected, "shards": shards, "vectors": n_vectors, "tokens": total}]}
    _publish(spark, path, manifest)
    return Report(version, name, documents, rejected, n_vectors)


def _by_bucket(rows: DataFrame, path: str, *also: str) -> None:
    """Every task writes its rows to the folders of their buckets, without a shuffle; a folder has at most a file a task."""
    context = rows.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows.coalesce(tasks).sortWithinPartitions("bucket", "token", *also).write.partitionBy("bucket").parquet(path)


def _store_vectors(vectors: DataFrame, stored: DataFrame, path: str, name: str, cells: int,
                   current: Collection | None) -> tuple[int, str]:
    """Vectors of stored chunks, one folder per cell; broken ones are left out."""
    rows = dense.finite_vectors(vectors, "vector").join(stored.select("chunk_id"), "chunk_id", "left_semi")
    if current is not None and current.centroids is not None:
        centroids = current.centroids
        nearest = dense.probe_cells(rows.select(F.col("chunk_id").alias("query_id"), "vector"), centroids, 1)
        placed = nearest.select(F.col("query_id").alias("chunk_id"), "vector", F.col("cell").cast("bigint").alias("cell"))
    else:
        if "cell" in rows.columns:
            width = rows.select(F.size("vector").alias("n")).first()
            centroids = dense.mean_vectors(rows, "cell", "vector", width["n"] if width else 0).select(
                F.col("cell").cast("bigint").alias("cell"), "centroid")
            placed = rows.select("chunk_id", "vector", F.col("cell").cast("bigint").alias("cell"))
        else:
            placed, centroids = dense.train_cells(rows.select("chunk_id", "vector"), "vector", cells=cells)
            placed = placed.select("chunk_id", "vector", "cell")
        # Written before the manifest names any vector, replaced only by a failed first batch that runs again.
        centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors/segment={name}")
    return vectors.sparkSession.read.schema(placed.schema).parquet(f"{path}/vectors/segment={name}").count(), placed.schema.json()


__all__ = ["Collection", "Report", "create", "append", "open_collection"]
