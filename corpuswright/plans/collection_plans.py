"""Stored collections over the driver tables: built once a session and folder, then searched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import contexts as C
from .. import fixed
from ..operators import dense, search
from ..session import new_table_path
from ..sources import collections
from . import roles
from .registry import Tables, query
from .retrieval_plans import (SQL_ASKED, SQL_CENTROIDS, SQL_CHUNK_SPARSE, SQL_DOC_SPARSE, SQL_DOCS, SQL_HYBRID, chunks, docs,
                              sql_weights)

_BUILT: dict[tuple[str, str, str], str] = {}


def stored(t: Tables, name: str, build: Callable[[str], object]) -> collections.Collection:
    """The collection ``name`` of this session and folder; the first caller builds it in the shared folder."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _BUILT:
        path = new_table_path(t.spark, f"collection-{name}")
        build(path)
        _BUILT[key] = path
    return collections.open_collection(t.spark, _BUILT[key])


def stored_docs(t: Tables) -> collections.Collection:
    """Documents with their vectors, stored by the given cells."""
    return stored(t, "docs", lambda path: collections.create(docs(t), path, vectors=roles.vectors(t)))


def stored_chunks(t: Tables) -> collections.Collection:
    return stored(t, "chunks", lambda path: collections.create(chunks(t).withColumnRenamed("chunk_text", "text"), path))


@query("stored_sparse_topk", f"{SQL_CHUNK_SPARSE} SELECT query_id, chunk_id, score, rank FROM sparse WHERE rank <= 10")
def stored_sparse_topk(t: Tables) -> DataFrame:
    return stored_chunks(t).sparse_topk(roles.questions(t), "query_id", "question", 10)


@query("stored_passage_contexts", f"""{SQL_CHUNK_SPARSE}, hit AS (SELECT s.query_id, s.rank, c.parent_id, c.category, c.chunk_text FROM sparse s JOIN notice_chunks c USING (chunk_id) WHERE rank <= 5)
SELECT query_id, string_agg(chr(10) || '### 문서 조각 ' || rank || ' [출처: [공지-' || category || '] ' || parent_id || '] ###' || chr(10) || chunk_text || chr(10), '' ORDER BY rank) AS context FROM hit GROUP BY 1""")
def stored_passage_contexts(t: Tables) -> DataFrame:
    """Contexts of the five best chunks, texts and labels from the collection."""
    collection = stored_chunks(t)
    asked = roles.questions(t)
    hits = collection.sparse_topk(asked, "query_id", "question", 5)
    rows = search.attach(hits, collection.texts.select("chunk_id", "parent_id", "category", F.col("text").alias("chunk_text")),
                         search.measure(asked).rows * 5)
    common = search.notice_hits_to_common(rows, layout=fixed.NODE_SOURCE_LAYOUT, empty_is_missing=True)
    return search.format_hits(common, lambda i, h: C.block_node(i, h["source"], h["text"]), C.LAYOUT_SEPARATORS["node"],
                              ["source", "text"])


@query("stored_hybrid_search", f"{SQL_HYBRID} SELECT query_id, chunk_id, score, rerank_score, rank FROM hybrid WHERE rank <= 10")
def stored_hybrid_search(t: Tables) -> DataFrame:
    found = search.stored_hybrid_search(stored_docs(t), roles.questions(t), roles.question_vectors(t))
    return found.select("query_id", "chunk_id", "score", "rerank_score", "rank")


# The centroids are means of the vectors whose document is stored, and so is every search below.
SQL_STORED_VECTORS = roles.SQL_VECTORS.replace("FROM embeddings)", "FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))")
SQL_NEAR = f"""{SQL_CENTROIDS},
near AS (SELECT a.query_id, a.v, c.cell, row_number() OVER (PARTITION BY a.query_id ORDER BY round(list_inner_product(a.v, c.v), 6) DESC, c.cell) AS place FROM asked a, centroids c)"""
SQL_HYBRID_CELLS = SQL_HYBRID.replace(roles.SQL_VECTORS, SQL_STORED_VECTORS + ", " + SQL_NEAR).replace(
    "FROM asked a, vecs d WHERE d.chunk_id IN (SELECT chunk_id FROM docs))", "FROM near a JOIN vecs d USING (cell) WHERE place <= 4)")


@query("stored_hybrid_cells", f"{SQL_HYBRID_CELLS} SELECT query_id, chunk_id, score, rerank_score, rank FROM hybrid WHERE rank <= 10")
def stored_hybrid_cells(t: Tables) -> DataFrame:
    """The dense arm probes four cells of the stored vectors."""
    found = search.stored_hybrid_search(stored_docs(t), roles.questions(t), roles.question_vectors(t), nprobe=4)
    return found.select("query_id", "chunk_id", "score", "rerank_score", "rank")


@query("progressive_search_cells", f"""WITH {SQL_STORED_VECTORS}, {SQL_NEAR},
  s0 AS (SELECT n.query_id, d.chunk_id, n.v AS q, d.v AS d, round(list_inner_product(n.v, d.v), 6) AS score FROM near n JOIN vecs d USING (cell) WHERE place <= 4),
  r0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s0),
  s1 AS (SELECT *, round(list_distance(q[1:32], d[1:32]), 6) AS d1 FROM r0 WHERE r <= 100),
  r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d1, chunk_id) AS p1 FROM s1),
  s2 AS (SELECT query_id, chunk_id, round(list_distance(q, d), 6) AS distance FROM r1 WHERE p1 <= 50)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM s2) WHERE rank <= 10""")
def progressive_search_cells(t: Tables) -> DataFrame:
    """Progressive search over stored vectors, the first stage inside four cells."""
    collection = stored_docs(t)
    return dense.progressive_search(collection.vectors, roles.question_vectors(t), [(32, 50), (64, 10)],
                                    centroids=collection.centroids, nprobe=4)


def _batches(t: Tables) -> collections.Collection:
    """Documents in three batches: even ids, odd ids with rows over the limit left out, and one that changes nothing."""
    def build(path: str) -> None:
        rows = docs(t)
        collections.create(rows.where("chunk_id % 2 = 0"), path)
        collections.append(rows.where("chunk_id % 2 = 1"), path, limits={"text": 2000})
        collections.append(rows.where("chunk_id < 0"), path)

    return stored(t, "batches", build)


@query("append_to_collection", f"""WITH docs AS (SELECT doc_id AS chunk_id, text, lang, source FROM documents WHERE doc_id % 2 = 0 OR strlen(text) <= 2000), {SQL_ASKED},
{sql_weights('docs').replace('avg(len(ts)) AS mean', 'avg(len(ts)) FILTER (chunk_id % 2 = 0) AS mean')}
SELECT query_id, chunk_id, score, rank FROM sparse WHERE rank <= 10""")
def append_to_collection(t: Tables) -> DataFrame:
    """A search over three batches; the mean length of the first scales all weights."""
    return _batches(t).sparse_topk(roles.questions(t), "query_id", "question", 10)


@query("collection_reports", """WITH d AS (SELECT doc_id % 2 AS part, strlen(text) AS n FROM documents)
SELECT 1::BIGINT AS batch, count(*) FILTER (part = 0) AS documents, 0::BIGINT AS rejected FROM d UNION ALL
SELECT 2, count(*) FILTER (part = 1 AND n <= 2000), count(*) FILTER (part = 1 AND n > 2000) FROM d UNION ALL SELECT 3, 0, 0""")
def collection_reports(t: Tables) -> DataFrame:
    """What each batch stored and rejected, from the manifest."""
    rows = [(i, s["documents"], s["rejected"]) for i, s in enumerate(_batches(t).manifest["segments"], 1)]
    return t.spark.createDataFrame(rows, "batch bigint, documents bigint, rejected bigint")
