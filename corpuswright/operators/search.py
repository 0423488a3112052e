"""Fusion, reranking and the composed searches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.contexts import source_label
from ..functions.measures import covered_of, covered_share
from ..functions.text import distinct_tokens, preview
from ..session import materialise
from ..sizing import BROADCAST_BYTES, measure
from .dense import dense_topk
from .ordinals import top_k

DIGITS = 6
BYTES_PER_HIT = 128
PAIRS_WITH_TEXTS = 1 << 14  # of question and candidate that are joined with their texts before they are scored
Scorer = Callable[[Column, Column], Column]


def rank_by_score(hits: DataFrame, group: str, score: str, item: str, k: int) -> DataFrame:
    return top_k(hits, k, [group], [F.col(score).desc(), F.col(item)])


def rrf(arms: list[DataFrame], limit: int, k: int = fixed.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of arms ``(query_id, chunk_id, rank)``."""
    votes = None
    for arm in arms:
        part = arm.select("query_id", "chunk_id", (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("vote"))
        votes = part if votes is None else votes.unionByName(part)
    fused = votes.groupBy("query_id", "chunk_id").agg(F.round(F.sum("vote"), DIGITS).alias("score"))
    return rank_by_score(fused, "query_id", "score", "chunk_id", limit)


def coverage_scorer(question: Column, passage: Column) -> Column:
    """Share of the distinct question tokens the passage holds."""
    return covered_share(question, passage)


def sigmoid(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def attach(hits: DataFrame, chunks: DataFrame, max_hits: int) -> DataFrame:
    """Join hits with their chunk rows. The number of hits is bounded by queries
    times k, so the hits travel, never the corpus."""
    side = F.broadcast(hits) if max_hits * BYTES_PER_HIT <= BROADCAST_BYTES else hits
    return chunks.join(side, "chunk_id")


def rerank(candidates: DataFrame, final_k: int, *, scorer: Scorer = coverage_scorer,
           normalise: bool = False) -> DataFrame:
    """Score ``candidates(query_id, chunk_id, question, text, score)`` pairwise and keep
    the best; ties by the earlier score, then id."""
    raw = scorer(F.col("question"), F.col("text"))
    final = F.round(sigmoid(raw) if normalise else raw, DIGITS)
    return top_k(candidates.withColumn("rerank_score", final), final_k, ["query_id"],
                 [F.col("rerank_score").desc(), F.col("score").desc(), F.col("chunk_id")])


def hybrid_candidates(chunks: DataFrame, questions: DataFrame, vectors: DataFrame | None,
                      question_vectors: DataFrame | None, retrieve_k: int, *,
                      drop_ratio: float = fixed.SPARSE_DROP_RATIO) -> DataFrame:
    """Dense and sparse arms fused: ``(query_id, chunk_id, score, rank)``."""
    from .lexical import lexical_topk

    arms = [lexical_topk(chunks, "chunk_id", "text", questions, "query_id", "question", retrieve_k,
                         drop_build=drop_ratio, drop_search=drop_ratio)]
    if vectors is not None and question_vectors is not None:
        arms.append(dense_topk(vectors, question_vectors, retrieve_k))
    return rrf(arms, retrieve_k)


def with_texts(candidates: DataFrame, chunks: DataFrame, questions: DataFrame, retrieve_k: int) -> DataFrame:
    """Candidates with chunk columns and question text."""
    asked = measure(questions)
    texts = attach(candidates, chunks, asked.rows * retrieve_k)
    side = questions.select("query_id", "question")
    return texts.join(F.broadcast(side) if asked.fits() else side, "query_id")


def hybrid_search(chunks: DataFrame, questions: DataFrame, vectors: DataFrame | None = None,
                  question_vectors: DataFrame | None = None, *, retrieve_k: int = 50, final_k: int = 10,
                  scorer: Scorer = coverage_scorer, normalise: bool = False,
                  drop_ratio: float = fixed.SPARSE_DROP_RATIO) -> DataFrame:
    """Dense + sparse, fused, reranked, cut.

    ``chunks(chunk_id, text, ...)``, ``questions(query_id, question)``,
    ``vectors(chunk_id, vector)``, ``question_vectors(query_id, vector)``.
    Questions without a hit give no rows.
    """
    candidates = hybrid_candidates(chunks, questions, vectors, question_vectors, retrieve_k,
                                   drop_ratio=drop_ratio)
    return rerank_candidates(candidates, chunks, questions, retrieve_k, final_k, scorer, normalise)


def rerank_candidates(candidates: DataFrame, chunks: DataFrame, questions: DataFrame, retrieve_k: int, final_k: int,
                      scorer: Scorer, normalise: bool) -> DataFrame:
    """``rerank`` of ``with_texts``. Where pairs are many and ids tell rows apart, the coverage of a pair is counted from
    token lists made once a chunk and once a question, and only the best ``final_k`` get their texts."""
    asked = measure(questions)
    if (scorer is not coverage_scorer or asked.rows * retrieve_k <= PAIRS_WITH_TEXTS
            or not _tells_apart(chunks, "chunk_id") or not _tells_apart(questions, "query_id")):
        return rerank(with_texts(candidates, chunks, questions, retrieve_k), final_k, scorer=scorer, normalise=normalise)
    held = materialise(chunks.select("chunk_id", distinct_tokens("text").alias("__held")), "chunk-tokens")
    wanted = questions.select("query_id", distinct_tokens("question").alias("__wanted"))
    pairs = attach(candidates, held, asked.rows * retrieve_k).join(F.broadcast(wanted) if asked.fits() else wanted, "query_id")
    raw = covered_of(F.col("__wanted"), F.col("__held"))
    scored = pairs.select("query_id", "chunk_id", "score", F.round(sigmoid(raw) if normalise else raw, DIGITS).alias("rerank_score"))
    best = top_k(scored, final_k, ["query_id"], [F.col("rerank_score").desc(), F.col("score").desc(), F.col("chunk_id")])
    rows = with_texts(materialise(best, "best-of-pairs"), chunks, questions, final_k)
    return rows.select(*[c for c in rows.columns if c != "rerank_score"], "rerank_score")


def _tells_apart(rows: DataFrame, key: str) -> bool:
    return rows.groupBy(key).count().filter("count > 1").isEmpty()


def stored_candidates(collection, questions: DataFrame, question_vectors: DataFrame | None, retrieve_k: int,
                      nprobe: int | None = None) -> DataFrame:
    """Dense and sparse arms of a stored collection fused: ``(query_id, chunk_id, score, rank)``."""
    arms = [collection.sparse_topk(questions, "query_id", "question", retrieve_k)]
    if question_vectors is not None and collection.vectors is not None:
        arms.append(collection.dense_topk(question_vectors, retrieve_k, nprobe))
    return rrf(arms, retrieve_k)


def stored_hybrid_search(collection, questions: DataFrame, question_vectors: DataFrame | None = None, *, retrieve_k: int = 50,
                         final_k: int = 10, nprobe: int | None = None, scorer: Scorer = coverage_scorer,
                         normalise: bool = False) -> DataFrame:
    """``hybrid_search`` over a stored collection: postings, vectors and texts all come from one version of it.

    ``nprobe`` limits the dense arm to the nearest cells.
    """
    candidates = stored_candidates(collection, questions, question_vectors, retrieve_k, nprobe)
    return rerank(with_texts(candidates, collection.texts, questions, retrieve_k), final_k, scorer=scorer, normalise=normalise)


def preset_search(preset: str, chunks: DataFrame, questions: DataFrame, **options) -> DataFrame:
    retrieve_k, final_k = fixed.SEARCH_PRESETS[preset]
    return hybrid_search(chunks, questions, retrieve_k=retrieve_k, final_k=final_k, **options)


def notice_hits_to_common(hits: DataFrame, *, layout: str = fixed.MERGED_SOURCE_LAYOUT,
                          empty_is_missing: bool = False) -> DataFrame:
    """Notice hits ``(query_id, chunk_id, parent_id, category, chunk_text)`` in the common
    form ``(query_id, source, page_num, doc_id, text)`` plus scores."""
    extra = [c for c in hits.columns if c not in ("parent_id", "category", "chunk_text")]
    return hits.select(
        *extra,
        source_label(F.col("category"), F.col("parent_id"), layout,
                     empty_is_missing=empty_is_missing).alias("source"),
        F.lit(1).alias("page_num"), F.col("chunk_id").alias("doc_id"),
        F.col("chunk_text").alias("text"),
    )


def union_collections(hits: list[DataFrame]) -> DataFrame:
    """Hits of several collections in the common form, without de-duplication."""
    out = hits[0]
    for more in hits[1:]:
        out = out.unionByName(more)
    return out


def multi_collection_search(collections: dict, questions: DataFrame,
                            question_vectors: DataFrame | None = None, *, retrieve_k: int = 10,
                            final_k: int = 10, scorer: Scorer = coverage_scorer) -> DataFrame:
    """Hybrid search per collection, then one rerank over all hits.

    Every collection is a stored one, or gives ``chunks(chunk_id, text, source, page_num)`` and
    optionally ``vectors``. Chunk ids are prefixed with the collection's name.
    """
    parts = []
    for name, data in collections.items():
        if isinstance(data, dict):
            texts = data["chunks"]
            found = hybrid_candidates(texts, questions, data.get("vectors"), question_vectors, retrieve_k)
        else:
            texts, found = data.texts, stored_candidates(data, questions, question_vectors, retrieve_k)
        rows = with_texts(found, texts, questions, retrieve_k)
        parts.append(rows.select(
            "query_id", "question", F.lit(name).alias("collection"),
            F.concat(F.lit(f"{name}:"), F.col("chunk_id").cast("string")).alias("chunk_id"),
            "source", "page_num", "text", "score"))
    return rerank(union_collections(parts), final_k, scorer=scorer, normalise=True)


def refill_contexts(rows: DataFrame, row_id: str, question: str, contexts: str,
                    search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Search again for rows whose contexts are only labels; keep the old list when
    nothing is found. ``search`` maps ``(query_id, question)`` to hits with ``text``."""
    from ..functions.contexts import clean_list, label_only_contexts

    needy = rows.filter(label_only_contexts(clean_list(F.col(contexts))))
    hits = search(materialise(needy.select(F.col(row_id).alias("query_id"), F.col(question).alias("question")), "needy"))
    fresh = hits.groupBy("query_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda h: h["text"]).alias("__fresh"))
    return (rows.join(fresh.withColumnRenamed("query_id", row_id), row_id, "left")
            .withColumn("refilled", F.col("__fresh").isNotNull())
            .withColumn(contexts, F.coalesce("__fresh", contexts)).drop("__fresh"))


def preview_hits(hits: DataFrame, n: int = 3, chars: int = 150) -> DataFrame:
    """First ``n`` hits per query with a one-line preview of the text."""
    return hits.filter(F.col("rank") <= n).withColumn("preview", preview("text", chars)).drop("text")


def retrieval_hit_rate(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Share of the questions of which a retrieved text holds the whole passage.

    Only retrieved pairs are compared: ``hits(query_id, question, text)``.
    """
    found = (hits.groupBy("query_id")
             .agg(F.max(F.contains(F.col("text"), F.col("question")).cast("int")).alias("hit")))
    judged = questions.select("query_id").join(found, "query_id", "left")
    return judged.agg(
        F.count(F.lit(1)).alias("questions"),
        F.coalesce(F.sum("hit"), F.lit(0)).cast("bigint").alias("found"),
        F.round(F.avg(F.coalesce(F.col("hit"), F.lit(0)).cast("double")), DIGITS).alias("hit_rate"),
    )


def format_layouts(hits: DataFrame, layouts: dict[str, tuple[Callable[[Column, Column], Column], str, bool]],
                   fields: list[str]) -> DataFrame:
    """Context strings per query from at most ``final_k`` ranked hits.

    Each layout is ``(block, separator, reverse)``. ``block(position, hit)``
    builds the text of one hit; ``hit`` holds ``rank`` and the named fields,
    ``position`` counts from 1 in output order. With ``reverse`` the best hit
    comes last. The hits of a query are collected once for all layouts.
    """
    listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("hits"))

    def text(block: Callable[[Column, Column], Column], separator: str, reverse: bool) -> Column:
        ordered = F.reverse("hits") if reverse else F.col("hits")
        return F.array_join(F.transform(ordered, lambda hit, i: block(i + 1, hit)), separator)

    return listed.select("query_id", *[text(*layout).alias(name) for name, layout in layouts.items()])


def format_hits(hits: DataFrame, block: Callable[[Column, Column], Column], separator: str,
                fields: list[str], *, reverse: bool = False, out: str = "context") -> DataFrame:
    """One layout, see ``format_layouts``."""
    return format_layouts(hits, {out: (block, separator, reverse)}, fields)
