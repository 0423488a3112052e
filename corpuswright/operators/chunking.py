"""Greedy chunkers, computed inside the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.core import let, run_end, strip
from ..functions.text import context_header, contextual_chunk_text, metadata_field


def paragraphs(text: Column, separator: str) -> Column:
    """Stripped, non-empty blocks."""
    parts = F.transform(F.split(strip(text), separator), lambda p: strip(p))
    return F.filter(parts, lambda p: p != "")


def _fold(blocks: Column, fits: Callable[[Column, Column], Column], joint: str, open_length: int) -> Column:
    """Pack blocks left to right. The state keeps only start positions and a length,
    so a long document costs no repeated string copies."""
    start = F.struct(F.array().cast("array<int>").alias("starts"),
                     F.lit(0).alias("length"), F.lit(0).alias("seen"))

    def step(state: Column, block: Column) -> Column:
        size = F.length(block)
        joins = (F.size(state["starts"]) > 0) & fits(state["length"], size)
        position = state["seen"] + 1
        return F.struct(
            F.when(joins, state["starts"])
            .otherwise(F.concat(state["starts"], F.array(position))).alias("starts"),
            F.when(joins, state["length"] + size + len(joint))
            .otherwise(size + open_length).alias("length"),
            position.alias("seen"),
        )

    def pieces(items: Column) -> Column:
        return let(F.aggregate(items, start, step, lambda s: s["starts"]), lambda starts: F.transform(
            starts,
            lambda first, i: F.array_join(
                F.slice(items, first, run_end(starts, i, F.size(items)) - first + 1), joint),
        ))

    return let(blocks, pieces)


def paragraph_chunk_array(text: Column, min_length: int = fixed.MIN_CHUNK_LENGTH,
                          separator: str = r"\n\n+") -> Column:
    """Join short neighbours until ``min_length`` is reached. ``min_length`` is no
    guarantee: a short chunk before a long block is emitted short."""
    return _fold(paragraphs(text, separator), lambda length, size: length + size < min_length, "\n", 0)


def bounded_chunk_array(page: Column, max_size: int = fixed.MAX_CHUNK_SIZE,
                        separator: str = r"\n\n") -> Column:
    """Pack paragraphs up to ``max_size``; the two-character joint after every
    paragraph counts, an oversized paragraph stays whole."""
    return _fold(paragraphs(page, separator), lambda length, size: length + size <= max_size, "\n\n", 2)


def paragraph_chunks(df: DataFrame, text: str, *, min_length: int = fixed.MIN_CHUNK_LENGTH,
                     separator: str = r"\n\n+") -> DataFrame:
    """One row per chunk; ``chunk_no`` counts from 1. Empty documents give no rows."""
    keep = [c for c in df.columns if c != text]
    exploded = df.select(*keep, F.posexplode(paragraph_chunk_array(F.col(text), min_length, separator))
                         .alias("__position", "chunk"))
    return exploded.select(*keep, (F.col("__position") + 1).cast("bigint").alias("chunk_no"), "chunk")


def chunk_id(parent: Column, number: Column) -> Column:
    return F.concat(parent, F.lit("_chunk_"), number.cast("string"))


def notice_chunks(notices: DataFrame, *, parent: str = "notice_id", content: str = "refined_content",
                  min_length: int = fixed.MIN_CHUNK_LENGTH, separator: str = r"\n\n+", keep: Sequence[str] = ()) -> DataFrame:
    """Refined notices to index-ready chunks with flat metadata.

    Needs ``parent``, ``title``, ``metadata`` and ``content`` columns; ``keep`` names others to pass on.
    """
    header = context_header(F.col("metadata.category"), F.col("metadata.entity"), F.col("title"))
    chunks = paragraph_chunks(
        notices.select(F.col(parent).cast("string").alias("parent_id"), header.alias("header"),
                       "metadata", content, *keep),
        content, min_length=min_length, separator=separator,
    )
    return chunks.select(
        chunk_id(F.col("parent_id"), F.col("chunk_no")).alias("chunk_id"),
        "parent_id", "chunk_no",
        *[metadata_field("metadata", name).alias(name) for name in ("year", "category", "target", "entity")],
        contextual_chunk_text(F.col("header"), F.col("chunk")).alias("chunk_text"), *keep,
    )


def page_columns(number: Column) -> dict[str, Column]:
    """Page number and neighbours; a non-numeric page has none. Page 1 has neighbour 0."""
    page = F.trim(number).try_cast("int")
    return {"page_num": page, "prev_page": page - 1, "next_page": page + 1}


def split_pages(df: DataFrame, text: str) -> DataFrame:
    """One row per tagged page. Text before a tag belongs to it; text after the last
    tag and empty pages are dropped."""
    keep = [c for c in df.columns if c != text]
    groups = [F.regexp_extract_all(F.col(text), F.lit(fixed.PAGE_TAG), F.lit(g)).alias(n)
              for g, n in ((1, "body"), (2, "doc_id"), (3, "num"))]
    pages = df.select(*keep, F.posexplode(F.arrays_zip(*groups)).alias("__position", "p"))
    return pages.select(
        *keep, (F.col("__position") + 1).cast("bigint").alias("page_index"),
        F.col("p.doc_id").alias("doc_id"), F.col("p.num").alias("page_num_raw"),
        strip(F.col("p.body")).alias("page_text"),
    ).filter(F.col("page_text") != "")


def rule_chunks(df: DataFrame, text: str, source: str, *, max_size: int = fixed.MAX_CHUNK_SIZE,
                separator: str = r"\n\n") -> DataFrame:
    """Tagged markdown to bounded chunks that never cross a page."""
    pages = split_pages(df.select(F.col(source).alias("source"), F.col(text).alias("__text")), "__text")
    chunks = pages.select(
        "source", "page_index", "doc_id", "page_num_raw",
        F.posexplode(bounded_chunk_array(F.col("page_text"), max_size, separator)).alias("__position", "text"),
    )
    return chunks.withColumns(page_columns(F.col("page_num_raw"))).withColumn(
        "chunk_no", (F.col("__position") + 1).cast("bigint")).drop("__position")


def token_cost(chunks: DataFrame, text: str, *, per_character: float = fixed.TOKENS_PER_CHARACTER,
               per_chunk: int = fixed.TOKENS_PER_CHUNK, input_rate: float = fixed.INPUT_RATE,
               output_rate: float = fixed.OUTPUT_RATE, currency: float = fixed.CURRENCY_RATE) -> DataFrame:
    """Expected cost of one rewriting pass over all chunks, a single row."""
    totals = chunks.agg(F.count(F.lit(1)).alias("chunks"),
                        F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters"))
    spent = totals.withColumns({
        "input_tokens": F.col("characters") * F.lit(per_character) + F.col("chunks") * per_chunk,
        "output_tokens": F.col("characters") * F.lit(per_character),
    })
    price = (F.col("input_tokens") / 1e6 * F.lit(input_rate)
             + F.col("output_tokens") / 1e6 * F.lit(output_rate))
    return spent.withColumn("cost", F.round(price, 6)).withColumn(
        "cost_local", F.round(price * F.lit(currency), 6))
