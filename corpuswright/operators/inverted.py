"""A stored inverted index and exact top-k over it.

Documents are dealt into shards of bounded size and numbered by id inside their
shard. A token's postings in one shard are cut into blocks, each with its largest
weight, and blocks are stored in folders by a hash of the token, so a search reads
the folders of the asked tokens only. Blocks of a token that outweighs the rest of the
question are dropped before the shuffle where they cannot lift a document to
the ``k``-th score; a shard's kernel stops taking new documents as soon as the tokens left
cannot carry one there, and looks the others up. No matching
pair of query and document is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import fixed
from ..functions.text import token_counts, tokens
from ..session import materialise
from ..sizing import BROADCAST_BYTES, Measured, measure
from .best import DIGITS
from .lexical import CorpusStats, _count_tokens, _text_steps, _weights
from .ordinals import top_k

SHARD_DOCUMENTS = 1 << 14
BLOCK = 128
ENTRIES = 1 << 21  # entries a task sorts into blocks at a time
ROWS_OUT = 1 << 14
TOPS = 128  # block maxima kept per token; a larger k searches without a floor from the start
BYTES_PER_HIT = 64
MARGIN = 1e-5  # scores are compared after rounding to DIGITS places


@dataclass(frozen=True)
class Index:
    """Stored tables: ``postings(token, shard, top, places, weights, bucket)``,
    ``vocabulary(token, df, tops, bucket)``, ``documents(chunk_id, shard, place)``, the corpus counts and the number of shards."""

    postings: DataFrame
    vocabulary: DataFrame
    documents: DataFrame
    stats: CorpusStats
    buckets: int
    shards: int


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


# --- building ---

def numbered(chunks: DataFrame, shards: int, first: int = 0) -> DataFrame:
    """Adds ``shard`` and ``place``, the number of a chunk among those of its shard in id order, from 0."""
    dealt = chunks.withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int") + F.lit(first))
    inside = Window.partitionBy("shard").orderBy("chunk_id")
    return dealt.withColumn("place", (F.row_number().over(inside) - 1).cast("int"))


def blocks(documents: DataFrame, text: str, stats: CorpusStats, drop_ratio: float = fixed.SPARSE_DROP_RATIO) -> DataFrame:
    """``token, shard, df, top, places, weights``: postings of the numbered documents, in blocks of at most ``BLOCK``.

    A task reads documents as they are stored, by shard and place, and gathers ``ENTRIES`` entries at a time, so no
    entry is ever a row. ``df`` stands at the first block a token has in such a part of a shard and is 0 at
    its others. Each document's smallest weights count for frequencies only: a token that has no other
    entries there gives a row with a null ``top`` and no places.
    """
    out = T.StructType([T.StructField("token", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("df", T.LongType()),
                        T.StructField("top", T.DoubleType()), T.StructField("places", T.ArrayType(T.IntegerType())),
                        T.StructField("weights", T.ArrayType(T.DoubleType()))])
    names, most, block = to_arrow_schema(out), ENTRIES, BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for ids, lists in _text_steps(batches):
            counts = _count_tokens(lists)
            weight, kept = _weights(counts, stats, drop_ratio)
            shard, at = (c.to_numpy(zero_copy_only=False) for c in ids.flatten())
            waiting.append((counts.words, counts.word, shard[counts.doc], at[counts.doc], weight, kept))
            size += len(weight)
            if size >= most:
                yield from _blocks_of(waiting, block, names).to_batches(max_chunksize=ROWS_OUT)
                waiting, size = [], 0
        if size:
            yield from _blocks_of(waiting, block, names).to_batches(max_chunksize=ROWS_OUT)

    return documents.select(F.struct("shard", "place").alias("id"), tokens(text).alias("ts")).mapInArrow(run, out)


def _blocks_of(steps: list[tuple], block: int, names: pa.Schema) -> pa.Table:
    """Blocks of the entries ``(words, word, shard, place, weight, kept)`` of some steps, each step with words of its own."""
    words = pa.chunked_array([s[0] for s in steps]).combine_chunks().dictionary_encode()
    codes = words.indices.to_numpy().astype("int64")
    first = np.cumsum([0] + [len(s[0]) for s in steps])
    word = np.concatenate([codes[f + s[1]] for f, s in zip(first, steps)])
    shard, place, weight, kept = (np.concatenate([s[i] for s in steps]) for i in range(2, 6))
    shards, shard = np.unique(shard, return_inverse=True)
    group = word * len(shards) + shard
    order = np.argsort(group * (int(place.max()) + 1) + place)
    group, place, weight, kept = group[order], place[order], weight[order], kept[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    groups, df = group[starts], np.diff(np.r_[starts, len(group)])
    held = np.add.reduceat(kept.astype("int64"), starts)
    parts = np.maximum(1, -(-held // block))  # a group without kept entries has one empty block
    lead = np.cumsum(np.r_[0, parts])[:-1]
    nth = np.arange(parts.sum()) - np.repeat(lead, parts)
    sizes = np.minimum(block, np.repeat(held, parts) - nth * block)
    edges = np.cumsum(np.r_[0, sizes])
    place, weight = place[kept], weight[kept]
    full = np.flatnonzero(sizes)
    top = np.zeros(len(sizes))
    if len(full):
        top[full] = np.maximum.reduceat(weight, edges[full])
    owner = np.repeat(groups, parts)
    offsets = pa.array(edges, pa.int32())
    return pa.Table.from_arrays([
        words.dictionary.take(pa.array(owner // len(shards))), pa.array(shards[owner % len(shards)], pa.int32()),
        pa.array(np.where(nth == 0, np.repeat(df, parts), 0), pa.int64()), pa.array(top, mask=sizes == 0),
        pa.ListArray.from_arrays(offsets, pa.array(place, pa.int32()), type=names.field(4).type),
        pa.ListArray.from_arrays(offsets, pa.array(weight, pa.float64()), type=names.field(5).type)], schema=names)


def vocabulary(postings: DataFrame) -> DataFrame:
    """``token, df, tops, bucket`` of stored ``postings(token, df, top, bucket)``: document frequency and the ``TOPS``
    largest block maxima, falling.

    Blocks are merged as they lie in their files, by token, then all parts of a token in one sorted stream.
    """
    tops = F.when(F.col("top").isNotNull(), F.array("top")).otherwise(F.array().cast("array<double>"))
    merge = _merge(TOPS)
    schema = "bucket int, token string, df bigint, tops array<double>"
    parts = postings.select("bucket", "token", "df", tops.alias("tops")).mapInArrow(merge, schema)
    whole = parts.repartition("bucket").sortWithinPartitions("bucket", "token").mapInArrow(merge, schema)
    return whole.select("token", "df", "tops", "bucket")


def _merge(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds up neighbouring rows of one token and keeps its ``most`` largest ``tops``; the state is one token's row."""
    def merged(table: pa.Table) -> pa.Table:
        token, bucket = (table.column(c).combine_chunks() for c in ("token", "bucket"))
        starts = np.flatnonzero(np.r_[True, pc.not_equal(token[1:], token[:-1]).to_numpy(zero_copy_only=False)])
        tops = table.column("tops").combine_chunks()
        row = np.repeat(np.arange(len(token)), pc.list_value_length(tops).to_numpy(zero_copy_only=False))
        owner, value = np.searchsorted(starts, row, side="right") - 1, tops.flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((-value, owner))
        owner, value = owner[order], value[order]
        keep = np.arange(len(owner)) - np.searchsorted(owner, owner) < most
        edges = np.searchsorted(owner[keep], np.arange(len(starts) + 1))
        return pa.table({"bucket": bucket.take(pa.array(starts)), "token": token.take(pa.array(starts)),
                         "df": pa.array(np.add.reduceat(table.column("df").to_numpy(), starts), pa.int64()),
                         "tops": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(value[keep], pa.float64()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            done = merged(table if last is None else pa.concat_tables([last, table.cast(last.schema)]))
            last = done.slice(len(done) - 1)
            yield from done.slice(0, len(done) - 1).combine_chunks().to_batches()
        if last is not None:
            yield from last.combine_chunks().to_batches()

    return run


@dataclass(frozen=True)
class Asked:
    """The question side: ``rows(query_id, token, weight, floor, need, bucket)``, its measured size and number of queries.

    ``floor`` is a score the query's ``k``-th hit has at least, ``need`` the
    largest weight a block must hold to matter to the query.
    """

    rows: DataFrame
    size: Measured
    queries: int
    buckets: list[int]


def opened(table: DataFrame, buckets: list[int]) -> DataFrame:
    """The folders of the asked tokens; their list, at most as long as there are buckets, is a literal of the plan."""
    return table.filter(F.col("bucket").isin(buckets))


def _small(df: DataFrame, size: Measured, name: str) -> tuple[DataFrame, pa.Table | None]:
    """A measured side as a local table, also for the driver; a larger one is written once."""
    if not size.fits():
        return materialise(df, name), None
    table = df.toArrow()
    return df.sparkSession.createDataFrame(table, df.schema), table


def ask(index: Index, queries: DataFrame, query_id: str, question: str, k: int, drop_ratio: float = 0.0) -> Asked:
    """Weights of all question tokens the index knows, and what a block must hold to matter.

    The ``k``-th largest of a token's block maxima belongs to ``k`` documents, each scoring at
    least that weight times the question's: the query's floor is the best of these. A document of a block scores at
    most the block's largest weight and all other tokens' largest.
    """
    counts = queries.select(F.col(query_id).alias("query_id"), F.explode(token_counts(question)).alias("e")).select(
        "query_id", F.col("e.token").alias("token"), F.col("e.tf").alias("tf")).withColumn(
        "bucket", bucket_of(F.col("token"), index.buckets))
    size = measure(counts)
    counts, table = _small(counts, size, "asked")
    buckets = (sorted(set(table.column("bucket").to_pylist())) if table is not None
               else sorted(r["bucket"] for r in counts.select("bucket").distinct().collect()))
    vocabulary = counts.select("token").distinct()
    known = opened(index.vocabulary, buckets).join(F.broadcast(vocabulary) if size.fits() else vocabulary, "token", "left_semi")
    # A token stands once in every segment of a collection that has it.
    known = known.groupBy("token").agg(F.sum("df").alias("df"), F.sort_array(F.flatten(F.collect_list(
        F.coalesce("tops", F.array().cast("array<double>")))), asc=False).alias("tops"))
    n = F.lit(index.stats.documents)
    rarity = F.log(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known, _ = _small(known.select("token", rarity.alias("rarity"), F.get("tops", F.lit(0)).alias("top"),
                                     F.get("tops", F.lit(k - 1)).alias("kth")), size, "known")
    weighted = counts.join(F.broadcast(known) if size.fits() else known, "token").select(
        "query_id", "bucket", F.struct(F.round(F.col("tf") * F.col("rarity"), DIGITS).alias("weight"), "token", "bucket",
                                       F.coalesce("top", F.lit(0.0)).alias("top"), "kth").alias("e"))
    vectors = weighted.groupBy("query_id").agg(F.sort_array(F.collect_list("e")).alias("v"))
    dropped = F.floor(F.size("v") * F.lit(drop_ratio)).cast("int")
    vectors = vectors.select("query_id", F.slice("v", dropped + 1, F.size("v")).alias("v"))
    most = F.aggregate("v", F.lit(0.0), lambda s, e: s + e["weight"] * e["top"])
    floor = F.coalesce(F.array_max(F.transform("v", lambda e: e["weight"] * e["kth"])), F.lit(0.0))
    rows = vectors.select("query_id", most.alias("most"), floor.alias("floor"), F.explode("v").alias("e"))
    lacking = F.col("floor") - (F.col("most") - F.col("e.weight") * F.col("e.top")) - F.lit(MARGIN)
    need = F.when(F.col("e.weight") > 0, lacking / F.col("e.weight")).otherwise(F.lit(0.0))
    rows = rows.select("query_id", "e.token", "e.weight", "floor", need.alias("need"), "e.bucket")
    kept, table = _small(rows, size, "question-weights")
    queries = (len(pc.unique(table.column("query_id"))) if table is not None
               else kept.agg(F.count_distinct("query_id")).first()[0])
    return Asked(kept, size, queries, buckets)


# --- search ---

def _lists(table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Places and weights of every token of one shard, in place order."""
    table = table.sort_by("token")
    tokens = table.column("token").combine_chunks()
    places, weights = (table.column(c).combine_chunks() for c in ("places", "weights"))
    if not len(tokens):
        return {}
    sizes = np.cumsum(np.r_[0, pc.list_value_length(places).to_numpy(zero_copy_only=False)])
    flat_places, flat_weights = places.flatten().to_numpy(), weights.flatten().to_numpy()
    codes = tokens.dictionary_encode()
    edges = np.r_[0, np.flatnonzero(np.diff(codes.indices.to_numpy())) + 1, len(tokens)]
    out = {}
    for a, b in zip(edges[:-1], edges[1:]):
        p, w = flat_places[sizes[a]:sizes[b]], flat_weights[sizes[a]:sizes[b]]
        order = np.argsort(p, kind="stable")
        out[tokens[int(a)].as_py()] = (p[order], w[order])
    return out


def best_of_shard(lists: dict[str, tuple[np.ndarray, np.ndarray]], asked: list[tuple[str, float]], k: int,
                  floor: float, work: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of one query's best ``k`` in one shard, ties by place.

    Tokens go by what they can add at most. While those left could carry an
    unseen document to the ``k``-th partial score, their postings add to all documents; after that only documents still
    in reach are looked up. ``work`` and ``seen`` are zeroed arrays, and are zeroed again.
    """
    terms = sorted(((w * lists[t][1].max(), t, w) for t, w in asked if t in lists), reverse=True)
    most = np.cumsum([0.0] + [m for m, _, _ in reversed(terms)])[::-1]  # what the terms from i on can add
    i, size = 0, len(work)
    while i < len(terms) and most[i] + MARGIN >= floor:
        _, token, weight = terms[i]
        places, weights = lists[token]
        work[places] += weight * weights
        seen[places] = True
        i += 1
        if i < len(terms) and size > k and (i & (i - 1) == 0 or i % 8 == 0):
            floor = max(floor, np.partition(work, size - k)[size - k])
    near = np.flatnonzero(seen & (work + most[i] + MARGIN >= floor)) if i < len(terms) else np.flatnonzero(seen)
    score = work[near]
    work[:], seen[:] = 0, False
    for j, (_, token, weight) in enumerate(terms[i:], i):
        inside = score + most[j] + MARGIN >= floor
        near, score = near[inside], score[inside]
        places, weights = lists[token]
        at = np.minimum(np.searchsorted(places, near), len(places) - 1)
        hit = places[at] == near
        score[hit] += weight * weights[at[hit]]
        if len(near) > k:
            floor = max(floor, np.partition(score, len(near) - k)[len(near) - k])
    score = np.round(score, DIGITS)
    if len(near) > k:
        edge = np.partition(score, len(near) - k)[len(near) - k]
        near, score = near[score >= edge], score[score >= edge]
    order = np.lexsort((near, -score))[:k]
    return near[order], score[order]


def _kernel(k: int, names: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Best ``k`` of one shard for every query of ``asked(query_id, token, weight, floor)``."""
    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        lists = _lists(blocks)
        size = 1 + max((int(p[-1]) for p, _ in lists.values()), default=0)
        work, seen, shard = np.zeros(size), np.zeros(size, dtype=bool), blocks.column("shard")[0].as_py() if len(blocks) else 0
        asked = asked.sort_by([("query_id", "ascending"), ("token", "ascending")])
        ids = asked.column("query_id").combine_chunks().dictionary_encode()
        codes = ids.indices.to_numpy()
        tokens, weights, floors = (asked.column(c).to_pylist() for c in ("token", "weight", "floor"))
        edges = np.r_[0, np.flatnonzero(np.diff(codes)) + 1, len(codes)] if len(codes) else np.array([0])
        query, place, score = [], [], []
        for a, b in zip(edges[:-1], edges[1:]):
            p, s = best_of_shard(lists, list(zip(tokens[a:b], weights[a:b])), k, floors[a], work, seen)
            query.append(np.full(len(p), codes[a]))
            place.append(p)
            score.append(s)
        n = sum(map(len, place))
        flat = lambda parts, kind: np.concatenate(parts).astype(kind) if n else np.zeros(0, kind)
        return pa.Table.from_arrays([
            ids.dictionary.take(pa.array(flat(query, "int64"))) if n else pa.array([], names.field(0).type),
            pa.array(np.full(n, shard, "int32")), pa.array(flat(place, "int32")), pa.array(flat(score, "float64"))], schema=names)

    return run


def index_topk(index: Index, asked: Asked, k: int, *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Best ``k`` documents per query: ``(query_id, chunk_id, score, rank)``, ties by id.

    A measured set of questions goes to every task; a larger one is cut into
    groups by query, and a shard's blocks meet each group in a task of their own. The
    kernel is the same either way.
    """
    out = T.StructType([T.StructField("query_id", asked.rows.schema["query_id"].dataType), T.StructField("shard", T.IntegerType()),
                        T.StructField("place", T.IntegerType()), T.StructField("score", T.DoubleType())])
    kernel = _kernel(k, to_arrow_schema(out))
    needs = asked.rows.groupBy("token").agg(F.min("need").alias("need"))
    wanted = (opened(index.postings, asked.buckets).join(F.broadcast(needs) if asked.size.fits() else needs, "token")
              .filter(F.col("top") >= F.col("need")).select("shard", "token", "places", "weights"))
    asking = asked.rows.select("query_id", "token", "weight", "floor")
    groups = max(1, -(-asked.size.bytes // max(1, broadcast_bytes)))
    if groups == 1:
        shared = asking.sparkSession.sparkContext.broadcast(asking.toArrow())
        found = wanted.groupBy("shard").applyInArrow(lambda table: kernel(table, shared.value), out)
    else:
        group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("part")
        left = wanted.join(asking.select("token", group).distinct(), "token")
        right = asking.select("*", group).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(index.shards - 1))))
        found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(
            lambda blocks, questions: kernel(blocks, questions), out)
    # Hits worse than k others by score alone go before ids are looked up.
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    hits = found.withColumn("nth", F.rank().over(by_score)).filter(F.col("nth") <= k).drop("nth")
    bound = asked.queries * k * index.shards * BYTES_PER_HIT  # a shard returns at most k hits a query
    named = index.documents.select("chunk_id", "shard", "place").join(
        F.broadcast(hits) if bound <= broadcast_bytes else hits, ["shard", "place"])
    return top_k(named.select("query_id", "chunk_id", "score"), k, ["query_id"], [F.col("score").desc(), F.col("chunk_id")])
