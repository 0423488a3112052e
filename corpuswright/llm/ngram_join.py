"""Jaccard self-join on word n-gram sets, by token-combination prefixes, and its components.

Tokens are 64-bit hashes of shingles, ordered by rising frequency, then hash.
Two sets that link share at least ``c = ceil(t n)`` tokens of either, so
their first ``k`` shared tokens lie in the first ``n - c + k`` of both. Either the first is
rare: then it is a key both have among their first ``n - c + 1`` tokens. Or all ``k`` are
frequent: then both have their combination as a key. So rare tokens are
indexed alone and frequent ones in pairs (``k`` = 2), which splits the long lists of
common tokens. Sets of ``LONG`` tokens or more would have too many pairs and use
single tokens throughout; sets near that size use both, so no link is lost.

Equal sets are one node. A key's members are first verified against its most
central member; only pairs in different components after that are compared with
each other, so a group of copies costs its size, not its square. The frequency of
a token is that of its cell in a fixed table of ``CELLS`` counts: any order gives
the same links.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import components, fresh, join_side, mix, releasing, stored, text_rows
from .hashing import block_rows, pieces, shingle_sets, summed_cells

SHINGLE = 3
PERCENT = 90
CELLS = 1 << 20
LONG = 1000
OFTEN = 64      # a token is frequent beyond this count above twice the mean cell
SALT = np.uint64(0xD6E8FEB86659FD93)


def _texts(column) -> list[bytes]:
    """Lower-cased A to Z, as UTF-8."""
    return [t.encode("utf-8", "surrogatepass").lower() for t in column.to_pylist()]


def _digests(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, list[bytes]]:
    """Size and 128-bit digest of each text's set, whatever the order of its tokens."""
    edges = np.searchsorted(doc, np.arange(n + 1))
    low = np.r_[np.uint64(0), np.cumsum(mix(hashes), dtype=np.uint64)]
    high = np.r_[np.uint64(0), np.cumsum(mix(hashes ^ SALT), dtype=np.uint64)]
    sizes = np.diff(edges)
    both = np.stack([low[edges[1:]] - low[edges[:-1]], high[edges[1:]] - high[edges[:-1]]], axis=1)
    return sizes, [row.tobytes() for row in both]


def _survey(shingle: int):
    def run(batches):
        import pyarrow as pa
        names = ["doc_id", "body", "n", "digest", "block", "counts"]
        cells = np.zeros(CELLS, np.int64)
        for batch in pieces(batches, 1):
            texts = _texts(batch.column(1))
            sizes, digests = [], []
            for a, b, s, d in shingle_sets(texts, shingle):
                cells += np.bincount((s % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
                more, keys = _digests(s, d, b - a)
                sizes.extend(more.tolist())
                digests.extend(keys)
            m = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        used, counts = block_rows(cells)
        m = len(used)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(used, pa.int32()),
             pa.array(counts, pa.binary())], names=names)
    return run


def prefix_keys(tokens: np.ndarray, frequency: np.ndarray, often: int, percent: int = PERCENT):
    """Keys of one set: ``key, k, place`` with the place, from 0, of the key's last token in the order."""
    n = len(tokens)
    order = np.lexsort((tokens, frequency))
    tokens, common = tokens[order], frequency[order] > often
    least = -(-percent * n // 100)
    singles = n - least + 1
    rare = np.flatnonzero(~common[:singles])
    out = [(mix(tokens[rare]), np.ones(len(rare), np.int32), rare)]
    hot = np.flatnonzero(common[:singles + 1])
    if len(hot) > 1 and _pairs_used(n, percent):
        i, j = np.triu_indices(len(hot), 1)
        out.append((mix(mix(tokens[hot[i]]) + tokens[hot[j]] + SALT), np.full(len(i), 2, np.int32), hot[j]))
    if _singles_used(n, percent):
        alone = hot[hot < singles]
        out.append((mix(tokens[alone]), np.ones(len(alone), np.int32), alone))
    return tuple(np.concatenate(c) for c in zip(*out))


def _pairs_used(n: int, percent: int) -> bool:
    return n * percent <= LONG * 100


def _singles_used(n: int, percent: int) -> bool:
    return n * 100 >= LONG * percent


def _keys(frequency, often: int, shingle: int, percent: int):
    def run(batches):
        import pyarrow as pa
        cells = frequency.value
        for batch in pieces(batches, 0):
            texts, nodes, wanted = _texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b, s, d in shingle_sets(texts, shingle):
                _, digests = _digests(s, d, b - a)
                edges = np.searchsorted(d, np.arange(b - a + 1))
                found = []
                for i in range(b - a):
                    if digests[i] != wanted[a + i] or edges[i + 1] == edges[i]:
                        continue
                    own = s[edges[i]:edges[i + 1]]
                    keys, ks, places = prefix_keys(own, cells[(own % np.uint64(CELLS)).astype(np.int64)], often, percent)
                    m = len(keys)
                    found.append((keys.view(np.int64), np.full(m, nodes[a + i], np.int64), np.full(m, len(own), np.int32),
                                  ks, places.astype(np.int32)))
                if found:
                    columns = [np.concatenate(c) for c in zip(*found)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "n", "k", "place"])
    return run


def mark_of(tokens: np.ndarray) -> bytes:
    """Counts of a set's tokens in a power of two of buckets, about four to a bucket; 255 stands for any more."""
    buckets = 1 << max(0, (len(tokens) // 4).bit_length())
    return np.minimum(np.bincount((tokens & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def most_shared(x: bytes, y: bytes) -> int:
    """No less than the number of tokens two sets with these marks share."""
    x, y = (np.frombuffer(m, np.uint8).astype(np.int64) for m in (x, y))
    x[x == 255] = y[y == 255] = 1 << 40
    least = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, least).sum(axis=0), y.reshape(-1, least).sum(axis=0)).sum())


def _sets(shingle: int, of=np.ndarray.tobytes):
    def run(batches):
        import pyarrow as pa
        for batch in pieces(batches, 0):
            texts, wanted = _texts(batch.column(0)), batch.column(2).to_pylist()
            for a, b, s, d in shingle_sets(texts, shingle):
                _, digests = _digests(s, d, b - a)
                edges = np.searchsorted(d, np.arange(b - a + 1))
                mine = [i for i in range(b - a) if digests[i] == wanted[a + i]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(a, b - a).take(pa.array(mine, pa.int64())),
                     pa.array(np.diff(edges)[mine], pa.int64()),
                     pa.array([of(s[edges[i]:edges[i + 1]]) for i in mine], pa.binary())], names=["node", "size", "tokens"])
    return run


def _shared_tokens(x: bytes, y: bytes) -> int:
    return len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))


def _verify(percent: int, shared=_shared_tokens):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            a, b, n, m, x, y = (batch.column(i).to_pylist() for i in range(6))
            both = [shared(*xy) for xy in zip(x, y)]
            good = [i for i, c in enumerate(both) if 100 * c >= percent * (n[i] + m[i] - c)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], names=["a", "b"])
    return run


def _possible(percent: int, x: str, y: str) -> str:
    """Enough tokens can be shared when the key's tokens are the first shared ones."""
    return (f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n) and {100 + percent} * ({x}.k + "
            f"least({x}.n - {x}.place, {y}.n - {y}.place) - 1) >= {percent} * ({x}.n + {y}.n)")


def _shared(keys: DataFrame, percent: int) -> DataFrame:
    """Rows of keys with company of a like size, with ``step`` and the ``head`` of it.

    Along a key's members by size, a step begins where the next size is too large for the one before: no set
    links across, so steps are groups of their own, and rows alone in one go.
    """
    sizes = Window.partitionBy("key", "k").orderBy("n", "node")
    far = f"{percent} * n > 100 * before"
    stepped = (keys.withColumn("before", F.lag("n").over(sizes)).withColumn("after", F.lead("n").over(sizes))
               .where(f"100 * before >= {percent} * n or {percent} * after <= 100 * n")
               .withColumn("step", F.sum(F.expr(f"if(before is null or {far}, 1, 0)")).over(sizes)))
    return stepped.drop("before", "after").withColumn(
        "head", F.min(F.struct("place", "node", "n")).over(Window.partitionBy("key", "k", "step")))


def links(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``(rows, edges)``: each row's ``doc_id, body, n, digest, node`` (``body`` is a hash of its text), and node pairs that connect the linked nodes.

    Nodes are distinct sets. Edges are verified links; of the links inside a
    component that others already connect, not all are listed. Every linked pair ends up in
    one component. Empty sets have no node.
    """
    texts = text_rows(docs)
    survey = stored(texts.withColumn("body", F.xxhash64("text")).mapInArrow(
        releasing(_survey(shingle)), "doc_id bigint, body bigint, n bigint, digest binary, block int, counts binary"), "survey")
    rows = survey.where("block is null").select("doc_id", "body", "n", "digest")
    # A table of CELLS counts, a fixed size whatever the corpus.
    cells = np.minimum(summed_cells(survey, CELLS), np.iinfo(np.int32).max).astype(np.int32)
    often = int(2 * cells.mean()) + OFTEN
    nodes = stored(rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"))
                   .withColumn("node", F.monotonically_increasing_id()), "nodes")
    chosen = texts.join(join_side(nodes.select("doc", "digest", "node").withColumnRenamed("digest", "_digest")),
                        F.col("doc_id").eqNullSafe(F.col("doc"))).select("text", "node", F.col("_digest").alias("digest"))
    frequency = docs.sparkSession.sparkContext.broadcast(cells)
    keys = chosen.mapInArrow(releasing(_keys(frequency, often, shingle, percent)), "key bigint, node bigint, n int, k int, place int")
    shared = stored(_shared(keys, percent), "shared")
    star = (shared.where("node <> head.node")
            .selectExpr("struct(node, n, k, place) as x", "struct(head.node as node, head.n as n, k, head.place as place) as y")
            .where(_possible(percent, "x", "y"))
            .selectExpr("least(x.node, y.node) as a", "greatest(x.node, y.node) as b").distinct())
    first = _verified(stored(star, "pairs"), chosen, shingle, percent)
    labels = components(first)
    same = ["key", "k", "step"]
    placed = shared.join(join_side(labels), "node", "left").select(
        *same, F.struct("node", "n", "k", "place").alias("x"), F.coalesce("component", "node").alias("c"))
    group = Window.partitionBy(*same)
    open_keys = stored(placed.withColumn("low", F.min("c").over(group)).withColumn("high", F.max("c").over(group))
                       .where("low <> high").drop("low", "high"), "open")
    other = open_keys.select(*same, F.col("x").alias("y"), F.col("c").alias("d"))
    rest = (open_keys.join(other, same).where("x.node < y.node and c <> d and " + _possible(percent, "x", "y"))
            .selectExpr("x.node as a", "y.node as b").distinct().join(star, ["a", "b"], "left_anti"))
    second = _verified(stored(rest, "pairs"), chosen, shingle, percent)
    edges = first.union(second)
    return rows.join(nodes.select("digest", "node"), "digest", "left"), edges


def _verified(pairs: DataFrame, chosen: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose whole sets link; sets travel only for pairs whose marks, a 32nd of their size, allow a link."""
    likely = _compared(pairs, chosen, _sets(shingle, mark_of), _verify(percent, most_shared), "likely")
    return _compared(likely, chosen, _sets(shingle), _verify(percent), "edges")


def _compared(pairs: DataFrame, chosen: DataFrame, sets, verify, name: str) -> DataFrame:
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = chosen.join(join_side(stored(needed, "needed")), "node", "left_semi").select("text", "node", "digest")
    sets = stored(texts.mapInArrow(releasing(sets), "node bigint, size bigint, tokens binary"), "sets").dropDuplicates(["node"])
    full = (pairs.join(sets.toDF("a", "n", "x"), "a").join(sets.toDF("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y"))
    return stored(full.mapInArrow(releasing(verify), "a bigint, b bigint"), name)


def linked(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    ``component_id`` is the smallest ``doc_id`` reachable by links. Null and
    empty texts and texts of white space have an empty set and stand alone; repeated rows
    share a set and so a component; a null ``doc_id`` is never the smallest unless alone. An empty
    table gives no rows.
    """
    rows, edges = links(docs, shingle, percent)
    rows = stored(rows, "rows")
    labels = components(edges)
    placed = rows.join(labels, "node", "left").select("doc_id", "n", F.coalesce("component", "node").alias("c"))
    least = placed.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "c", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component of ``docs``, with all columns: the one with the smallest ``doc_id`` (null last), then
    the smallest hash of its text.

    A row is told apart by ``doc_id`` and text, so rows that share an id go or stay each for itself; of rows equal in
    both one stays. Rows without words (null, empty, white space) are linked with nothing and all stay. An empty
    table gives no rows.
    """
    rows, edges = links(docs, shingle, percent)
    rows = stored(rows.where("node is not null").select("doc_id", "body", "node"), "rows")
    placed = rows.join(components(edges), "node", "left").withColumn("c", F.coalesce("component", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")).alias("first")
    doc, body, kept_doc, kept_body = fresh(docs, "doc", "body", "kept_doc", "kept_body")
    kept = stored(placed.groupBy("c").agg(first).select(F.col("first.doc_id").alias(kept_doc), F.col("first.body").alias(kept_body)), "kept")
    text = F.coalesce(F.col("text"), F.lit(""))
    told = docs.withColumns({doc: F.col("doc_id").cast("bigint"), body: F.xxhash64(text)})
    worded = text.rlike(r"[^ \t-\r]")
    chosen = told.where(worded).join(join_side(kept), F.col(doc).eqNullSafe(F.col(kept_doc)) & (F.col(body) == F.col(kept_body)), "left_semi")
    return chosen.dropDuplicates([doc, body]).unionByName(told.where(~worded)).drop(doc, body)
