"""The prefix trie of rebuilt conversations, from composable fingerprints.

Turn ``j`` of a conversation adds ``x * r^j`` to a sum modulo a prime, ``x`` being a hash
of its role and text. A run of turns is then an element ``(sum, length)`` of a
monoid, ``(a, n) * (b, m) = (a + r^n * b, n + m)``, and the fingerprint of every
prefix of a rebuilt conversation follows from its base's head and its own
suffix without its texts. Equal fingerprints of equal depth make a node. Every
node is checked: its members must have one parent, and the turns it refers to
one text; else all is done again with another seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count as numbers

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..operators.ordinals import with_running_sums
from .common import join_side, stored

PRIME = (1 << 61) - 1
MEMBERS = 14  # bits of an id that number the members of one listed run
NODE = ["depth", "f1", "f2"]


# --- arithmetic modulo the prime, on whole arrays ---

def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    middle = a1 * b0 + a0 * b1
    return reduced(np.uint64(2) * a1 * b1 + (middle >> np.uint64(30))
                   + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a0 * b0)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def total(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return reduced(a + b)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return reduced(a + (np.uint64(PRIME) - b))


class Powers:
    """Powers of one base: the low 16 bits of the exponent from one table, the rest from another that grows."""

    def __init__(self, base: int):
        self.low = np.array(self._row(base, 1 << 16), np.uint64)
        self.step, self.high = pow(base, 1 << 16, PRIME), [1]

    @staticmethod
    def _row(base: int, n: int) -> list[int]:
        out = [1]
        for _ in range(n - 1):
            out.append(out[-1] * base % PRIME)
        return out

    def at(self, exponents: np.ndarray) -> np.ndarray:
        upper = exponents >> 16
        while len(self.high) <= (upper.max() if len(upper) else 0):
            self.high.append(self.high[-1] * self.step % PRIME)
        return product(self.low[exponents & 0xFFFF], np.array(self.high, np.uint64)[upper])


def running(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Inclusive sums modulo the prime within runs that begin at ``starts``; a batch is far shorter than 2^31."""
    run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(values)]))

    def within(part: np.ndarray) -> np.ndarray:
        sums = np.cumsum(part, dtype=np.uint64)
        return sums - (sums[starts] - part[starts])[run]

    return total(product(reduced(within(values >> np.uint64(32))), np.full(len(values), 1 << 32, np.uint64)),
                 reduced(within(values & np.uint64(0xFFFFFFFF))))


def bases(seed: int) -> tuple[int, int]:
    return tuple(int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:7], "big") | 1 for i in (1, 2))


# --- prefixes of the stored conversations ---

def _scan(seed: int):
    """Places and prefix sums within the sorted partition. A conversation may go on in the next
    one: the first and the last of a partition get a row with their totals (``edge``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, part = [Powers(b) for b in bases(seed)], TaskContext.get().partitionId()
        conv, turns, sums, first = None, 0, [0, 0], True
        names = ["conv_id", "part", "edge", "pos", "turn", "digest", "bytes", "h1", "h2", "g1", "g2"]

        def edge():
            values = [conv, part, True, turns, None, None, None, *sums, None, None]
            kinds = [pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * 8]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_numpy()
            starts = np.r_[0, np.flatnonzero(np.diff(ids)) + 1]
            pos = np.arange(1, len(ids) + 1) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
            head = np.arange(len(ids)) < (starts[1] if len(starts) > 1 else len(ids))
            goes_on = conv is not None and ids[0] == conv
            if goes_on:
                pos = pos + np.where(head, turns, 0)
            after, before = [], []
            for i, power in enumerate(powers):
                x = reduced(batch.column(f"x{i + 1}").to_numpy().view(np.uint64))
                terms = product(x, power.at(pos))
                h = running(terms, starts)
                if goes_on:
                    h = np.where(head, total(h, np.full(len(h), sums[i], np.uint64)), h)
                after.append(h.view(np.int64))
                before.append(difference(h, terms).view(np.int64))
            if first and len(starts) > 1 or (conv is not None and not goes_on and first):
                if not goes_on and conv is None:  # the first conversation ends in this batch
                    end = starts[1] - 1
                    conv, turns, sums = int(ids[end]), int(pos[end]), [int(a[end]) for a in after]
                elif goes_on and len(starts) > 1:
                    end = starts[1] - 1
                    turns, sums = int(pos[end]), [int(a[end]) for a in after]
                yield edge()
                first = False
            conv, turns, sums = int(ids[-1]), int(pos[-1]), [int(a[-1]) for a in after]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, bool)), pa.array(pos),
                 batch.column("turn"), batch.column("x1"), batch.column("bytes"), *map(pa.array, after + before)], names=names)
        if conv is not None:
            yield edge()

    return run


def _carried(carry: dict, seed: int):
    """Adds what earlier partitions hold of a row's conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [Powers(b) for b in bases(seed)]
        for batch in batches:
            ids, parts = batch.column("conv_id").to_numpy(), batch.column("part").to_numpy()
            pos, columns = batch.column("pos").to_numpy().copy(), {
                c: batch.column(c).to_numpy().view(np.uint64).copy() for c in ("h1", "h2", "g1", "g2")}
            for part, conv, n, *sums in [c for part in np.unique(parts) for c in carry.get(int(part), ())]:
                here = (ids == conv) & (parts == part)
                pos[here] += n
                for c in columns:
                    i = int(c[1]) - 1
                    factor = np.full(here.sum(), int(powers[i].at(np.array([n]))[0]), np.uint64)
                    columns[c][here] = total(product(columns[c][here], factor), np.full(here.sum(), sums[i], np.uint64))
            out = batch
            for c, v in [("pos", pos), *((c, v.view(np.int64)) for c, v in columns.items())]:
                out = out.set_column(out.schema.get_field_index(c), c, pa.array(v))
            yield out

    return run


def turn_prefixes(conversations: DataFrame, seed: int) -> DataFrame:
    """``conv_id, part, pos, turn, digest, bytes, h1, h2, g1, g2``: every turn with its place and the
    fingerprints of the prefixes that end with (h) and before it (g).

    Sorted into ranges, so a long conversation spreads over several; the totals
    at range edges, at most two rows a range, meet in the driver.
    """
    rows = _turns(conversations, seed).withColumn("nth", F.monotonically_increasing_id())  # parts equal rows
    order = ["conv_id", "turn", "role", "x1", "nth"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "x1", "x2", "bytes")
    scanned = stored(dealt.mapInArrow(_scan(seed), "conv_id bigint, part int, edge boolean, pos bigint, turn bigint, digest bigint,"
                                                   " bytes bigint, h1 bigint, h2 bigint, g1 bigint, g2 bigint"), "turns")
    edges = {(r["conv_id"], r["part"]): (r["pos"], r["h1"], r["h2"]) for r in scanned.where("edge").collect()}
    carry, before, r = {}, {}, bases(seed)
    for conv, part in sorted(edges):
        n, *sums = before.get(conv, (0, 0, 0))
        if n:
            carry.setdefault(part, []).append((part, conv, n, *sums))
        m, *more = edges[conv, part]
        before[conv] = (n + m, *[(a + pow(b, n, PRIME) * c) % PRIME for a, b, c in zip(sums, r, more)])
    turns = scanned.where("not edge").drop("edge")
    return turns.mapInArrow(_carried(carry, seed), turns.schema) if carry else turns


def _turns(conversations: DataFrame, seed: int) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"),
        F.xxhash64(F.lit(seed), text("role"), text("text")).alias("x1"),
        F.xxhash64(text("text"), F.lit(seed), text("role")).alias("x2"), F.octet_length(text("text")).cast("bigint").alias("bytes"))


# --- members: one row for each turn of each rebuilt conversation ---

def _families(turns: DataFrame, family: int, heads: int) -> DataFrame:
    """Per conversation: head length asked for (h) and had (k), the base's head, and the fingerprints where both are cut."""
    entry = F.struct("pos", "h1", "h2", "g1", "g2", "bytes", "turn", "digest")
    known = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(
        F.when(F.col("pos") < heads, entry))).alias("head"))
    base = known.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base_id"), F.col("n").alias("base_n"), F.col("head").alias("base"))
    joined = known.withColumn("base_id", F.col("conv_id") - F.col("conv_id") % family).join(base, "base_id", "left")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    at = lambda array, n, f: F.coalesce(F.when(F.col(n) > 0, F.get(F.col(array), F.col(n).cast("int") - 1)[f]), F.lit(0).cast("bigint"))
    return (joined.withColumn("h", h).withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
            .withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
            .withColumns({"c1": at("head", "h", "h1"), "c2": at("head", "h", "h2"), "b1": at("base", "k", "h1"), "b2": at("base", "k", "h2")})
            .withColumn("base", F.slice("base", 1, F.col("k").cast("int"))).drop("head", "base_n"))


def _composed(seed: int):
    """Base head times own suffix: ``b + r^(k - h) * (prefix - c)``, the length ``k + pos - h``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = {c: batch.column(c).to_numpy() for c in ("pos", "h", "k", "h1", "h2", "g1", "g2", "c1", "c2", "b1", "b2")}
            fields = {}
            for i, base in enumerate(bases(seed), 1):
                back = np.array([pow(base, -e, PRIME) for e in range(1 + int((value["h"] - value["k"]).max(initial=0)))], np.uint64)
                factor = back[value["h"] - value["k"]]
                head, cut = value[f"b{i}"].view(np.uint64), value[f"c{i}"].view(np.uint64)
                for f, c in (("f", "h"), ("g", "g")):
                    own = difference(value[f"{c}{i}"].view(np.uint64), cut)
                    fields[f"{f}{i}"] = total(head, product(factor, own)).view(np.int64)
            depth = value["k"] + value["pos"] - value["h"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(depth), *[pa.array(fields[c]) for c in ("f1", "f2", "g1", "g2")],
                 batch.column("bytes"), batch.column("conv_id"), batch.column("pos"), batch.column("turn"), batch.column("digest"),
                 pa.array(depth == batch.column("length").to_numpy())], names=[f.split()[0] for f in MEMBER.split(", ")])

    return run


MEMBER = ("conv_id bigint, depth bigint, f1 bigint, f2 bigint, g1 bigint, g2 bigint, bytes bigint, ref_conv bigint, "
          "ref_pos bigint, ref_turn bigint, digest bigint, last boolean")


def _members(turns: DataFrame, families: DataFrame, seed: int) -> DataFrame:
    e = F.col("e")
    heads = families.select("conv_id", "base_id", "length", F.explode("base").alias("e")).select(
        "conv_id", e["pos"].alias("depth"), e["h1"].alias("f1"), e["h2"].alias("f2"), e["g1"].alias("g1"), e["g2"].alias("g2"),
        e["bytes"].alias("bytes"), F.col("base_id").alias("ref_conv"), e["pos"].alias("ref_pos"), e["turn"].alias("ref_turn"),
        e["digest"].alias("digest"), (e["pos"] == F.col("length")).alias("last"))
    cuts = families.where("n > h").select("conv_id", "h", "k", "length", "c1", "c2", "b1", "b2")
    own = turns.join(cuts, "conv_id").where("pos > h").select(
        "conv_id", "pos", "turn", "digest", "bytes", "length", "h", "k", "h1", "h2", "g1", "g2", "c1", "c2", "b1", "b2")
    return heads.unionByName(own.mapInArrow(_composed(seed), MEMBER))


# --- nodes ---

def _grouped(members: DataFrame) -> DataFrame:
    low = lambda c: F.min(c).alias(c)
    both = ("g1", "g2", "digest", "ref_conv", "ref_pos")
    return members.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"),
        F.max("ref_turn").alias("ref_turn"), *[low(c) for c in both], *[F.max(c).alias(f"{c}_") for c in both])


def _sound(nodes: DataFrame, conversations: DataFrame, seed: int) -> bool:
    """One parent and one turn per node. Members that refer to one stored turn agree; where a node
    refers to several, their roles and texts are compared."""
    if nodes.where("g1 <> g1_ or g2 <> g2_ or digest <> digest_").limit(1).count():
        return False
    several = stored(nodes.where("ref_conv <> ref_conv_ or ref_pos <> ref_pos_").select("digest").distinct(), "several")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(text("role").alias("role"), text("text").alias("text"))
    said = conversations.select(F.xxhash64(F.lit(seed), text("role"), text("text")).alias("digest"), turn.alias("said"))
    told = said.join(join_side(several), "digest", "left_semi").groupBy("digest").agg(
        F.min("said").alias("a"), F.max("said").alias("b"))
    return not told.where("a <> b").limit(1).count()


def _digest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's listed runs, read as a sorted stream."""
    node, state = None, None

    def out():
        return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in node], pa.array([state.hexdigest()])],
                                          names=[*NODE, "ends_sha256"])

    for batch in batches:
        for *here, run in zip(*[batch.column(c).to_pylist() for c in (*NODE, "run")]):
            if here != node:
                if node is not None:
                    yield out()
                node, state = here, hashlib.sha256(run.encode())
            else:
                state.update(b"," + run.encode())
    if node is not None:
        yield out()


def _ends(ending: DataFrame) -> DataFrame:
    """``depth, f1, f2, ends_sha256`` of the nodes where conversations end.

    Ids are distinct, so those that share all but their last bits make a run of
    bounded length. A node with one run is hashed as it is; the runs of others
    pass a task in order, only the state of the hash is kept.
    """
    runs = stored(ending.groupBy(*NODE, F.shiftright("conv_id", MEMBERS).alias("high")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("run")), "runs")
    counted = runs.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"), F.first("run").alias("run"))
    whole = counted.where("n = 1").select(*NODE, F.sha2("run", 256).alias("ends_sha256"))
    long = runs.join(counted.where("n > 1").select(*NODE), NODE, "left_semi")
    streamed = long.repartition(*NODE).sortWithinPartitions(*NODE, "high").select(*NODE, "run").mapInArrow(
        _digest_runs, "depth bigint, f1 bigint, f2 bigint, ends_sha256 string")
    return whole.unionByName(streamed)


def prefix_trie(conversations: DataFrame, *, family: int = 5, heads: int = 9) -> DataFrame:
    """The nodes of the trie of rebuilt ``conversations(conv_id, turn, role, text)``.

    Conversation ``c`` is rebuilt from the first ``h`` turns of ``c - c % family`` (all if fewer, none
    if there is no such conversation) and its own after its first ``h``, ``h`` being the
    unsigned CRC-32 of ``c`` in decimal, modulo ``heads``. A node is a distinct sequence of first
    turns; its members are the rebuilt conversations that start with it.

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (root: null), ``n_convs``,
    ``n_children``, ``n_leaves`` and ``saved_tokens`` (over the subtree), ``ends_sha256``
    (of the ids of members that end there), and ``ref_conv, ref_pos, ref_turn``, the stored turn a node ends with.

    Turns go by number, null first; equal numbers by role, then by a hash of
    the text. Null role or text is empty; repeated rows are turns of their own; rows without
    ``conv_id`` are left out, ``%`` keeps the sign of a negative one. An empty
    table gives no rows. A node's subtree sums add the parts its members own: a
    conversation owns the nodes of which it is the smallest member, always the
    lower end of its path.
    """
    for seed in numbers(1):
        turns = turn_prefixes(conversations, seed)
        families = stored(_families(turns, family, heads), "families")
        members = stored(_members(turns, families, seed), "members")
        grouped = stored(_grouped(members), "nodes")
        if _sound(grouped, conversations, seed):
            break
    zero = F.lit(0).cast("bigint")
    top = {c: F.lit(None if c in ("g1", "g2", "ref_conv", "ref_pos", "ref_turn") else 0).cast("bigint")
           for c in ("depth", "f1", "f2", "g1", "g2", "bytes", "ref_conv", "ref_pos", "ref_turn")}
    root = families.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").withColumns(top)
    nodes = grouped.select(*NODE, "g1", "g2", "bytes", "ref_conv", "ref_pos", "ref_turn", "n_convs", "conv_id").unionByName(root)
    above = [(F.col("depth") - 1).alias("depth"), F.col("g1").alias("f1"), F.col("g2").alias("f2")]
    children = grouped.select(*above).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = stored(nodes.withColumn("value", (F.col("n_convs") - 1) * F.col("bytes"))
                   .withColumn("leaf", (F.col("n_children") == 0).cast("bigint")), "nodes-valued")

    own = stored(nodes.groupBy("conv_id").agg(F.sum("value").alias("own"), F.max("leaf").alias("own_leaf"),
                                              F.min("depth").alias("top")), "owners")
    paths = members.select("conv_id", *NODE).unionByName(families.select("conv_id", *[zero.alias(c) for c in NODE]))
    lent = paths.join(own, "conv_id").where("depth < top").groupBy(*NODE).agg(
        F.sum("own").alias("lent"), F.sum("own_leaf").alias("lent_leaves"))
    tails = with_running_sums(nodes.where("n_convs > 1").select("conv_id", *NODE, "value"), {"tail": F.col("value")},
                              [-F.col("depth")], [F.col("conv_id")]).select(*NODE, "tail")
    parents = nodes.select(*[F.col(c).alias(f"up_{c}") for c in NODE], F.col("conv_id").alias("parent_conv_id"))
    tops = nodes.join(own.select("conv_id", "top"), "conv_id").where("depth = top and depth > 0").select(
        *NODE, (F.col("depth") - 1).alias("up_depth"), F.col("g1").alias("up_f1"), F.col("g2").alias("up_f2"))
    attached = tops.join(parents, ["up_depth", "up_f1", "up_f2"]).select(*NODE, "parent_conv_id")
    ending = members.where("last").select("conv_id", *NODE).unionByName(
        families.where("length = 0").select("conv_id", *[zero.alias(c) for c in NODE]))
    out = (nodes.join(own.select("conv_id", "own_leaf"), "conv_id").join(lent, NODE, "left").join(tails, NODE, "left")
           .join(attached, NODE, "left").join(_ends(ending), NODE, "left"))
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children", (F.col("own_leaf") + F.coalesce("lent_leaves", zero)).alias("n_leaves"),
        (F.coalesce("tail", zero) + F.coalesce("lent", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "ref_conv", "ref_pos", "ref_turn")
