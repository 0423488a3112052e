"""Removal of byte strings that occur more than once, by distributed prefix doubling over sampled positions.

A string of ``length`` bytes that starts at ``i`` has one anchor: the smallest hashed ``GRAM``-byte
gram among the first ``WINDOW`` positions from ``i``. Equal strings have it at the
same distance, so two equal strings meet where their anchors' suffixes are sorted
together, and anchors are about one position in ``WINDOW / 2``.

Anchors are ranked by their next 64 bytes; then pairs of ranks at that offset rank
128 bytes; positions whose rank is unique leave after each round. The anchors left
bring the bytes around them, in which all starts are ranked at the full length, past the
threshold. A rank that very many anchors share goes through one more round: starts at like distances from their
anchor share all but ``CLASS`` of the ``length`` bytes, so each anchor is ranked by these longer strings, one for
each class of distances, and classes whose string is unique leave. A rank is a 64-bit
fingerprint that Spark groups by, so equal strings have equal ranks on every
executor. What is crowded even then repeats nearly whole; it is not gathered: pieces of it are, and what a piece holds
once is looked for in the others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..sizing import measure
from .common import join_side, mix, stored, text_rows
from .hashing import BASE, INVERSE

LENGTH = 400
GRAM = 32
WINDOW = 256
STEP = 64          # bytes of the first rank; the anchor has at least LENGTH - WINDOW + 1 >= 2 * STEP bytes to its right
GATHERED = 5000    # different surroundings of one rank that a task may hold together
TOGETHER = 1 << 16  # starts of a stretch whose contexts meet in one row
CLASS = 16         # distances from the anchor that are ranked together
HOT = 10_000       # anchors of one rank from which on its join is a broadcast of the few such ranks
SIDE = 8 << 20     # bytes of positions or runs that are broadcast to the texts
PLACE = np.uint64(28)  # bits of a place: a text of 2^28 bytes or more is cut into stretches, see anchors()

STRETCH = 1 << 22  # starts of a stretch of a very long text, which also bounds the arrays made for one text

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, n.bit_length())
        for name, factor in (("up", BASE), ("down", INVERSE)):
            row = np.full(size, factor, np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"], _POWERS["down"]


class Prints:
    """Fingerprints of any substring of ``data`` from prefix sums."""

    def __init__(self, data: bytes):
        row = np.frombuffer(data, np.uint8)
        up, self.down = _powers(len(row) + 1)
        self.sums = np.empty(len(row) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((row.astype(np.uint64) + np.uint64(1)) * up[:len(row)], out=self.sums[1:])

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start])


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """``anchor, first start, last start, rank of 64 bytes, rank of the next 64`` of a text; starts of an anchor are consecutive."""
    n, window = len(data), min(WINDOW, length - 2 * STEP + 1)
    if n < length:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    if n > STRETCH + length:  # places must fit their bits; starts of one stretch, their strings whole
        parts = [(a, anchors(data[a:a + STRETCH + length - 1], length)) for a in range(0, n - length + 1, STRETCH)]
        return tuple(np.concatenate([p[i] + (a if i < 3 else 0) for a, p in parts]) for i in range(5))
    prints = Prints(data)
    last = n - length
    grams = prints.at(np.arange(last + window), GRAM)
    packed = ((grams >> PLACE) << PLACE) | np.arange(len(grams), dtype=np.uint64)
    rows = -(-len(packed) // window)
    grid = np.full(rows * window, np.iinfo(np.uint64).max, np.uint64)
    grid[:len(packed)] = packed
    grid = grid.reshape(rows, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(last + 1)
    best = np.minimum(behind[starts], ahead[starts + window - 1])
    at = (best & np.uint64((1 << 28) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    at, end = at[first], np.r_[first[1:] - 1, last]
    return at, first, end, prints.at(at, STEP).view(np.int64), prints.at(at + STEP, STEP).view(np.int64)


def _find(length: int):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            keys, found = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) >= length:
                    rows = anchors(data, length)
                    keys.extend([key] * len(rows[0]))
                    found.append(rows)
            if found:
                at, first, last, rank, following = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array((at - first).astype(np.int32)),
                     pa.array(rank), pa.array(following)], names=["body", "first", "last", "lead", "rank", "following"])
    return run


def _blocks(spots: list[dict]):
    """Neighbouring spots with about ``TOGETHER`` starts."""
    start = total = 0
    for i, s in enumerate(spots):
        if total > TOGETHER:
            yield spots[start:i]
            start, total = i, 0
        total += s["last"] - s["first"] + 1
    yield spots[start:]


def _contexts(length: int):
    """The bytes around the spots of a text, and runs of starts (no rank) whose string starts twice in one block of the text.

    A short pattern that goes on has an anchor in every period; of its strings the first place stays, for other texts to find.
    """
    def run(batches):
        import pyarrow as pa
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        names = [c.split()[0] for c in CONTEXT.split(", ")] + ["last"]
        for batch in batches:
            for row in range(batch.num_rows):
                body, text, spots = (batch.column(c)[row].as_py() for c in range(3))
                data = text.encode("utf-8", "surrogatepass")
                for block in _blocks(sorted(spots, key=lambda s: s["first"])):
                    firsts, runs = np.array([s["first"] for s in block]), []
                    low, high = np.zeros(len(block), np.int64), np.array([s["last"] for s in block]) - firsts
                    _, back, count = np.unique([s["rank"] for s in block], return_inverse=True, return_counts=True)
                    often = np.flatnonzero(count[back] > 1)
                    if len(often):
                        prints, number, place = _starts([data[block[i]["first"]:block[i]["last"] + length] for i in often.tolist()], length)
                        _, at, back, count = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
                        twice = count[back] > 1
                        stay = ~twice
                        stay[at] = True
                        start = firsts[often][number] + place
                        _, a, b = _runs(np.zeros(twice.sum(), np.int64), start[twice])
                        runs = list(zip(a.tolist(), b.tolist()))
                        mine, begin = np.unique(number[stay], return_index=True)
                        end = np.r_[begin[1:], stay.sum()] - 1
                        high[often] = -1
                        low[often[mine]], high[often[mine]] = place[stay][begin], place[stay][end]
                    out = [(s["rank"], s["members"], s["copies"], body, s["first"] + a, data[s["first"] + a:s["first"] + b + length], s["lead"] - a, None)
                           for s, a, b in zip(block, low.tolist(), high.tolist()) if b >= 0]
                    out += [(None, None, None, body, a, None, None, b) for a, b in runs]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)
    return run


CONTEXT = "rank bigint, members bigint, copies bigint, body string, first bigint, bytes binary, lead int"


def _classes(size: int, lead: int, length: int) -> tuple[np.ndarray, ...]:
    """Of a context with its anchor at ``lead``: for each class of distances the class, its first and last start, and where the string they share begins."""
    last = size - length
    classes = np.arange(max(0, lead - last) // CLASS, lead // CLASS + 1)
    first = np.maximum(0, lead - classes * CLASS - (CLASS - 1))
    return classes, first, np.minimum(last, lead - classes * CLASS), lead - classes * CLASS


def _longer(length: int):
    """The string that all starts of a class share, as a rank; its class and context."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, GATHERED):
                piece = batch.slice(at, GATHERED)
                contexts, leads = piece.column(5).to_pylist(), piece.column(6).to_pylist()
                base = np.cumsum([0] + [len(c) for c in contexts])[:-1]
                found = [_classes(len(c), lead, length) for c, lead in zip(contexts, leads)]
                row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                classes, begin = (np.concatenate([f[i] for f in found]) for i in (0, 3))
                prints = Prints(b"".join(contexts)).at(base[row] + begin, length - CLASS + 1)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix(prints + classes.astype(np.uint64)).view(np.int64)), piece.column(3).take(take), piece.column(4).take(take),
                     pa.array(classes), piece.column(2).take(take)], names=["rank", "body", "first", "class", "copies"])
    return run


def _parted(length: int):
    """Contexts of the classes that are left, each under its longer rank; a row holds those of a stretch of a text.

    Neighbouring classes too crowded to gather stay one context under its first rank: equal starts have one class, so all of a string's
    starts are on either side, and a place where a common passage goes on is one row, not one for each class.
    """
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for row in range(batch.num_rows):
                body, contexts, spots = (batch.column(c)[row].as_py() for c in range(3))
                left: dict[int, list] = {}
                for s in spots:
                    left.setdefault(s["first"], []).append(s)
                out = []

                def add(rank: int, members: int, c: dict, a: int, b: int) -> None:
                    out.append((rank, members, c["copies"], body, c["first"] + a, c["bytes"][a:b + length], c["lead"] - a))

                for c in contexts:
                    classes, low, high, _ = _classes(len(c["bytes"]), c["lead"], length)
                    crowded = []
                    for s in left.get(c["first"], ()):
                        i = s["class"] - int(classes[0])
                        if s["members"] > GATHERED:
                            crowded.append((int(low[i]), int(high[i])))
                        else:
                            add(s["rank"], s["members"], c, int(low[i]), int(high[i]))
                    joined: list[list[int]] = []
                    for a, b in sorted(crowded):
                        if joined and joined[-1][1] == a - 1:
                            joined[-1][1] = b
                        else:
                            joined.append([a, b])
                    for a, b in joined:
                        add(c["rank"], c["members"], c, a, b)
                kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.binary(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)] if out else
                                                 [pa.array([], k) for k in kinds],
                                                 names=["rank", "members", "copies", "body", "first", "bytes", "lead"])
    return run


def _refined(crowded: DataFrame, length: int) -> DataFrame:
    """Crowded contexts ranked once more, by strings ``CLASS - 1`` bytes short of the full length; unique ones leave."""
    longer = stored(crowded.mapInArrow(_longer(length), "rank bigint, body string, first bigint, class bigint, copies bigint"), "longer")
    again = longer.groupBy("rank").agg(F.count(F.lit(1)).alias("members"), F.sum("copies").alias("rows")).where("rows > 1")
    left = longer.join(join_side(stored(again.select("rank", "members"), "again")), "rank")
    part = F.floor(F.col("first") / TOGETHER).alias("part")  # a stretch of a text bounds what meets in one row
    spots = left.groupBy("body", part).agg(F.collect_list(F.struct("first", "rank", "members", "class")).alias("spots"))
    contexts = crowded.groupBy("body", part).agg(F.collect_list(F.struct("rank", "members", "copies", "first", "bytes", "lead")).alias("contexts"))
    rows = contexts.join(spots, ["body", "part"]).select("body", "contexts", "spots")
    return stored(rows.mapInArrow(_parted(length), CONTEXT), "parted")


def _starts(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Full-length fingerprint, context number and place in it of every start."""
    sizes = np.array([len(c) for c in contexts])
    counts = sizes - length + 1
    base = np.cumsum(sizes) - sizes
    number = np.repeat(np.arange(len(contexts)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return Prints(b"".join(contexts)).at(base[number] + place, length), number, place


def _runs(number: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive places of one context as ``number, from, to``."""
    edge = np.r_[True, (number[1:] != number[:-1]) | (place[1:] != place[:-1] + 1)] if len(number) else np.zeros(0, bool)
    first = np.flatnonzero(edge)
    return number[first], place[first], place[np.r_[first[1:] - 1, len(place) - 1]] if len(first) else place[first]


def _together(length: int):
    """Repeated starts among contexts sorted by rank; a rank cut by the batch's end waits for the next batch."""
    def repeated(rows):
        import pyarrow as pa
        prints, number, place = _starts([r[4] for r in rows], length)
        _, back = np.unique(prints, return_inverse=True)
        again = np.bincount(back, np.array([r[1] for r in rows])[number])[back] > 1
        n, a, b = _runs(number[again], place[again])
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][2] for i in n.tolist()], pa.string()), pa.array([rows[i][3] + x for i, x in zip(n.tolist(), a.tolist())], pa.int64()),
             pa.array([rows[i][3] + x for i, x in zip(n.tolist(), b.tolist())], pa.int64())], names=["body", "first", "last"])

    def run(batches):
        waiting: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, GATHERED):
                piece = batch.slice(at, GATHERED)
                waiting += zip(*(piece.column(c).to_pylist() for c in (0, 2, 3, 4, 5)))
                cut = len(waiting)
                while cut and waiting[cut - 1][0] == waiting[-1][0]:
                    cut -= 1
                if cut:
                    yield repeated(waiting[:cut])
                    waiting = waiting[cut:]
        if waiting:
            yield repeated(waiting)
    return run


def _pieces(length: int):
    """Starts of a rank too crowded to gather, a piece at a time.

    What repeats within a piece is a run at once (no print) and leaves its print once; a
    start alone in its piece leaves its print and place, to be looked for in the other pieces.
    """
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, GATHERED):
                piece = batch.slice(at, GATHERED)
                bodies, firsts = piece.column(3).to_pylist(), piece.column(4).to_numpy()
                prints, number, place = _starts(piece.column(5).to_pylist(), length)
                distinct, back = np.unique(prints, return_inverse=True)
                often = np.bincount(back, piece.column(2).to_numpy()[number]) > 1
                again = often[back]
                n, first, last = _runs(number[again], place[again])
                alone, at_once = number[~again], distinct[often]
                begin = firsts[alone] + place[~again]
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(prints[~again].view(np.int64)), pa.array(at_once.view(np.int64))]),
                     pa.array([bodies[i] for i in n.tolist()] + [bodies[i] for i in alone.tolist()] + [None] * len(at_once), pa.string()),
                     pa.concat_arrays([pa.array(firsts[n] + first), pa.array(begin), pa.nulls(len(at_once), pa.int64())]),
                     pa.concat_arrays([pa.array(firsts[n] + last), pa.array(begin), pa.nulls(len(at_once), pa.int64())]),
                     pa.array(np.repeat([0, 1, 2], [len(n), len(alone), len(at_once)]))],
                    names=["print", "body", "first", "last", "copies"])
    return run


def _cut(length: int):
    def run(batches):
        import hashlib

        import pyarrow as pa
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                kept, removed, spans, end = [], 0, 0, 0
                for run_ in sorted((r["first"], r["last"]) for r in runs or ()):
                    a, b = run_[0], run_[1] + length
                    if a > end or not spans:
                        kept.append(data[end:a])
                        spans += 1
                        removed += b - a
                        end = b
                    elif b > end:
                        removed += b - end
                        end = b
                kept.append(data[end:])
                rest = b"".join(kept)
                out.append((len(data), removed, spans, hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def _with_members(ranked: DataFrame, name: str, least: int = 2) -> DataFrame:
    """Rows of ranks with at least ``least`` rows, with their number as ``members``.

    Rows of a hot rank stay where they are: of ranks with ``HOT`` rows there are few, and their list goes to the rows.
    """
    counts = ranked.groupBy("rank").agg(F.count(F.lit(1)).alias("members"))
    counts = stored(counts.where(F.col("members") >= least), f"{name}-counts")
    hot = join_side(counts.where(F.col("members") >= HOT))
    rest = ranked.join(hot.select("rank"), "rank", "left_anti").join(counts.where(F.col("members") < HOT), "rank")
    return rest.unionByName(ranked.join(hot, "rank"))


def _met(texts: DataFrame, side: DataFrame, how: str = "inner") -> tuple[DataFrame, DataFrame | None]:
    """``texts`` joined to ``side`` by ``body``, and the rows left out of that join, which have no partner (none: all took part).

    A large ``side`` is not broadcast, but hashes of its bodies are, so that only texts which have a partner are shuffled.
    """
    if measure(side).fits(SIDE):
        return texts.join(F.broadcast(side), "body", how), None
    keys = stored(side.select(F.xxhash64("body").alias("_key")).distinct(), "bodies")
    if not measure(keys).fits():
        return texts.join(side, "body", how), None
    own = F.xxhash64("body") == F.col("_key")
    return (texts.join(F.broadcast(keys), own, "left_semi").join(side, "body", how),
            texts.join(F.broadcast(keys), own, "left_anti"))


def repeated_starts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``body, first, last``: runs of starts, in bytes, of strings that also start elsewhere; ``body`` is the text's MD5.

    Rows of one text give its runs once; null, empty and short texts and an empty table give none. ``length`` is at least ``2 * STEP + 1``.
    """
    if length <= 2 * STEP:
        raise ValueError(f"length must exceed {2 * STEP}")
    texts = text_rows(docs).select(F.md5("text").alias("body"), "text").where(F.octet_length("text") >= length)
    found = texts.mapInArrow(_find(length), "body string, first bigint, last bigint, lead int, rank bigint, following bigint")
    near = stored(_with_members(stored(found, "anchors"), "ranks-64"), "ranks-64").drop("members")
    pairs = near.select("body", "first", "last", "lead", F.xxhash64("rank", "following").alias("rank"))
    left = stored(_with_members(pairs, "ranks-128"), "ranks-128")
    spots = stored(left.groupBy("rank", "body", "first", "last", "lead").agg(F.count(F.lit(1)).alias("copies")), "spots")
    spots = (_with_members(spots, "spots", least=1).groupBy("body")
             .agg(F.collect_list(F.struct("rank", "members", "copies", "first", "last", "lead")).alias("spots")))
    # Rows of one text bring its surroundings once, with the number of rows.
    rows = _met(texts, stored(spots, "spots"))[0].dropDuplicates(["body"]).select("body", "text", "spots")
    around = stored(rows.mapInArrow(_contexts(length), f"{CONTEXT}, last bigint"), "contexts")
    contexts, within = around.where("rank IS NOT NULL").drop("last"), around.where("rank IS NULL").select("body", "first", "last")
    schema = "body string, first bigint, last bigint"
    few = F.col("members") <= GATHERED
    refined = _refined(contexts.where(~few), length)
    together = (contexts.where(few).unionByName(refined.where(few)).repartition("rank").sortWithinPartitions("rank")
                .mapInArrow(_together(length), schema))
    part = F.pmod(F.xxhash64("body", "first"), F.ceil(F.col("members") / GATHERED))
    crowded = (refined.where(~few).withColumn("part", part).repartition("rank", "part")
               .sortWithinPartitions("rank", "part"))
    starts = stored(crowded.mapInArrow(_pieces(length), "print bigint, body string, first bigint, last bigint, copies bigint"), "starts")
    many = starts.where("print is not null").groupBy("print").agg(F.sum("copies").alias("c")).where("c > 1").select("print")
    apart = (starts.where("print is null").select("body", "first", "last")
             .union(starts.where("body is not null").join(many, "print").select("body", "first", "last")))
    return together.union(apart).union(within).distinct()


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row.

    Every byte in a string of ``length`` bytes that also starts anywhere else, in the
    same row or another, is removed, judged on the input; ``kept`` joins the
    rest. Rows that repeat a text count as different places, so long repeated texts go
    whole. Null and empty texts have nothing to remove; an empty table gives no rows.
    """
    runs = stored(repeated_starts(docs, length), "repeats").groupBy("body").agg(
        F.collect_list(F.struct("first", "last")).alias("runs"))
    met, others = _met(text_rows(docs).withColumn("body", F.md5("text")), stored(runs, "runs"), "left")
    rows = met.select("doc_id", "text", "runs")
    if others is not None:
        rows = rows.unionByName(others.select("doc_id", "text"), allowMissingColumns=True)
    return rows.mapInArrow(_cut(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
