"""Word and shingle hashes of whole batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from pyspark.sql import DataFrame

from .common import mix

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
CHUNK = 1 << 18  # bytes of text hashed together
PIECE = 1 << 20  # bytes of text taken from an Arrow batch at once
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Stretches of about ``size`` bytes; a longer text is a stretch of its own."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def pieces(batches: Iterator, column: int, size: int = PIECE) -> Iterator:
    """Slices of the batches with about ``size`` bytes in a text column, so that few texts are Python objects at a time."""
    import pyarrow.compute as pc
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, end - at)
            at = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word between white space, in order."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    n = len(data)
    white = _WHITE[data]
    edge = np.flatnonzero(np.diff(np.r_[True, white].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    powers = np.full(n, BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)]
    back = np.full(n, INVERSE, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    hashes = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    edges = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(edges, starts, side="right")


def shingle_sets(texts: list[bytes], k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first text, last text, hashes, text numbers`` per chunk: the distinct ``k``-word shingles of each text, sorted.

    A text with fewer words has its whole sequence as one shingle, none without words.
    """
    for a, b in chunks(texts):
        h, doc = word_hashes(texts[a:b])
        count = np.bincount(doc, minlength=b - a)
        run = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            run = mix(run + h[j:j + len(run)] + np.uint64(j + 1))
        whole = doc[:len(run)] == doc[k - 1:] if len(run) else np.zeros(0, bool)
        s, d = run[whole], doc[:len(run)][whole]
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):
            first = np.searchsorted(doc, few)
            value = np.zeros(len(few), np.uint64)
            for j in range(k - 1):
                more = j < count[few]
                value[more] = mix(value[more] + h[first[more] + j] + np.uint64(1000 + j))
            s, d = np.r_[s, value], np.r_[d, few]
        order = np.lexsort((s, d))
        s, d = s[order], d[order]
        keep = np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])] if len(s) else np.zeros(0, bool)
        yield a, b, s[keep], d[keep]


BLOCK = 1 << 12  # counts to a row


def block_rows(cells: np.ndarray) -> tuple[list[int], list[bytes]]:
    """A table of counts as numbered rows of ``BLOCK`` counts, without those that hold none."""
    used = [i for i in range(len(cells) // BLOCK) if cells[i * BLOCK:(i + 1) * BLOCK].any()]
    return used, [cells[i * BLOCK:(i + 1) * BLOCK].astype(np.int64).tobytes() for i in used]


def _add_blocks(batches):
    """Sums of the task's rows, one row a block."""
    import pyarrow as pa
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[block] = total.get(block, 0) + np.frombuffer(counts, np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["block", "counts"])


def summed_cells(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all count tables in the columns ``block, counts``; ``size`` is fixed, whatever the corpus."""
    summed = (rows.where("block is not null").select("block", "counts").repartition("block")
              .mapInArrow(_add_blocks, "block int, counts binary"))
    cells = np.zeros(size, np.int64)
    for row in summed.collect():
        cells[row["block"] * BLOCK:(row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], np.int64)
    return cells
