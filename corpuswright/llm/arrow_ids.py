"""Token ids in Arrow files of fixed-size-list batches.

Documents are range-partitioned by ``doc_id``; every task writes its range to one
file in the shared folder: rows of ``length`` ids and as many mask bits, the last
row filled up with masked end ids, ``rows`` rows to a record batch. A reader maps a file
and reaches any place by division, without copying. Files are named at random, and
the index, written as a table, names only those of tasks that succeeded, so a
task may run again anywhere. Ids take 16 bits where the vocabulary allows.
"""

from __future__ import annotations

import json
import re
import string
import uuid
import zlib
from array import array
from collections import deque
from operator import attrgetter

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import new_table_path
from .bpe import TOGETHER, Units, _byte_letters, vocabulary_file
from .common import join_side, kept_in_process, stored, text_rows
from .hashing import pieces

LENGTH = 1024
ROWS = 128
LINES = 20_000  # units encoded as one text
AT_ONCE = 2 << 20  # bytes of text whose words meet the cache together
BLANK = "Ġ"     # fixed value: stands for a blank in a byte-level vocabulary
# Letters of blocks that have been letters since long: newer ones may be unknown to the library. Marks are ASCII, so no contraction follows.
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ώА-ҁぁ-ゔァ-ヺ一-龥가-힣]+[!-/:-@\[-`{-~]*").fullmatch
MARKED = string.punctuation
END = 2  # fixed value: the id that ends a document


def _open(folder: str):
    """File system and path of a folder that Spark names by URI or local path."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)


class Writer:
    """Appends ids to one Arrow file, a batch at a time."""

    def __init__(self, sink, kind: str, length: int, rows: int):
        import pyarrow as pa
        self.pa, self.kind, self.length, self.rows = pa, kind, length, rows
        ids = pa.list_(pa.from_numpy_dtype(np.dtype(kind)), length)
        self.schema = pa.schema([("input_ids", ids), ("attention_mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.waiting: deque[bytes] = deque()
        self.bytes = 0

    def add(self, ids: bytes) -> None:
        self.waiting.append(ids)
        self.bytes += len(ids)
        whole = self.length * self.rows * np.dtype(self.kind).itemsize
        if self.bytes >= whole:
            flat = b"".join(self.waiting)
            cut = len(flat) - len(flat) % whole
            for at in range(0, cut, whole):
                self._batch(np.frombuffer(flat, self.kind, self.length * self.rows, at))
            self.waiting = deque([flat[cut:]])
            self.bytes = len(flat) - cut

    def _batch(self, ids: np.ndarray, valid: int | None = None) -> None:
        pa, n = self.pa, len(ids)
        mask = np.arange(n) < (n if valid is None else valid)
        kinds = [f.type for f in self.schema]
        self.out.write_batch(pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(ids), type=kinds[0]),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), type=kinds[1])], schema=self.schema))

    def close(self) -> None:
        rest = np.frombuffer(b"".join(self.waiting), self.kind)
        if len(rest):
            full = np.full(-(-len(rest) // self.length) * self.length, END, self.kind)
            full[:len(rest)] = rest
            self._batch(full, len(rest))
        self.out.close()


class Reader:
    """Random access to the ids of one file; batches are views of the mapped file."""

    def __init__(self, file, length: int, rows: int):
        import pyarrow as pa
        self.file, self.whole = pa.ipc.open_file(file), length * rows
        self.last: tuple[int, np.ndarray] | None = None

    def _flat(self, i: int) -> np.ndarray:
        if self.last is None or self.last[0] != i:
            batch = self.file.get_batch(i)
            valid = batch.column(1).values
            count = len(valid) if valid.true_count == len(valid) else valid.true_count
            self.last = (i, batch.column(0).values.to_numpy(zero_copy_only=True)[:count])
        return self.last[1]

    def get(self, start: int, n: int) -> np.ndarray:
        parts, end = [], start + n
        while start < end:
            i, at = divmod(start, self.whole)
            part = self._flat(i)[at:at + end - start]
            if not len(part):
                raise ValueError("the file holds fewer ids than its index says")
            parts.append(part)
            start += len(part)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


def _whole_words(content: str) -> bool:
    """Whether a run of letters with or without a blank before it, and one of marks after it, are a pre-token each, which go to the model byte by byte."""
    data = json.loads(content)
    before = data.get("pre_tokenizer") or {}
    return (before.get("type") == "ByteLevel" and before.get("use_regex") is True and before.get("add_prefix_space") is False
            and data.get("normalizer") is None and data["model"].get("type") == "BPE" and not data["model"].get("dropout"))


def _library(tok, kind: str, whole: bool = False):
    """Ids of many units by the tokenizers library: with ``whole``, words of common letters and marks after them by its model, whose
    pre-tokens need no search; other units without white space as lines of few texts, the rest one a text.

    A line break before a blank or a visible character is a pre-token, and no id of other text is its id, so the ids part where the units do.
    """
    def ids_of(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, kind) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    mark = ids_of(["\n"])[0]

    merge, number, code = tok.model.tokenize, attrgetter("id"), "H" if kind == "<u2" else "I"
    letters = _byte_letters()

    def encode(many: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(many)
        words = [i for i, unit in enumerate(many) if _WORD(unit)] if whole else []
        for start in range(0, len(words), LINES):
            part = words[start:start + LINES]
            spelt = "\n".join([many[i] for i in part]).encode().decode("latin-1").translate(letters).split(letters[10])
            for i, unit in zip(part, spelt):
                word = unit.rstrip(MARKED)
                ids = array(code, map(number, merge(word)))
                if word is not unit:
                    ids.extend(map(number, merge(unit[len(word):])))
                out[i] = ids.tobytes()
        plain = [i for i, unit in enumerate(many) if not out[i] and len(mark) == 1 and _visible(unit)]
        for start in range(0, len(plain), LINES):
            part = plain[start:start + LINES]
            ids = ids_of(["\n".join([many[i] for i in part])])[0]
            ends = [*np.flatnonzero(ids == mark).tolist(), len(ids)]
            if len(ends) != len(part):
                raise ValueError("the vocabulary joins line breaks to other text")
            size, flat, at = ids.itemsize, ids.tobytes(), 0
            for i, end in zip(part, ends):
                out[i] = flat[at * size:end * size]
                at = end + 1
        rest = [i for i in range(len(many)) if many[i] and not out[i]]
        for i, ids in zip(rest, ids_of([many[i] for i in rest])):
            out[i] = ids.tobytes()
        return out

    return encode


def _visible(unit: str) -> bool:
    """One word, a blank before it or not, and no other white space."""
    word = unit.removeprefix(" ")
    return bool(word) and word.split() == [word]


def write_ids(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Writes all texts and returns the index: ``part, file, doc_id, start, place, n_tokens``.

    ``start`` counts the ids of all documents before, ``place`` those before in
    the file. Order is by ``doc_id``, nulls first, then a hash of the text; null and empty texts give the end id
    alone; repeated rows repeat; an empty table gives no files.
    """
    content = open(tokenizer or vocabulary_file(), encoding="utf-8").read()
    folder = new_table_path(docs.sparkSession, "llm-ids")
    mark, whole = zlib.crc32(content.encode()), _whole_words(content)

    def run(batches):
        import gc
        gc.disable()  # nothing here makes cycles, and collections walk the whole cache
        try:
            yield from written(batches)
        finally:
            gc.enable()

    def written(batches):
        import os

        import pyarrow as pa
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = Tokenizer.from_str(content)
        tok.no_truncation()
        tok.no_padding()
        kind = "<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4"
        special = {t.content: np.array([i], kind).tobytes() for i, t in tok.get_added_tokens_decoder().items()}
        units = kept_in_process(f"library_{mark}", lambda: Units(_library(tok, kind, whole), special))
        end, size = np.array([END], kind).tobytes(), np.dtype(kind).itemsize
        writer, at, part = None, 0, TaskContext.get().partitionId()
        system, path = _open(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.arrow"
        sink = None
        for piece in pieces(batches, 1, AT_ONCE):
            if writer is None:
                system.create_dir(path, recursive=True)
                sink = system.open_output_stream(f"{path}/{name}")
                writer = Writer(sink, kind, length, rows)
            places, counts = [], []
            for ids in units.texts(piece.column(1).to_pylist()):
                writer.add(ids + end)
                places.append(at)
                counts.append(len(ids) // size + 1)
                at += counts[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(places), pa.int32()), pa.array([f"{folder}/{name}"] * len(places)),
                 piece.column(0), pa.array(places, pa.int64()), pa.array(counts, pa.int64())],
                names=["part", "file", "doc_id", "place", "n_tokens"])
        if writer is not None:
            writer.close()
            sink.close()

    # A hash of the text parts rows that share an id, or have none; equal rows may stand in any order.
    keyed = text_rows(docs).withColumn("body", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "body").sortWithinPartitions("doc_id", "body").drop("body")
    index = stored(ordered.mapInArrow(run, "part int, file string, doc_id bigint, place bigint, n_tokens bigint"), "ids-index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    totals = (index.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
              .select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("bigint").alias("base")))
    return index.join(join_side(stored(totals, "ids-totals")), "part").select(
        "part", "file", "doc_id", (F.col("base") + F.col("place")).alias("start"), "place", "n_tokens")


def read_ids(index: DataFrame, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every index row, read from the files; ids as little-endian 32-bit integers.

    Rows of one file lie together in the index, so a task keeps one file open. Every document has its end id at least; an
    empty index gives no rows.
    """
    def run(batches):
        import pyarrow as pa
        opened, reader = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                piece = batch.slice(i, TOGETHER)
                out = []
                for file, place, n in zip(*(piece.column(c).to_pylist() for c in (0, 3, 4))):
                    if file != opened:
                        system, path = _open(file)
                        local = system.type_name == "local"
                        opened, reader = file, Reader(pa.memory_map(path) if local else system.open_input_file(path), length, rows)
                    out.append(reader.get(place, n).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([piece.column(1), piece.column(2), piece.column(4), pa.array(out, pa.binary())],
                                                 names=["doc_id", "start", "n_tokens", "ids"])

    return index.select("file", "doc_id", "start", "place", "n_tokens").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def digests(index: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files, one row for each index row (null and repeated ids included)."""
    return read_ids(index).select("doc_id", "start", "n_tokens", F.crc32("ids").cast("bigint").alias("ids_crc32"))


def crc(ids: np.ndarray) -> int:
    """The checksum of :func:`digests` for ids in memory."""
    return zlib.crc32(ids.astype("<u4").tobytes())
