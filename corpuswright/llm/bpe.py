"""Byte-level BPE: encoding with a segment tree over adjacent pair ranks, and decoding.

The leaves of a word's tree hold the rank of the pair that starts at each
symbol, next to its place; the root is therefore the leftmost pair of the lowest
rank. A merge changes three leaves, and the paths above them, until the root says
that nothing merges. Short words of a batch go through their trees together, one
array row a word; a long word has a tree of its own.

Text is cut into units where a new pre-token always begins, and the ids of units
are kept in a bounded cache.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .common import kept_in_process, releasing, text_rows

# Fixed value: the pre-token pattern of the vocabulary, white space written as the Unicode property.
PRE_TOKENS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
              r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
NONE = np.int64(1) << np.int64(62)
SHORT = 64          # bytes; longer words have a tree of their own
CACHED = 128 << 20  # bytes of units a worker process keeps, with what Python needs for them
TREE_CACHED = 64 << 20  # the same for the trees here, whose process also holds the vocabulary
ENTRY = 170         # bytes of an entry beside its text and ids
TOGETHER = 256      # texts encoded together


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary lies on the driver; tasks get its content, not its path."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    return letters


class Vocabulary:
    """Merge ranks, byte ids, special tokens and the bytes of every id."""

    def __init__(self, content: str):
        data = json.loads(content)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        letters = _byte_letters()
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], dtype=np.int64)
        new = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = np.append(keys[order], NONE), np.append(order, 0), new
        self.lookup = {int(k): (int(r)) for k, r in zip(self.keys, self.ranks)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        back = {c: b for b, c in letters.items()}
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; ``NONE`` where they never merge or a side is missing (negative)."""
        wanted = (left << 32) | np.maximum(right, 0)
        at = np.searchsorted(self.keys, wanted)
        return np.where((self.keys[at] == wanted) & (right >= 0) & (left >= 0), self.ranks[at], NONE)

    def merge_short(self, words: list[bytes], dtype: str = "<u4") -> list[bytes]:
        """Ids, as bytes, of words of at most ``SHORT`` bytes; all trees of a width advance together."""
        out = [b""] * len(words)
        lengths = np.array([len(w) for w in words])
        width = 1
        while width <= SHORT:
            mine = np.flatnonzero((lengths <= width) & (lengths > width // 2))
            for part in np.array_split(mine, max(1, len(mine) * width // 400_000)):
                if len(part):
                    ids = self._forest([words[i] for i in part.tolist()], lengths[part], width)
                    flat = ids[ids >= 0].astype(dtype).tobytes()
                    ends = (np.cumsum((ids >= 0).sum(axis=1)) * np.dtype(dtype).itemsize).tolist()
                    start = 0
                    for i, end in zip(part.tolist(), ends):
                        out[i] = flat[start:end]
                        start = end
            width *= 2
        return out

    def _forest(self, words: list[bytes], lengths: np.ndarray, width: int) -> np.ndarray:
        m = len(words)
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(m, width)
        ids = np.full((m, width + 2), -1, np.int64)  # places 0 and width + 1 stand for "no symbol"
        ids[:, 1:-1] = np.where(np.arange(width) < lengths[:, None], self.byte_ids[flat], -1)
        after = np.minimum(np.arange(width + 2) + 1, width + 1)[None].repeat(m, 0)
        before = np.maximum(np.arange(width + 2) - 1, 0)[None].repeat(m, 0)
        tree = np.full((m, 2 * width), NONE, np.int64)
        ranks = self.rank(ids[:, 1:-1], ids[:, 2:])
        places = np.arange(width, dtype=np.int64)
        tree[:, width:] = np.where(ranks < NONE, ranks * width + places, NONE)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        rows = np.flatnonzero(tree[:, 1] < NONE) if width > 1 else np.empty(0, np.int64)
        while len(rows):
            root = tree[rows, 1]
            at = root % width + 1
            gone = after[rows, at]
            follow = after[rows, gone]
            ids[rows, at] = self.merged[root // width]
            ids[rows, gone] = -1
            after[rows, at] = follow
            before[rows, follow] = at
            prior = before[rows, at]
            left = self.rank(ids[rows, prior], ids[rows, at])
            right = self.rank(ids[rows, at], ids[rows, follow])
            # Place 0 has no leaf: its write goes to the removed symbol's, which is set last.
            leaf = np.where(prior > 0, prior, gone) - 1 + width
            tree[rows, leaf] = np.where(left < NONE, left * width + (prior - 1), NONE)
            tree[rows, at - 1 + width] = np.where(right < NONE, right * width + (at - 1), NONE)
            tree[rows, gone - 1 + width] = NONE
            up = [leaf, at - 1 + width, gone - 1 + width]
            for _ in range(width.bit_length() - 1):
                up = [u >> 1 for u in up]
                for u in up:
                    tree[rows, u] = np.minimum(tree[rows, 2 * u], tree[rows, 2 * u + 1])
            rows = rows[tree[rows, 1] < NONE]
        return ids

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word of any length."""
        n = len(word)
        ids = [int(self.byte_ids[b]) for b in word] + [-1]
        after, before = list(range(1, n + 1)) + [n], list(range(-1, n))
        width = 1 << max(0, n - 1).bit_length()
        none, lookup, merged = int(NONE), self.lookup, self.merged

        def leaf(i: int) -> int:
            j = after[i]
            rank = lookup.get((ids[i] << 32) | ids[j]) if j < n else None
            return none if rank is None else rank * width + i

        tree = [none] * width + [leaf(i) for i in range(n)] + [none] * (width - n)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while width > 1 and tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            ids[i], ids[j] = int(merged[rank]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for place, value in ((j, none), (i, leaf(i)), (before[i], leaf(before[i]) if before[i] >= 0 else none)):
                if place < 0:
                    continue
                node = place + width
                tree[node] = value
                while node > 1:
                    node >>= 1
                    best = min(tree[2 * node], tree[2 * node + 1])
                    if tree[node] == best:
                        break
                    tree[node] = best
        return np.array([i for i in ids[:n] if i >= 0], np.int64)

    def encode_units(self, units: list[str], dtype: str = "<u4") -> list[bytes]:
        """Ids of every unit as bytes."""
        import regex
        find = regex.compile(PRE_TOKENS).findall
        parts = [[p.encode("utf-8") for p in find(u)] for u in units]
        distinct = list({p for ps in parts for p in ps})
        short = [p for p in distinct if len(p) <= SHORT]
        known = dict(zip(short, self.merge_short(short, dtype)))
        known |= {p: self.merge_long(p).astype(dtype).tobytes() for p in distinct if len(p) > SHORT}
        return [b"".join([known[p] for p in ps]) for ps in parts]

    def decode(self, ids: bytes, dtype: str = "<u4") -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        table = self.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, dtype).tolist()]).decode("utf-8", "replace")


class Units:
    """Ids of texts as bytes, word by word, through a bounded cache.

    ``encode`` gives the ids of many units. Where every white space stands alone,
    a blank before a word and a line break are pre-token edges, and so is the
    mark after a word of letters; elsewhere a unit reaches from one blank before
    a visible character to the next. Units are independent either way. Words
    met in a second batch move to the lasting half of the cache; the other half
    is emptied when full.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], special: dict[str, bytes], cached: int = CACHED):
        self.encode, self.special, self.cached = encode, special, cached
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.marks = dict(zip([*MARKS, "\n"], encode([*MARKS, "\n"])))
        self.spaced: dict[str, bytes] = {}  # ids of a blank and the word
        self.heads: dict[str, bytes] = {}
        self.again: set[str] = set()
        self.held = {"": 0, " ": 0}

    def _learn(self, missing: set[str], known: dict[str, bytes], lead: str) -> None:
        marked = {u: u[:-1] for u in missing if u.endswith(ENDS) and u[:-1].isalpha()}
        new = [u for u in (missing - marked.keys()) | set(marked.values()) if u not in known]
        learned = dict(zip(new, self.encode([lead + u for u in new])))
        known.update(learned)
        ended = {u: known[word] + self.marks[u[-1]] for u, word in marked.items()}
        known.update(ended)
        self.held[lead] += self._bytes(learned) + self._bytes(ended)

    @staticmethod
    def _bytes(known: dict[str, bytes], units=None) -> int:
        """What ``units`` of the cache take, all if none are named."""
        ids = known.values() if units is None else map(known.__getitem__, units)
        units = known if units is None else units
        return 2 * sum(map(len, units)) + sum(map(len, ids)) + ENTRY * len(units)

    def _room(self) -> None:
        """Keeps the words met in more than one batch; none if these alone fill most of the cache."""
        if self.held[" "] > self.cached * 3 // 4:
            known = self.spaced.get
            lasting = {u: ids for u in self.again if (ids := known(u)) is not None}  # one look at a word: the cache is cold
            held = self._bytes(lasting)
            if held > self.cached // 2:
                lasting, held = {}, 0
            self.spaced, self.again, self.held[" "] = lasting, set(lasting), held
        if self.held[""] > self.cached // 4:
            self.heads.clear()
            self.held[""] = 0

    def texts(self, texts: list[str]) -> list[bytes]:
        self._room()
        split = [self._parts(t) for t in texts]
        spaced: set[str] = set()
        heads: set[str] = set()
        for parts in split:
            for first, rest in parts:
                heads.add(first)
                spaced.update(rest)
        missing = {u for u in spaced if u not in self.spaced}  # the cache is larger by far: never walk it
        self.again.update(spaced - missing)
        self._learn(missing, self.spaced, " ")
        fixed = self.special | {"": b"", "\n": self.marks["\n"]}
        self._learn({u for u in heads if u not in fixed and u not in self.heads}, self.heads, "")
        self.heads.update(fixed)
        head, get = self.heads, self.spaced.__getitem__
        return [b"".join([head[first] + b"".join(map(get, rest)) for first, rest in parts]) for parts in split]

    def _parts(self, text: str) -> list[tuple[str, list[str]]]:
        """Stretches as their first unit and the rest without their leading blank; special tokens and line breaks alone."""
        out: list[tuple[str, list[str]]] = []
        for piece in self.cut.split(text) if self.cut and any(s in text for s in self.special) else (text,):
            if piece in self.special:
                out.append((piece, []))
            elif piece and _UNCLEAR.search(piece):
                units = _BREAK.split(piece)
                out.append((units[0], units[1:]))
            elif piece:
                for i, line in enumerate(piece.split("\n")):
                    if i:
                        out.append(("\n", []))
                    units = line.split(" ")
                    out.append((units[0], units[1:]))
        return out


MARKS = ".,;:!?"
ENDS = tuple(MARKS)
_UNCLEAR = re.compile(r"\s(?:\s|\Z)")
_BREAK = re.compile(r" (?=\S)")


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row; ``ids`` are little-endian 32-bit integers as binary.

    Null and empty texts have no ids; a special token written in a text is its id,
    as the tokenizers library has it; repeated rows repeat; an empty table gives
    no rows.
    """
    return text_rows(docs).mapInArrow(_task(tokenizer, True, False), "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``; null ids give a null. Special tokens are written out."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        _task(tokenizer, False, True), "doc_id bigint, n_tokens bigint, ids binary, decoded string")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """:func:`encode` and :func:`decode` in one task: a core needs one worker and one vocabulary, not two."""
    return text_rows(docs).mapInArrow(_task(tokenizer, True, True), "doc_id bigint, n_tokens bigint, ids binary, decoded string")


def _task(tokenizer: str | None, encoding: bool, decoding: bool):
    content = open(tokenizer or vocabulary_file(), encoding="utf-8").read()
    mark = zlib.crc32(content.encode())

    def run(batches):
        import pyarrow as pa
        words = kept_in_process(f"words_{mark}", lambda: Vocabulary(content))
        units = kept_in_process(f"tree_{mark}", lambda: Units(
            words.encode_units, {t: np.array([i], "<u4").tobytes() for t, i in words.special.items()}, TREE_CACHED)) if encoding else None
        names = ["doc_id", "n_tokens", "ids", "decoded"]
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                if encoding:
                    ids = units.texts(part.column(1).to_pylist())
                    columns = [part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                else:
                    ids, columns = part.column(2).to_pylist(), list(part.columns)
                if decoding:
                    columns.append(pa.array([None if i is None else words.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names[:len(columns)])

    return releasing(run)
