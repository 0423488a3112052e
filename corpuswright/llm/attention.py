"""A small causal self-attention model in numpy: forward, gradients, training and windowed scoring.

The model gives the next subword id from a window of ids, in two levels that share the hidden layer: a class, then
the id by the binary choices of its class's code tree. Classes go by frequency: the most frequent ids have one each, the
rest share classes of about equal mass. An id's query, key, value and input are its class's rows plus a projection of a
vector of its own. The choices of a tree start at the ids' shares of the corpus count, plus one, so all probabilities
are over single ids and sum to one. Functions that get no :class:`Ids` are the first level alone, over classes.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

CLASSES = 64       # of ids; two more stand for the start and for padding
ALONE = 40         # ids with a class of their own
WIDTH = 16
CONTEXT = 12       # positions a window has before those it scores
SCORED = 20        # positions a window scores
SPAN = CONTEXT + SCORED
START, PAD = CLASSES, CLASSES + 1
NAMES = ("query", "key", "value", "input", "output", "bias", "distance")
SHAPES = {"query": (CLASSES + 2, WIDTH), "key": (CLASSES + 2, WIDTH), "value": (CLASSES + 2, WIDTH),
          "input": (CLASSES + 2, WIDTH), "output": (WIDTH, CLASSES), "bias": (CLASSES,), "distance": (SPAN,)}
FIRST = 1e-7  # squared slope an id's vectors start from: about that of one target of a batch
SCALE = np.float32(WIDTH ** -0.5)
_GAP = np.arange(SCORED)[:, None] + CONTEXT - np.arange(SPAN)[None]  # distance from key to query
_CAUSAL = _GAP >= 0


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of every id and the natural logarithm of its share within the class."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    label = np.zeros(len(counts), np.int64)
    label[order[:ALONE]] = np.arange(min(ALONE, len(counts)))
    rest = order[ALONE:]
    mass = np.cumsum(counts[rest] + 1.0)
    label[rest] = ALONE + np.minimum((mass - 1) * (CLASSES - ALONE) / max(mass[-1], 1) if len(rest) else mass,
                                     CLASSES - ALONE - 1).astype(np.int64)
    weight = counts + 1.0
    return label, np.log(weight / np.bincount(label, weight, CLASSES)[label])


def code_trees(label: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Huffman trees over the ids of each class: ``label, lean, node, side, depth``, see :class:`Ids`."""
    n = len(label)
    above, side, lean = np.full(2 * n, -1), np.zeros(2 * n, np.float32), []
    order = np.argsort(label, kind="stable")
    for members in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        heap = [(float(counts[i]) + 1.0, i) for i in members.tolist()]
        heapq.heapify(heap)
        while len(heap) > 1:
            (light, a), (heavy, b) = heapq.heappop(heap), heapq.heappop(heap)
            node = n + len(lean)
            above[a] = above[b] = node
            side[a], side[b] = -1, 1
            lean.append(math.log(heavy / light))
            heapq.heappush(heap, (light + heavy, node))
    leaf = at = np.arange(n)
    ways = [(leaf[:0], at[:0], side[:0])]
    while len(at):
        more = above[at] >= 0
        leaf, at = leaf[more], at[more]
        ways.append((leaf, above[at] - n, side[at]))
        at = above[at]
    leaf, node, side = (np.concatenate(c) for c in zip(*ways))
    order = np.argsort(leaf, kind="stable")
    return (label, np.array(lean, np.float32), node[order].astype(np.uint16 if n <= 1 << 16 else np.int64), side[order],
            np.bincount(leaf, minlength=n))


class Ids:
    """Class of every id, and its way to the id through the class's tree: ``depth`` choices, each a node and the side it is on."""

    def __init__(self, label: np.ndarray, lean: np.ndarray, node: np.ndarray, side: np.ndarray, depth: np.ndarray):
        self.lean, self.node, self.side, self.depth = lean, node, side, depth  # lean: log odds of the sides at the start
        self.start, self.pad = len(label), len(label) + 1  # ids that stand for the start and for padding
        self.label = np.append(label, [START, PAD])
        self.first = np.cumsum(depth) - depth

    def choices(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, node and side of every choice on the way to the targets ``y`` (-1: none), in order of positions."""
        depth = np.where(y >= 0, self.depth[y], 0)
        position = np.repeat(np.arange(len(y)), depth)
        entry = np.arange(len(position)) + (self.first[y] - (np.cumsum(depth) - depth))[position]
        return position, self.node[entry], self.side[entry]

    def classes(self, y: np.ndarray) -> np.ndarray:
        return np.where(y >= 0, self.label[y], -1)


def fresh(frequency: np.ndarray, seed: int = 11, ids: int = 0) -> dict[str, np.ndarray]:
    """Small random weights; the output starts at the class frequencies. The vectors of ``ids`` ids and of the choices between them start at 0."""
    rng = np.random.default_rng(seed)
    out = {n: rng.normal(0, 0.3, SHAPES[n]).astype(np.float32) for n in NAMES}
    out["bias"] = np.log((frequency + 1.0) / (frequency + 1.0).sum()).astype(np.float32)
    out["distance"] = (-0.2 * np.arange(SPAN)).astype(np.float32)
    if ids:
        out |= {n: np.zeros(s, np.float32) for n, s in _id_shapes(ids).items()}
        out["spread"] = rng.normal(0, 0.3, out["spread"].shape).astype(np.float32)
    return out


def _id_shapes(ids: int) -> dict[str, tuple[int, int]]:
    return {"spread": (WIDTH, 4 * WIDTH), "own": (ids + 2, WIDTH), "node": (ids, WIDTH)}


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in weights.values()])


def shaped(values: np.ndarray, ids: int = 0) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n, shape in ({n: SHAPES[n] for n in NAMES} | (_id_shapes(ids) if ids else {})).items():
        size = math.prod(shape)
        out[n] = values[at:at + size].astype(np.float32).reshape(shape)
        at += size
    return out


def windows(sequences: list[np.ndarray], start: int = START, pad: int = PAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs ``(m, SPAN)``, targets ``(m, SCORED)`` (-1: none) and sequence number of every window.

    A sequence holds classes, or ids, and ends with the end's; its inputs are the start and all but the last. Every
    target is in exactly one window.
    """
    lengths = np.array([len(s) for s in sequences], np.int64)
    counts = -(-lengths // SCORED)
    blocks = CONTEXT + counts * SCORED
    base = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    inputs, targets = np.full(total, pad, np.int64), np.full(total, -1, np.int64)
    body = np.concatenate(sequences) if sequences else np.empty(0, np.int64)
    number = np.repeat(np.arange(len(sequences)), lengths)
    place = np.arange(len(body)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + base[number] + CONTEXT
    targets[place] = body
    inputs[base + CONTEXT] = start
    follows = place[1:][number[1:] == number[:-1]]
    inputs[follows] = body[:-1][number[1:] == number[:-1]]
    owner = np.repeat(np.arange(len(sequences)), counts)
    first = base[owner] + SCORED * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
    return inputs[first[:, None] + np.arange(SPAN)], targets[first[:, None] + np.arange(CONTEXT, SPAN)], owner


def _attend(w: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray | None = None):
    """Queries, keys, values, attention, what it gathers, and the hidden layer of every scored position, from classes and ``ids`` of them."""
    both = np.take(np.concatenate([w["value"], w["key"]], axis=1), x, axis=0)
    own = np.take(np.concatenate([w["input"], w["query"] * SCALE], axis=1), x[:, CONTEXT:], axis=0)
    if ids is not None:
        single = np.take(w["own"], ids, axis=0)
        both += (single.reshape(-1, WIDTH) @ w["spread"][:, :2 * WIDTH]).reshape(both.shape)
        own += (single[:, CONTEXT:].reshape(-1, WIDTH) @ w["spread"][:, 2 * WIDTH:]).reshape(own.shape)
    v, k, q = both[..., :WIDTH], both[..., WIDTH:], own[..., WIDTH:]
    score = np.matmul(q, k.transpose(0, 2, 1))
    score += np.where(_CAUSAL, w["distance"][np.maximum(_GAP, 0)], np.float32(-1e9))
    empty = x == PAD
    if empty.any():
        score += np.where(empty, np.float32(-1e9), np.float32(0))[:, None]
    np.minimum(score, 60, out=score)
    a = np.exp(score, out=score)
    a /= (a.reshape(-1, SPAN) @ np.ones(SPAN, np.float32)).reshape(len(x), SCORED, 1) + np.float32(1e-30)
    z = np.matmul(a, v)
    return q, k, v, a, z, np.maximum(own[..., :WIDTH] + z, 0)


def class_scores(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of every target class; 0 where there is none."""
    return _class_scores(w, _attend(w, x)[-1].reshape(-1, WIDTH), y)


def id_scores(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, ids: Ids) -> np.ndarray:
    """Natural log probability of every target id after the ids ``x``; 0 where there is none."""
    h = _attend(w, ids.label[x], x)[-1].reshape(-1, WIDTH)
    position, node, side = ids.choices(y.reshape(-1))
    chosen = side * (np.einsum("ij,ij->i", np.take(w["node"], node, axis=0), np.take(h, position, axis=0)) + ids.lean[node])
    logs = np.minimum(chosen, 0) - np.log1p(np.exp(-np.abs(chosen)))
    return _class_scores(w, h, ids.classes(y)) + np.bincount(position, logs, len(h)).reshape(y.shape)


def _class_scores(w: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray) -> np.ndarray:
    logits = h @ w["output"]
    logits += w["bias"]
    np.minimum(logits, 60, out=logits)
    wanted = np.take_along_axis(logits, np.maximum(y.reshape(-1, 1), 0), axis=1)[:, 0]
    total = np.exp(logits, out=logits) @ np.ones(CLASSES, np.float32)
    return np.where(y.reshape(-1) >= 0, wanted - np.log(total), 0).reshape(y.shape)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[:len(keys)]
    return keys[first].astype(np.int64), np.add.reduceat(np.take(values, order, axis=0), first, axis=0) if len(first) else values


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, ids: Ids | None = None) -> dict:
    """Mean gradient of the negative log probability; the four tables share one product with the one-hot inputs.

    With ``ids``, ``x`` and ``y`` are ids; ``own`` and ``node`` are then rows and the gradients of these.
    """
    single = x
    if ids is not None:
        x, wanted, y = ids.label[x], y.reshape(-1), ids.classes(y)
    q, k, v, a, z, h = _attend(w, x, None if ids is None else single)
    hf, yf = h.reshape(-1, WIDTH), y.reshape(-1)
    p = hf @ w["output"]
    p += w["bias"]
    np.minimum(p, 60, out=p)
    np.exp(p, out=p)
    there = ((yf >= 0) / max(1, (yf >= 0).sum())).astype(np.float32)
    p *= (there / (p @ np.ones(CLASSES, np.float32)))[:, None]
    p[np.arange(len(yf)), np.maximum(yf, 0)] -= there
    out = {"output": hf.T @ p, "bias": np.ones(len(p), np.float32) @ p}
    dh = p @ w["output"].T
    if ids is not None:
        position, node, side = ids.choices(wanted)
        vectors, hidden = np.take(w["node"], node, axis=0), np.take(hf, position, axis=0)
        chosen = side * (np.einsum("ij,ij->i", vectors, hidden) + ids.lean[node])
        slope = (-side * there[position] / (1 + np.exp(np.minimum(chosen, 60))))[:, None]
        at, rows = _summed(position, slope * vectors)
        dh[at] += rows
        out["node"] = _summed(node, slope * hidden)
    dz = (dh * (hf > 0)).reshape(h.shape)
    ds = np.matmul(dz, v.transpose(0, 2, 1))
    ds -= (dz * z).sum(axis=2, keepdims=True)
    ds *= a
    sides = np.zeros((len(x), SPAN, 4 * WIDTH), np.float32)
    value, key, given, query = (slice(i * WIDTH, (i + 1) * WIDTH) for i in range(4))
    np.matmul(a.transpose(0, 2, 1), dz, out=sides[:, :, value])
    np.matmul(ds.transpose(0, 2, 1), q, out=sides[:, :, key])
    sides[:, CONTEXT:, given] = dz
    np.matmul(ds, k, out=sides[:, CONTEXT:, query])
    summed = np.eye(CLASSES + 2, dtype=np.float32)[x.reshape(-1)].T @ sides.reshape(-1, 4 * WIDTH)
    out |= {"value": summed[:, value], "key": summed[:, key], "input": summed[:, given], "query": summed[:, query] * SCALE}
    if ids is not None:
        sides = sides.reshape(-1, 4 * WIDTH)
        out["spread"] = np.take(w["own"], single.reshape(-1), axis=0).T @ sides
        out["own"] = _summed(single.reshape(-1).astype(np.uint16 if ids.pad < 1 << 16 else np.int64), sides @ w["spread"].T)
    out["distance"] = np.bincount(np.maximum(_GAP, 0).ravel(), np.where(_CAUSAL, ds.sum(axis=0), 0).ravel(), SPAN).astype(np.float32)
    return out


class Trainer:
    """Adam, for the vectors of ids Adagrad, over a stream of windows: ``HELD`` of them at a time are shuffled and cut into batches; the same wherever the task runs."""

    HELD = 8192

    def __init__(self, w: dict[str, np.ndarray], batch: int = 128, rate: float = 0.02, seed: int = 5, ids: Ids | None = None):
        self.w, self.ids = {n: v.copy() for n, v in w.items()}, ids
        self.first, self.second = ({n: np.zeros_like(v) for n, v in w.items() if n not in ("own", "node")} for _ in range(2))
        self.squares = {n: np.full_like(w[n], FIRST) for n in ("own", "node") if n in w}
        self.rng, self.batch, self.rate = np.random.default_rng(seed), batch, rate
        self.steps = self.targets = self.waiting = 0
        self.xs: list[np.ndarray] = []
        self.ys: list[np.ndarray] = []

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        for at in range(0, len(x), self.HELD):
            self.xs.append(x[at:at + self.HELD])
            self.ys.append(y[at:at + self.HELD])
            self.waiting += len(self.xs[-1])
            if self.waiting >= self.HELD:
                self.flush()

    def flush(self) -> None:
        """Trains on the windows that wait."""
        if not self.waiting:
            return
        x, y = np.concatenate(self.xs), np.concatenate(self.ys)
        self.xs, self.ys, self.waiting = [], [], 0
        self.targets += int((y >= 0).sum())
        order = self.rng.permutation(len(x))
        for at in range(0, len(x), self.batch):
            part = order[at:at + self.batch]
            self._step(gradients(self.w, x[part], y[part], self.ids))

    def _step(self, slopes: dict[str, np.ndarray]) -> None:
        self.steps += 1
        t = self.steps
        pace = np.float32(self.rate / math.sqrt(1 + t / 50))
        for n in self.squares:  # vectors of ids: only rows the batch met, by the sum of their squared slopes
            rows, g = slopes.pop(n)
            squares = np.take(self.squares[n], rows, axis=0) + g * g
            self.squares[n][rows] = squares
            self.w[n][rows] = np.take(self.w[n], rows, axis=0) - np.float32(4 * self.rate) * g / np.sqrt(squares)
        for n, g in slopes.items():
            self.first[n] += 0.1 * (g - self.first[n])
            self.second[n] += 0.01 * (g * g - self.second[n])
            self.w[n] -= pace * (self.first[n] / (1 - 0.9 ** t)) / (np.sqrt(self.second[n] / (1 - 0.99 ** t)) + 1e-8)
