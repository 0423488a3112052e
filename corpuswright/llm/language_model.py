"""Scores of texts under a word unigram and under a causal self-attention model.

One pass encodes every text to subword ids, kept as a table, and counts words and ids of
the training rows. The attention model gives probabilities of single ids and is trained on every window of every training
row, the rows dealt to ``ROUNDS`` rounds. Rows are dealt to rounds and shards by a hash of their ids, a shard for each ``SHARD`` ids of the
corpus, so neither the table's partitions nor the executors decide what is learned: each shard starts from the same weights, trains on its
rows' windows in hash order, and the weights are averaged by their number of targets, a block of them at a time. A last pass scores all
tokens of all rows in overlapping windows and adds up word counts.

The counts of at most ``FREQUENT`` words of at most ``WORD_BYTES`` bytes, the most frequent ones, are
broadcast; all others are joined on the word, no list of which is long. The corpus counts are exact.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections import Counter

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import attention as model
from .bpe import TOGETHER, kept_in_process, vocabulary_file
from .common import stored, text_rows
from .hashing import BLOCK, block_rows, summed_cells

HELD_OUT, FOLDS = 2, 7     # fixed values: the fold that is not learned from
FREQUENT = 1 << 17         # words whose counts are broadcast
WORD_BYTES = 64            # of the longest such word
FLUSH = 200_000            # distinct words a task holds before it passes their counts on
ROUNDS = 2                 # each trains on its share of the rows
SHARD = 1 << 24            # ids of a training shard, on average; the weights a shard returns are a small part of them
AT_ONCE = 250              # windows scored together; their arrays fit a core's cache
RANKS = "byte_bpe_50k.tiktoken"

_SURVEY = ("row bigint, doc_id bigint, held_out boolean, n_tokens bigint, ids binary, word binary, n bigint,"
           " block int, counts binary")


def _ranks(content: str) -> dict[bytes, int]:
    """Token bytes and their ids from a vocabulary written as lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


def _survey(content: str, mark: int):
    def run(batches):
        import pyarrow as pa

        def make():
            import public_tokenizers
            import tiktoken
            return tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(content), special_tokens={})

        coder = kept_in_process(f"subwords_{mark}", make)
        size = coder.n_vocab + 1  # the end of a text comes after all ranks
        end = coder.n_vocab
        names = [c.split()[0] for c in _SURVEY.split(",")]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]

        def emit(**columns):
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds)], names=names)

        words: Counter = Counter()
        cells = np.zeros(-(-size // 4096) * 4096, np.int64)
        row = TaskContext.get().partitionId() << 40
        kind = _kind(size)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                piece = batch.slice(at, TOGETHER)
                held = piece.column(1).to_pylist()
                texts = [t.encode("utf-8", "surrogatepass").lower() for t in piece.column(2).to_pylist()]
                counts = []
                for text, out in zip(texts, held):
                    found = text.split()
                    counts.append(len(found) + 1)
                    if not out:
                        words.update(found)
                ids = [np.array([*coder.encode_ordinary(t.decode("utf-8", "surrogatepass")), end], kind) for t in texts]
                learned = [one for one, out in zip(ids, held) if not out]
                if learned:
                    cells += np.bincount(np.concatenate(learned), minlength=len(cells))
                packed = [one.tobytes() for one in ids]
                yield emit(row=list(range(row, row + len(ids))), doc_id=piece.column(0).to_pylist(), held_out=held,
                           n_tokens=counts, ids=packed)
                row += len(ids)
                if len(words) > FLUSH:
                    yield emit(word=list(words), n=list(words.values()))
                    words.clear()
        yield emit(word=list(words), n=list(words.values()))
        blocks, sums = block_rows(cells)
        yield emit(block=blocks, counts=sums)
    return run


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _learn(state, turn: int):
    """Trains on all windows of the task's rows; the weights as rows ``block, weight, values``, weighted by the number of targets."""
    def run(batches):
        import pyarrow as pa
        weights, trees, kind = state.value
        ids = model.Ids(*trees)
        trainer = model.Trainer(model.shaped(weights, ids.start), seed=turn, ids=ids)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                rows = [np.frombuffer(i, kind) for i in batch.slice(at, TOGETHER).column(0).to_pylist()]
                for a, b in _parts([len(i) for i in rows]):
                    trainer.add(*model.windows(rows[a:b], ids.start, ids.pad)[:2])
        trainer.flush()
        if trainer.targets:
            values = model.flat(trainer.w)
            blocks = [values[at:at + BLOCK].tobytes() for at in range(0, len(values), BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(blocks)), pa.int32()), pa.array([float(trainer.targets)] * len(blocks)), pa.array(blocks, pa.binary())],
                names=["block", "weight", "values"])
    return run


def _mean(batches):
    """The weighted mean of each block of the task."""
    import pyarrow as pa
    total: dict[int, np.ndarray] = {}
    weights: Counter = Counter()
    for batch in batches:
        for block, weight, values in zip(*(c.to_pylist() for c in batch.columns)):
            total[block] = total.get(block, 0.0) + weight * np.frombuffer(values, np.float32).astype(np.float64)
            weights[block] += weight
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([(v / weights[b]).astype(np.float32).tobytes() for b, v in total.items()], pa.binary())],
        names=["block", "values"])


def _score(state, content: str, mark: int):
    def run(batches):
        import pyarrow as pa
        weights, trees, kind, common = state.value
        net = model.Ids(*trees)
        w = model.shaped(weights, net.start)
        table = kept_in_process(f"bytes_{mark}", lambda: [*sorted(r := _ranks(content), key=r.get), b""])
        names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "n"]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]
        end_known, end_log = common[None]
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                piece = batch.slice(at, TOGETHER)
                rows = piece.column(0).to_pylist()
                ids = [np.frombuffer(i, kind) for i in piece.column(4).to_pylist()]
                total = np.zeros(len(ids))
                for a, b in _parts([len(i) for i in ids]):
                    x, y, owner = model.windows(ids[a:b], net.start, net.pad)
                    for s in range(0, len(x), AT_ONCE):
                        got = model.id_scores(w, x[s:s + AT_ONCE], y[s:s + AT_ONCE], net).sum(axis=1)
                        total[a:b] += np.bincount(owner[s:s + AT_ONCE], got, b - a)
                known, base, rare_row, rare_word, rare_n = [], [], [], [], []
                for i, (row, tokens) in enumerate(zip(rows, ids)):
                    n_known, logs = end_known, end_log
                    for word, n in Counter(b"".join([table[t] for t in tokens[:-1].tolist()]).split()).items():
                        value = common.get(word)
                        if value is None:
                            rare_row.append(row)
                            rare_word.append(word)
                            rare_n.append(n)
                        else:
                            n_known += n
                            logs += n * value
                    known.append(n_known)
                    base.append(logs)
                m = len(rare_row)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:4], pa.array(known, pa.int64()), pa.array(base), pa.array(total / math.log(10)),
                     pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.int64())], names=names)
                if m:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rare_row, pa.int64()), *(pa.nulls(m, k) for k in kinds[1:7]), pa.array(rare_word, pa.binary()),
                         pa.array(rare_n, pa.int64())], names=names)
    return run


def _parts(lengths: list[int], most: int = 1 << 19):
    """Neighbouring rows with about ``most`` ids; a longer row is a part of its own."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if lengths:
        yield start, len(lengths)


def _most_frequent(vocabulary: DataFrame) -> dict[bytes, float]:
    """Logarithms of the counts, plus one, of whole steps of frequency, most frequent first, up to ``FREQUENT`` words."""
    listed = vocabulary.where(F.length("word") <= WORD_BYTES).withColumn("step", F.floor(F.log2("c") * 4))
    total, last = 0, None
    for r in sorted(listed.groupBy("step").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["step"]):
        total += r["words"]
        if total > FREQUENT:
            break
        last = r["step"]
    if last is None:
        return {}
    chosen = listed.where(F.col("step") >= last).select("word", "c").toArrow()
    return dict(zip(chosen.column(0).to_pylist(), np.log10(chosen.column(1).to_numpy() + 1.0).tolist()))


def score(docs: DataFrame, tokenizer: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    A null or empty text has the end token alone. A null ``doc_id`` is in no fold
    and learned from; repeated rows each count and each give a row. Without any training row
    counts are 0 and the model is its untrained start. An empty table gives no rows.
    """
    content = open(tokenizer or vocabulary_file(RANKS), encoding="utf-8").read()
    mark = zlib.crc32(content.encode())
    spark = docs.sparkSession
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    rows = text_rows(docs).select("doc_id", fold.alias("held_out"), "text")
    survey = stored(rows.mapInArrow(_survey(content, mark), _SURVEY), "lm-survey")
    texts = survey.where("row is not null").select("row", "doc_id", "held_out", "n_tokens", "ids")
    vocabulary = stored(survey.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    totals = vocabulary.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("c")).first()
    ends = texts.where("not held_out").count()
    v, n = totals["v"] + (ends > 0), (totals["c"] or 0) + ends
    common = _most_frequent(vocabulary)
    common[None] = (1 if ends else 0, math.log10(ends + 1))

    size = len(_ranks(content)) + 1
    counts = summed_cells(survey, -(-size // 4096) * 4096)[:size].astype(np.float64)
    label, _ = model.classes_of(counts)
    trees = model.code_trees(label, counts)
    weights = model.flat(model.fresh(np.bincount(label, counts, model.CLASSES), ids=size))
    shards = int(-(-counts.sum() // SHARD)) or 1
    learned = texts.where("not held_out").select(F.xxhash64("ids").alias("row"), "ids")
    for turn in range(rounds if ends else 0):
        state = spark.sparkContext.broadcast((weights, trees, _kind(size)))
        mine = learned.where(F.pmod("row", F.lit(rounds)) == turn).repartition(shards, "row").sortWithinPartitions("row", "ids").select("ids")
        mean = (mine.mapInArrow(_learn(state, turn), "block int, weight double, values binary").repartition("block")
                .mapInArrow(_mean, "block int, values binary").collect())
        if mean:
            weights = np.frombuffer(b"".join([r["values"] for r in sorted(mean, key=lambda r: r["block"])]), np.float32)

    state = spark.sparkContext.broadcast((weights, trees, _kind(size), common))
    scored = stored(texts.mapInArrow(
        _score(state, content, mark), "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint,"
        " base double, score double, word binary, n bigint"), "lm-scores")
    rare = (scored.where("word is not null").select("row", "word", "n").join(vocabulary, "word")
            .groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs")))
    whole = scored.where("word is null").join(rare, "row", "left")
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"), "score")
