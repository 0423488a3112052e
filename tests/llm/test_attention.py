"""The attention model against plain loops, finite differences and other partitionings."""

import math

import numpy as np
import pytest

from corpuswright.llm import attention as m, language_model


def made(seed=3, n=6):
    rng = np.random.default_rng(seed)
    w = m.fresh(np.ones(m.CLASSES), seed)
    return w, m.windows([rng.integers(0, m.CLASSES, int(k)) for k in rng.integers(1, 70, n)])


def plain(w, inputs, target):
    """Log probability of one class after ``inputs``, the last of them the position that asks."""
    q, keys = w["query"][inputs[-1]].astype(float), w["key"][inputs].astype(float)
    score = keys @ q / math.sqrt(m.WIDTH) + np.array([w["distance"][len(inputs) - 1 - i] for i in range(len(inputs))])
    a = np.exp(score - score.max())
    z = (a / a.sum()) @ w["value"][inputs].astype(float)
    logits = np.maximum(w["input"][inputs[-1]] + z, 0) @ w["output"].astype(float) + w["bias"]
    return logits[target] - logits.max() - math.log(np.exp(logits - logits.max()).sum())


def test_scores_equal_plain_loops():
    rng = np.random.default_rng(1)
    w = m.fresh(np.ones(m.CLASSES))
    for n in (1, 19, 20, 21, 75):
        seq = rng.integers(0, m.CLASSES, n)
        x, y, owner = m.windows([seq])
        got = m.class_scores(w, x, y)[y >= 0]
        given = np.r_[m.START, seq[:-1]]
        want = []
        for t in range(n):
            first = max(0, t // m.SCORED * m.SCORED - m.CONTEXT)  # what the window of t shows
            want.append(plain(w, given[first:t + 1], seq[t]))
        assert np.allclose(got, want, atol=1e-4) and len(got) == n


def test_gradients_equal_finite_differences():
    w, (x, y, _) = made()
    w = {k: v.astype(np.float64) for k, v in w.items()}
    found = m.gradients({k: v.astype(np.float32) for k, v in w.items()}, x, y)
    loss = lambda v: -m.class_scores(v, x, y).astype(float).sum() / (y >= 0).sum()
    rng = np.random.default_rng(2)
    for name in m.NAMES:
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in w[name].shape)
            sides = []
            for step in (1e-4, -1e-4):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name][at] += step
                sides.append(loss(moved))
            assert math.isclose(found[name][at], (sides[0] - sides[1]) / 2e-4, rel_tol=0.02, abs_tol=2e-5), (name, at)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(5)
    seqs = [np.tile(rng.permutation(8), 12) for _ in range(60)]
    x, y, _ = m.windows(seqs)
    trainer = m.Trainer(m.fresh(np.ones(m.CLASSES)))
    before = m.class_scores(trainer.w, x, y).sum()
    for _ in range(15):
        trainer.add(x, y)
        trainer.flush()
    assert m.class_scores(trainer.w, x, y).sum() > before / 2


@pytest.fixture(scope="module")
def some(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def test_scores_do_not_depend_on_the_partitioning(spark, some, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD", 20_000)  # several shards
    scores = [sorted((r["doc_id"], round(r["score"], 3), r["n_tokens"], r["n_known"]) for r in language_model.score(some.repartition(p)).collect())
              for p in (1, 7)]
    assert scores[0] == scores[1]


def test_held_out_scores_beat_the_untrained_start(spark, some):
    trained = language_model.score(some).where("held_out").agg({"score": "sum"}).first()[0]
    untrained = language_model.score(some, rounds=0).where("held_out").agg({"score": "sum"}).first()[0]
    assert trained > untrained


def single_ids(n=200, seed=4):
    """Trees over ``n`` ids of unlike counts, and windows in which each id is followed by one other."""
    counts = np.random.default_rng(seed).integers(1, 50, n).astype(float)
    label, share = m.classes_of(counts)
    ids = m.Ids(*m.code_trees(label, counts))
    w = m.fresh(np.bincount(label, counts, m.CLASSES), ids=n)
    x, y, _ = m.windows([np.roll(np.arange(n), -k)[:60] for k in range(0, n, 7)], ids.start, ids.pad)
    return ids, w, x, y, share


def test_probabilities_are_over_single_ids_and_follow_the_context():
    ids, w, x, y, share = single_ids()
    start = m.id_scores(w, x, y, ids) - m.class_scores(w, ids.label[x], ids.classes(y))
    assert np.allclose(start[y >= 0], share[y[y >= 0]], atol=1e-4)
    rng = np.random.default_rng(1)
    w |= {n: rng.normal(0, 0.5, w[n].shape).astype(np.float32) for n in ("own", "node")}
    every = np.exp([m.id_scores(w, x[:3], np.full_like(y[:3], i), ids) for i in range(200)])
    assert np.allclose(every.sum(axis=0), 1, atol=1e-3)
    same = np.flatnonzero(ids.label[:200] == ids.label[np.argmax(ids.depth)])
    within = every[same] / every[same].sum(axis=0)
    assert within.max(axis=(1, 2)).min() > within.min(axis=(1, 2)).min() + 0.01


def test_gradients_of_single_ids_equal_finite_differences():
    ids, w, x, y, _ = single_ids()
    rng = np.random.default_rng(2)
    w |= {n: rng.normal(0, 0.3, w[n].shape).astype(np.float32) for n in ("own", "node")}
    w, found = {k: v.astype(np.float64) for k, v in w.items()}, m.gradients(w, x, y, ids)
    loss = lambda v: -m.id_scores(v, x, y, ids).astype(float).sum() / (y >= 0).sum()
    for name in ("own", "node", "spread", "query", "value", "output"):
        rows, g = found[name] if isinstance(found[name], tuple) else (np.arange(len(found[name])), found[name])
        for i in rng.integers(0, len(rows), 5):
            at, sides = (rows[i], int(rng.integers(0, g.shape[1]))), []
            for step in (1e-4, -1e-4):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name][at] += step
                sides.append(loss(moved))
            assert math.isclose(g[i, at[1]], (sides[0] - sides[1]) / 2e-4, rel_tol=0.03, abs_tol=2e-5), (name, at)


def test_training_tells_ids_of_one_class_apart():
    ids, w, x, y, _ = single_ids()
    trainer = m.Trainer(w, ids=ids)
    for _ in range(40):
        trainer.add(x, y)
        trainer.flush()
    there = (y >= 0) & (ids.depth[y] > 0)
    assert m.id_scores(trainer.w, x, y, ids)[there].mean() > m.id_scores(w, x, y, ids)[there].mean() / 2


def test_shards_without_rows_leave_the_weights(spark, some):
    one = some.where("doc_id is not null").limit(1)
    assert language_model.score(one).count() == 1
