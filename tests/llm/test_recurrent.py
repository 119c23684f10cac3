"""op11: base columns against plain Python, the network's gradients and probabilities, held-out likelihood."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF001, SF01
from pyspark.sql import functions as F

from recengine.llm import recurrent as R
from recengine.llm.common import table
from tests.llm.conftest import ODD


def brute(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score."""
    split = []
    for doc_id, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        split.append((doc_id, zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2, [*re.findall(r"[^\x20\x09-\x0D]+", low), None]))
    c = Counter(t for _, held, tokens in split if not held for t in tokens)
    total, distinct = sum(c.values()), len(c)
    return sorted(((d if d is not None else -1, held, len(t), sum(c[x] > 0 for x in t), total,
                    round(sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in t), 4)) for d, held, t in split))


def rows_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in df.collect())


@pytest.mark.parametrize("head", [R.HEAD, 300, 0])
def test_base_columns(spark, head):
    docs = table(spark, SF001, "documents")
    got = R.score(docs, head=head)
    assert rows_of(got) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got.where("score > 0 or score is null or isnan(score)").count() == 0


def test_odd_rows(spark, frame):
    rows = [*ODD, *ODD[3:5], (10, "İ ÀÉ\x0b\x0c\xa0x\x00 Zz"), *[(k, f"one two w{k} W{k}") for k in range(20, 60)]]
    got = R.score(frame(rows)).cache()
    assert rows_of(got) == brute(rows)
    same = {(r.doc_id, round(r.score, 3)) for r in got.collect() if r.doc_id in (4, 5)}
    assert len({s for _, s in same}) == 1


def test_empty_clashing_and_no_training_rows(spark, frame):
    assert R.score(frame([])).count() == 0
    held = [(k, "a b") for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2]
    docs = frame(held)
    for c in ("row", "codes", "code", "ending", "n", "n_tokens", "id", "more", "known", "held_out"):
        docs = docs.withColumn(c, F.lit(1))
    assert rows_of(R.score(docs)) == brute(held)


def test_held_out_likelihood(spark):
    got = R.score(table(spark, SF01, "documents")).where("held_out")
    model, base, better = got.agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens"), F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()
    assert model > base + 0.2 and better > 0.95


MASS = np.random.default_rng(5).integers(1, 1000, R.UNITS).astype(float)


def test_gradients():
    net = R.Network(MASS, hidden=5)
    net.flat[:] = np.random.default_rng(1).normal(0, 0.5, len(net.flat))
    rng = np.random.default_rng(2)
    y = rng.integers(0, R.UNITS, (6, 4))
    x = np.concatenate([np.zeros((1, 4), int), y[:-1]])
    x[3, 1] = R.END
    state = rng.normal(0, 0.5, (4, 5)).astype(np.float32)
    start = net.flat.copy()

    def loss(flat):
        net.flat[:] = flat
        return -net.log_probs(net.run(x, state).reshape(-1, 5), y.reshape(-1)).sum()

    net.learn(x, y, state, rate=0.0)
    grad = net.grad * x.size
    for k in [*rng.choice(len(start), 60, replace=False), *np.argsort(-np.abs(grad))[:40]]:
        up, down = start.copy(), start.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(grad[k], abs=2e-2, rel=2e-2)


def test_unit_probabilities_sum_to_one():
    net = R.Network(MASS)
    state = np.repeat(np.random.default_rng(3).normal(0, 1, (1, R.HIDDEN)), R.UNITS, 0).astype(np.float32)
    assert np.exp(net.log_probs(state, np.arange(R.UNITS))).sum() == pytest.approx(1, abs=1e-5)


def test_words_of_a_unit_sum_to_one(spark):
    counts = R.token_counts(table(spark, SF001, "documents").select("text")).cache()
    words = R.vocabulary(counts, 500)
    rows = counts.collect()
    units, _, known = words.of(np.array([r.code for r in rows], np.int64).view(np.uint64), np.array([r.ending for r in rows]))
    total = np.zeros(R.UNITS)
    np.add.at(total, units, np.array([r.n for r in rows]) + 1.0)
    shared = np.arange(R.UNITS) > R.OWN
    assert known.sum() <= 500
    assert np.allclose(total[shared] + 1, 10 ** words.within[shared])  # every known word, and 1 for an unseen one
    assert np.bincount(units, minlength=R.UNITS)[:R.OWN + 1].max() == 1


def test_state_is_carried_through_whole_texts():
    net = R.Network(MASS)
    net.flat[:] = np.random.default_rng(4).normal(0, 0.4, len(net.flat))
    rng = np.random.default_rng(6)
    texts = [np.append(rng.integers(1, R.UNITS, n), R.END) for n in (0, 1, 15, 16, 17, 500, 33)]
    got = net.score(np.concatenate(texts).astype(np.uint8), np.array([len(t) for t in texts]))
    for t, s in zip(texts, got):
        x = np.concatenate([[R.END], t[:-1]])[:, None]
        whole = net.run(x, np.zeros((1, R.HIDDEN), np.float32))[:, 0]
        assert s == pytest.approx(net.log_probs(whole, t).sum(), rel=1e-5)


def test_training_lowers_the_loss():
    net = R.Network(np.ones(R.UNITS))
    units = np.tile(np.append(np.arange(1, 30), R.END), 400)
    losses = [net.fit(units) / len(units) for _ in range(6)]
    assert losses[-1] < 0.5 * losses[0]
