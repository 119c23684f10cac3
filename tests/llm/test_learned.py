"""Toxicity grammar, ordinal quality and spaced seeds: odd rows, held-out figures, brute force."""

import random
import zlib

import numpy as np
import pytest

from conftest import SF001
from llm.conftest import ODD
from recengine.llm import decontam, ordinal, toxicity

SF01 = SF001.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF01}/labels.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet")


def test_toxicity_on_held_out_rows(docs, labels):
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    rows = [(truth[i], r.predicted) for i, r in got.items() if r.held_out and i in truth]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert sum(a == b for a, b in rows) / len(rows) >= 0.9


def test_toxicity_odd_rows(frame, labels):
    got = toxicity.score(frame(ODD), labels).collect()
    assert len(got) == len(ODD) and all(r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert toxicity.score(frame([]), labels).collect() == []
    alone = toxicity.score(frame([(1, "you are an idiot"), (2, "he said you are not an idiot"), (3, "a fine day")]), labels.limit(0))
    s = {r.doc_id: r.score for r in alone.collect()}
    assert s[1] > s[2] > s[3] == 0


def test_ordinal_fit_orders_three_grades():
    rng = random.Random(5)
    words = [["bad"], ["middling"], ["good"]]
    grades = np.array([rng.randrange(3) for _ in range(300)])
    texts = [" ".join(words[g] * 3 + rng.choices("abcdefgh", k=5)) for g in grades]
    w, theta = ordinal.fit(texts, grades)
    f = [(w[a] * v).sum() for a, v in map(ordinal.features, ("bad bad bad", "middling middling", "good good good"))]
    assert f[0] < f[1] < f[2] and theta[0] < theta[1]


def test_ordinal_held_out(docs, labels):
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    learned = labels.where("doc_id % 3 != 0")
    got = {r.doc_id: r for r in ordinal.classify(docs, learned).collect()}
    rows = [(truth[i], int(r.keep)) for i, r in got.items() if i in truth and i % 3 == 0]
    assert len(got) == docs.count() and sum(a == b for a, b in rows) / len(rows) >= 0.9


def test_ordinal_odd_rows(frame, labels):
    assert len(ordinal.classify(frame(ODD), labels).collect()) == len(ODD)
    assert ordinal.classify(frame([]), labels).collect() == []
    none = ordinal.classify(frame(ODD), labels.limit(0)).collect()
    assert {(r.expected_grade, r.keep) for r in none} == {(0.0, False)}


def _brute(docs, items):
    """(doc, item) -> most words that the mask hits of one diagonal cover."""
    best = {}
    for d, t in docs:
        dw = t.encode().translate(decontam.FOLD).split()
        for i, u in items:
            iw = u.encode().translate(decontam.FOLD).split()
            for shift in range(-len(iw) + 1, len(dw)):
                covered = set()
                for mask in decontam.MASKS:
                    at = [k for k, c in enumerate(mask) if c == "1"]
                    for p in range(len(iw) - len(mask) + 1):
                        if 0 <= p + shift <= len(dw) - len(mask) and all(iw[p + k] == dw[p + shift + k] for k in at):
                            covered |= {p + k for k in at}
                if covered and len(covered) >= min(10, 0.6 * len(iw)):
                    best[d, i] = max(best.get((d, i), 0), len(covered))
    return best


def test_seeds_match_brute_force(spark, frame):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([5, 12, 20])))) for k in range(8)]
    rows = []
    for d in range(30):
        words = rng.choices(vocab, k=40)
        if d % 2:
            passage = items[d % 8][1].split()
            passage[rng.randrange(len(passage))] = "other"
            words[10:10] = passage
        rows.append((d, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontam.leaks(frame(rows), bench).collect()}
    assert got == _brute(rows, items) and got


def test_seeds_odd_rows(spark, frame):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, None), (None, "x y")], "item_id long, text string")
    assert decontam.leaks(frame(ODD), bench).collect() == []
    assert decontam.leaks(frame([]), bench).collect() == []
    assert decontam.leaks(frame([(1, "a b c d e f g h i j k l")]), bench.limit(0)).collect() == []
    twice = frame([(1, "A b c, d e f g h i j k l"), (1, "A b c, d e f g h i j k l")])
    assert [(r.doc_id, r.item_id, r.start_word, r.matched) for r in decontam.leaks(twice, bench).collect()] == [(1, 1, 0, 12)]


def test_verified_overlaps_match_word_comparison(spark, frame):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocab, k=n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 8, 15, 20, 30, 59])]
    rows = []
    for d in range(260):
        words, passage = rng.choices(vocab, k=60), items[d % 13][1].split()
        at = range(2, len(passage), 3) if d % 2 else rng.sample(range(len(passage)), len(passage) // 5)
        for k in at:
            passage[k] = f"other{k}"
        cut = rng.choice([0, 30, 60])
        rows.append((d, " ".join(words[:cut] + passage + words[cut:])))
    want = {}
    for d, t in rows:
        dw = t.split()
        for i, u in items:
            iw = u.split()
            best = max(sum(0 <= p + s < len(dw) and iw[p] == dw[p + s] for p in range(len(iw))) for s in range(-len(iw) + 1, len(dw)))
            if best >= min(10, 0.6 * len(iw)):
                want[d, i] = best
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontam.verified(frame(rows), bench).collect()}
    short = lambda x: {k: v for k, v in x.items() if k[1] <= 8}
    assert short(got) == short(want)
    assert all(got.get((d, d % 13)) == want[d, d % 13] for d in range(260) if d % 2 and (d, d % 13) in want)
    assert all(want[k] == v for k, v in got.items()) and len(got) >= 0.99 * len(want)
    old = {(r.doc_id, r.item_id) for r in decontam.leaks(frame(rows), bench).collect()}
    assert len(old) < 0.7 * len(want)


def test_verified_odd_rows(spark, frame):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, None), (None, "x y"), (3, ""), (4, "three")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.verified(frame(ODD), bench).orderBy("doc_id").collect()] == [(4, 4), (5, 4)]
    assert decontam.verified(frame([]), bench).collect() == []
    assert decontam.verified(frame([(1, "a b c d e f g h i j k l")]), bench.limit(0)).collect() == []
    twice = frame([(1, "A b c, d e f g h i j k l"), (1, "A b c, d e f g h i j k l")])
    assert [(r.doc_id, r.item_id, r.start_word, r.matched) for r in decontam.verified(twice, bench).collect()] == [(1, 1, 0, 12)]


def test_toxicity_sends_short_distinct_words(spark, frame):
    """What goes to the labels: beginnings of the training rows' words, by a join whose kind doesn't change with the size."""
    from recengine.llm.toxicity import held_out, rated_words
    text = "Worthlessness, worthlessly! the the abcd abcd ABCDE é_étéé " + "again " * 1000
    docs = frame([(k, text) for k in range(8)] + [(None, text), (100, None)])
    marks = spark.createDataFrame([(k, 1) for k in range(8)] + [(None, 1), (100, 0)], "doc_id long, toxic int")
    out = rated_words(docs, marks)
    train = spark.createDataFrame([(k,) for k in [*range(8), 100]], "doc_id long").where(~held_out()).count()
    rows = {(r.y, r.words) for r in out.collect()}
    assert out.count() == train and (1, "worthl abcd abcde é_étéé again") in rows
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
