"""M7-M9: attention and convolution layers against plain numpy."""

import numpy as np
import pytest

from recengine.operators import gnn as N

RNG = np.random.default_rng(3)
# node 0 is a hub with most arcs, node 39 has none
ARCS = [(i, 0) for i in range(1, 39)] * 1 + [(int(a), int(b)) for a, b in RNG.integers(0, 39, (90, 2)) if a != b] + [(0, 0)]
ARCS = sorted(set(ARCS))
X = RNG.normal(size=(40, 5)) * 20


def frames(spark, parts):
    feats = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(X)], "node long, vec array<double>")
    return spark.createDataFrame(ARCS, "src long, dst long").repartition(parts), feats


def layer(**kw):
    rng = np.random.default_rng(7)
    return N.Attention(rng.normal(size=(5, 6)), rng.normal(size=(2, 3)), rng.normal(size=(2, 3)), **kw)


def brute(lay):
    h = (X @ lay.w).reshape(40, 2, 3)
    s, d = (h * lay.a_src).sum(2), (h * lay.a_dst).sum(2)
    alpha, out = {}, np.zeros((40, 2, 3))
    for t in range(40):
        src = [a for a, b in ARCS if b == t]
        if src:
            e = np.array([N.leaky(s[a] + d[t], 0.2) for a in src])
            w = np.exp(e - e.max(0))
            w /= w.sum(0)
            for a, row in zip(src, w):
                alpha[a, t] = row
                out[t] += row[:, None] * h[a]
    return alpha, out


@pytest.mark.parametrize("parts", [1, 9])
def test_coefficients(spark, parts, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")   # states of the hub meet in the merge
    try:
        want = brute(layer())[0]
        got = {(r.src, r.dst): r.alpha for r in N.attention_coefficients(*frames(spark, parts), layer()).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def elu(y):
    return np.where(y > 0, y, np.expm1(np.minimum(y, 0)))


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_concatenated_and_averaged(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    skip, bias = RNG.normal(size=(5, 6)), RNG.normal(size=6)
    try:
        lay = layer(skip=skip, bias=bias)
        got = {r.node: r.vec for r in N.attention_layer(*frames(spark, 5), lay).collect()}
        want = elu((brute(lay)[1] + (X @ skip).reshape(40, 2, 3)).reshape(40, 6) + bias)
        assert len(got) == 40 and all(np.allclose(got[k], want[k], atol=1e-9) for k in got)
        lay = layer(concat=False, activation=None)
        got = {r.node: r.vec for r in N.attention_layer(*frames(spark, 2), lay).collect()}
        want = brute(lay)[1].mean(1)
        assert all(np.allclose(got[k], want[k], atol=1e-9) for k in got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fold_in_any_order():
    top, total, mixed = RNG.normal(size=(9, 2)) * 50, np.ones((9, 2)), RNG.normal(size=(9, 2, 3))
    whole = N.fold(top, total, mixed, np.array([0]))
    parts = [N.fold(top[a:b], total[a:b], mixed[a:b], np.array([0])) for a, b in ((0, 4), (4, 5), (5, 9))]
    again = N.fold(*(np.concatenate(x) for x in zip(*parts)), np.array([0]))
    assert all(np.allclose(a, b) for a, b in zip(whole, again))


def test_convolution(spark):
    arcs = sorted({(a, b) for a, b in ARCS if a != b} | {(b, a) for a, b in ARCS if a != b})
    a = np.eye(40)
    for x, y in arcs:
        a[x, y] = 1
    s = 1 / np.sqrt(a.sum(1))
    w, bias = RNG.normal(size=(5, 3)), RNG.normal(size=3)
    y = (a * s[:, None] * s) @ X @ w + bias
    want = y - y.max(1, keepdims=True)
    want -= np.log(np.exp(want).sum(1, keepdims=True))
    df = spark.createDataFrame(arcs, "node long, nbr long")
    feats = frames(spark, 1)[1]
    got = {r.node: r.vec for r in N.convolution_layer(df, feats, w, bias, "log_softmax").collect()}
    assert len(got) == 40 and all(np.allclose(got[k], want[k]) for k in got)
    got = {r.node: r.vec for r in N.convolution_layer(df, feats, activation=None).collect()}
    assert all(np.allclose(got[k], ((a * s[:, None] * s) @ X)[k]) for k in got)


def test_convolution_sends_no_vector_for_an_arc(spark, monkeypatch):
    arcs = sorted({(a, b) for a, b in ARCS if a != b} | {(b, a) for a, b in ARCS if a != b})
    df, feats = spark.createDataFrame(arcs, "node long, nbr long"), frames(spark, 1)[1]
    w = RNG.normal(size=(5, 3))
    one = N.convolution_layer(df, feats, w)
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "aggregate_metrics" not in plan.lower() and "summarizer" not in plan.lower()
    rows = lambda d: {r.node: r.vec for r in d.collect()}
    want = rows(one)
    monkeypatch.setattr(N, "CELL_ARCS", 2)                  # many cells
    many = rows(N.convolution_layer(df, feats, w))
    assert len(many) == 40 and all(np.allclose(many[k], want[k]) for k in want)


def test_no_arcs(spark):
    feats = frames(spark, 1)[1]
    none = spark.createDataFrame([], "src long, dst long")
    got = {r.node: r.vec for r in N.attention_layer(none, feats, layer(bias=np.arange(6.0))).collect()}
    assert len(got) == 40 and got[5] == [0, 1, 2, 3, 4, 5]
    assert N.attention_coefficients(none, feats, layer()).count() == 0
