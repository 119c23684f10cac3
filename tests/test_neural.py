"""The neural scorers against plain numpy; K2: the ranking factorisation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recengine.operators import neural as N
from recengine.operators import ranking_mf as R

SHAPES = {name: N.shape_of(name, factors=3, layers=(6, 5, 4), text=2, graph=2) for name in N.SCORERS}


@pytest.mark.parametrize("name", N.SCORERS)
def test_gradients(name):
    shape = SHAPES[name]
    rng = np.random.default_rng(1)
    flat = N.Tower.start(shape, 3) + rng.normal(0, 0.1, shape.n_tower)
    u, i, side, y = rng.normal(size=(7, shape.embedding)), rng.normal(size=(7, shape.embedding)), rng.normal(size=(7, shape.side)), rng.integers(0, 2, 7)

    def loss(flat, u, i):
        p = N.Tower(shape, flat).run(u, i, side)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    tower = N.Tower(shape, flat)
    d_u, d_i, lost = tower.back(u, i, side, y)
    assert lost == pytest.approx(loss(flat, u, i))
    for grad, at in ((tower.grad, 0), (d_u, 1), (d_i, 2)):
        args = [flat, u, i]
        for k in rng.choice(grad.size, min(grad.size, 25), replace=False):
            ends = []
            for step in (1e-6, -1e-6):
                moved = args[at].copy()
                moved.flat[k] += step
                ends.append(loss(*[moved if j == at else a for j, a in enumerate(args)]))
            assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(grad.flat[k], abs=1e-4)


def test_widths():
    assert SHAPES["gmf"].embedding == 3 and SHAPES["mlp"].embedding == 3 and SHAPES["neumf"].embedding == 6
    assert SHAPES["mlp"].tower == [(6, 5), (5, 4), (4, 1)] and SHAPES["multimf"].tower[-1] == (4 + 3 + 2 + 4, 1)
    assert N.shape_of("graphmf", graph=129).side == 258 and N.shape_of("graphmf", graph=129, use_item_embedding=False).side == 129


def planted(spark):
    # users like the items of their own parity; user 0 has a third of the rows
    rows = [(u if k % 3 else 0, i, float((u if k % 3 else 0) % 2 == i % 2)) for k, (u, i) in enumerate((u, i) for u in range(40) for i in range(30))]
    return spark.createDataFrame(rows, "user_id long, item_id long, label double")


def one_step(rows, shape, emb, flat, rate):
    """A full-batch step in plain numpy: {(kind, id): vec}, tower, loss."""
    tower = N.Tower(shape, flat.copy())
    u, i = (np.array([emb[k, r[c]] for r in rows]) for c, k in ((0, "u"), (1, "i")))
    d_u, d_i, lost = tower.back(u, i, np.empty((len(rows), 0)), np.array([r[2] for r in rows]))
    out = {}
    for kind, c, d in (("u", 0, d_u), ("i", 1, d_i)):
        ids = np.array([r[c] for r in rows])
        for x in np.unique(ids):
            vec = np.array(emb[kind, x])
            N._adam(vec, np.zeros_like(vec), np.zeros_like(vec), np.array(1), d[ids == x].sum(0) / (ids == x).sum(), rate)
            out[kind, x] = vec
    N._adam(tower.flat, np.zeros_like(flat), np.zeros_like(flat), np.array(1), tower.grad / len(rows), rate)
    return out, tower.flat, lost / len(rows)


def test_one_step_is_the_full_gradient(spark):
    samples, shape = planted(spark), N.Shape(3, (4, 3))
    start = {(r.kind, r.id): r.vec for r in N.start_embeddings(samples, shape, 42).collect()}
    want, flat, loss = one_step([tuple(r) for r in samples.collect()], shape, start, N.Tower.start(shape, 42), 0.05)
    model = N.fit(samples.repartition(7), shape, epochs=1, batches=1, rate=0.05)
    got = {(r.kind, r.id): r.vec for r in model.embeddings.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    assert np.allclose(model.tower, flat) and model.losses == [pytest.approx(loss)]


def test_equal_samples_are_one_row(spark, monkeypatch):
    """A user's negatives repeat in each of its lists: they travel once, and the step is that of all the rows."""
    samples, shape = planted(spark), N.Shape(3, (4, 3))
    rows = [tuple(r) for r in samples.collect() for _ in range(1 + 4 * (r.label == 0))]
    again = spark.createDataFrame(rows, samples.schema).repartition(5)
    start = {(r.kind, r.id): r.vec for r in N.start_embeddings(samples, shape, 42).collect()}
    want, flat, loss = one_step(rows, shape, start, N.Tower.start(shape, 42), 0.05)
    real, met = N._with_embeddings, []

    def watched(batch, *args, **kw):
        met.append(batch.count())
        return real(batch, *args, **kw)

    monkeypatch.setattr(N, "_with_embeddings", watched)
    model = N.fit(again, shape, epochs=1, batches=1, rate=0.05)
    assert met == [samples.distinct().count()] and met[0] < len(rows)
    got = {(r.kind, r.id): r.vec for r in model.embeddings.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    assert np.allclose(model.tower, flat) and model.losses == [pytest.approx(loss)]


def test_steps_over_many_batches(spark):
    """An id whose rows are cut by the ends of Arrow batches is updated once, with its whole gradient; the others keep their state."""
    samples, shape = planted(spark), N.Shape(3, (4, 3))
    want = N.fit(samples, shape, epochs=2, batches=3, rate=0.05)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        got = N.fit(samples, shape, epochs=2, batches=3, rate=0.05)
        vecs = [{(r.kind, r.id): r.vec for r in m.embeddings.collect()} for m in (want, got)]
    finally:
        spark.conf.set(name, before)
    assert vecs[0].keys() == vecs[1].keys() and all(np.allclose(vecs[0][k], vecs[1][k], atol=1e-5) for k in vecs[0])
    assert got.losses == [pytest.approx(x, rel=1e-5) for x in want.losses]


def test_step_shuffles_the_states_once(spark):
    """States and parts of gradients meet in one exchange, in single precision."""
    samples, shape = N.weighted(planted(spark)).withColumn("side", F.array().cast("array<double>")), N.Shape(3, (4, 3))
    nulls = [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in N._ROWS.split(", ")[6:]]
    table = N.start_embeddings(samples, shape).select(*N._STATE, *nulls).localCheckpoint()
    after = N._updated(table, N._gradients(samples.localCheckpoint(), table, shape, N.Tower.start(shape, 1)), shape.embedding, 0.05)
    assert dict(after.dtypes)["vec"] == dict(after.dtypes)["grad"] == "array<float>"
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "HashAggregate" not in plan
    assert after.where("kind <> 'w'").groupBy("kind", "id").count().where("count > 1").count() == 0


def test_sides_by_id_are_those_of_the_samples(spark):
    """Fitting and scoring with sides kept by id is fitting and scoring with a side in every sample."""
    samples = planted(spark).where("user_id < 12")
    text = spark.createDataFrame([(i, [float(i % 2), 0.5]) for i in range(25)], "item_id long, text array<double>")
    graph = spark.createDataFrame([(n, [n / 50.0]) for n in range(5, 60)], "node long, vec array<double>")
    args, shape = (("text", "graph"), text, graph, 40, (2, 1)), N.Shape(2, (4, 2), 4)
    inside = N.with_side(samples, *args)
    one = N.fit(inside, shape, epochs=1, batches=2)
    two = N.fit(samples, shape, epochs=1, batches=2, sides=N.id_sides(*args))
    assert np.allclose(one.tower, two.tower) and one.losses == [pytest.approx(x) for x in two.losses]
    scores = [{(r.user_id, r.item_id): r.score for r in rows.collect()} for rows in (one.score(inside), two.score(samples))]
    assert scores[0].keys() == scores[1].keys() and all(scores[0][k] == pytest.approx(scores[1][k]) for k in scores[0])


def test_learns_and_scores_unknown_ids(spark):
    samples = planted(spark)
    model = N.fit(samples, N.Shape(4, (8, 4)), epochs=6, batches=3, rate=0.08)
    right = model.score(samples).agg(F.avg(((F.col("score") > 0.5) == (F.col("label") == 1)).cast("int"))).first()[0]
    assert right > 0.95 and model.losses[-1] < 0.5 * model.losses[0]
    odd = spark.createDataFrame([(0, 0, "x"), (None, 1, "y"), (999, None, None)], "user_id long, item_id long, extra string")
    got = model.score(odd).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got) and set(got[0].asDict()) == {"user_id", "item_id", "extra", "score"}


def test_side_vectors(spark):
    pairs = spark.createDataFrame([(0, 0), (1, 5), (7, 1)], "user_id long, item_id long")
    text = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "item_id long, text array<double>")
    graph = spark.createDataFrame([(0, [9.0]), (1, [8.0]), (10, [7.0])], "node long, vec array<double>")
    rows = lambda *a: {(r.user_id, r.item_id): r.side for r in N.with_side(pairs, *a).collect()}
    assert rows(("text", "graph"), text, graph, 10, (2, 1)) == {(0, 0): [1, 2, 9, 7], (1, 5): [0, 0, 8, 0], (7, 1): [3, 4, 0, 0]}
    assert rows(("graph",), None, graph, 10, (2, 1), False) == {(0, 0): [9], (1, 5): [8], (7, 1): [0]}
    assert rows(()) == {(0, 0): [], (1, 5): [], (7, 1): []}


def test_side_alone_is_learned(spark):
    rows = [(u, i, float(i % 2), [1.0 if i % 2 else -1.0]) for u in range(20) for i in range(20)]
    samples = spark.createDataFrame(rows, "user_id long, item_id long, label double, side array<double>")
    model = N.fit(samples, N.Shape(1, (), 1), epochs=6, batches=2, rate=0.2)
    assert model.losses[-1] < 0.5 and model.tower[1] > 0
    with pytest.raises(ValueError):
        N.fit(samples, N.Shape(0, (), 1))


def test_empty_and_null_rows(spark):
    empty = spark.createDataFrame([(None, 1, 1.0), (1, None, 0.0)], "user_id long, item_id long, label double")
    model = N.fit(empty, N.Shape(2, (4, 2)), epochs=1, batches=2)
    assert model.losses == [0.0] and model.embeddings.count() == 0


# ---------------------------------------------------------------- K2
def groups(spark, extra=()):
    # even users have even items; item 0 is everybody's
    rows = [(u, i) for u in range(60) for i in range(40) if (u % 2 == i % 2 and (u * 7 + i * 3) % 5) or i == 0]
    return spark.createDataFrame([*rows, *extra], "user_id long, item_id long")


@pytest.mark.parametrize("kw", [{"blocks": 1}, {"blocks": 2, "hot_share": 0.012}, {"blocks": 3, "hot_share": 0.0}])
def test_ranking_order(spark, kw):
    data = groups(spark, [(0, 2), (0, 2), (None, 3), (4, None)])
    model = R.fit_ranking(data, rank=4, epochs=8, rate=0.3, **kw)
    lists = spark.createDataFrame([(u, i, float(u % 2 == i % 2)) for u in range(60) for i in range(1, 40)], "user_id long, item_id long, label double")
    assert R.pairwise_auc(model.score(lists), ["user_id"]).first()[0] > 0.9
    assert model.losses[-1] < model.losses[0]
    assert model.users.count() == 60 and model.items.count() == 40
    assert {r.vec[-1] for r in model.users.collect()} == {1.0}
    assert model.score(spark.createDataFrame([(999, 1)], "user_id long, item_id long")).first().score == 0.0


def test_every_pair_is_learned_once_an_epoch(spark, monkeypatch):
    """The cells hand back the updates of their users: over an epoch, one for every distinct pair, with hot ids and without."""
    counted = []
    real = R._averaged

    def watched(cells):
        counted.append({(r.kind, r.id): r.n for r in cells.groupBy("kind", "id").agg(F.sum("n").alias("n")).collect()})
        cold = cells.where("not hot").groupBy("kind", "id").count()
        assert cold.where("count > 1").count() == 0      # no two tasks share a cold factor
        return real(cells)

    monkeypatch.setattr(R, "_averaged", watched)
    data = groups(spark, [(0, i) for i in range(40)])
    pairs = {tuple(r) for r in data.distinct().collect()}
    for hot_share in (1.0, 0.012, 0.0):
        counted.clear()
        R.fit_ranking(data, rank=3, epochs=1, blocks=3, hot_share=hot_share)
        assert len(counted) == 3
        for kind, c in ((R.USER, 0), (R.ITEM, 1)):
            want = {}
            for p in pairs:
                want[p[c]] = want.get(p[c], 0) + 1
            got = {x: sum(m.get((kind, x), 0) for m in counted) for x in want}
            assert got == want


def test_a_stratum_writes_its_factors_once(spark, monkeypatch):
    """A block follows from the id: no stratum joins its factors to the table before or writes them again."""
    real, names, blocks = R.written, [], []

    def watched(df, name="cut", **kw):
        names.append(name)
        if name == "cells":
            blocks.append("Join" in df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name, **kw)

    monkeypatch.setattr(R, "written", watched)
    R.fit_ranking(groups(spark), rank=3, epochs=2, blocks=2, hot_share=0.012)
    assert names.count("cells") == 4 and names.count("factors") == 2 and not any(blocks)


def test_negatives_avoid_known_items():
    items = np.zeros((50, 2))
    users = np.ones((1, 2))
    R.sgd(users, items, np.zeros(30, int), np.arange(30), np.random.default_rng(1), 0.1, 0.0)
    assert (items[:30, 1] >= 0).all() and (items[:30, 1] > 0).sum() >= 29 and (items[30:, 1] <= 0).all() and items[30:, 1].min() < 0


def test_ranking_of_nothing(spark):
    model = R.fit_ranking(spark.createDataFrame([], "user_id long, item_id long"), epochs=1)
    assert model.users.count() == 0 and model.losses == [0.0]


def test_pairwise_auc(spark):
    rows = [(1, 1.0, 3.0), (1, 0.0, 2.0), (1, 0.0, 3.0), (2, 1.0, 0.0), (2, 0.0, 1.0), (3, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "user_id long, label double, score double")
    assert R.pairwise_auc(df, ["user_id"]).first()[0] == pytest.approx((0.75 + 0.0) / 2)


def test_sides_are_never_broadcast(spark):
    """Spark would broadcast the ids' vectors by the size of their files, which is many times less than what the driver would hold."""
    items = spark.range(30).select(F.col("id").alias("item_id"), F.array_repeat(F.lit(0.5), 4).alias("text"))
    sides = N.id_sides(("text",), items, widths=(4, 0))
    met = N._side_of(planted(spark), sides, "i", "item_id")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {r.n for r in met.select(F.size("__i_first").alias("n")).collect()} == {4}


def nulls_in_lists(kind):
    """Counts the null lists of an Arrow batch or table."""
    return lambda t: sum(t.column(c).null_count for c in t.schema.names if str(t.schema.field(c).type).startswith(kind))


def test_cells_get_no_null_lists(spark, monkeypatch):
    """Spark's Arrow writer goes over a run of null lists again with every row; and every cell is a partition of its own."""
    nulls = nulls_in_lists("list")

    def cell(width, *_):
        def run(key, table):
            import pyarrow as pa
            from pyspark import TaskContext
            own = np.array([float(nulls(table)), float(TaskContext.get().partitionId() != key[0].as_py())])
            return pa.table({"kind": pa.array([R.USER] * 2, pa.int32()), "id": pa.array([0, 1]), "vec": R.list_array(np.zeros((2, width))), "hot": [False] * 2,
                             "n": [0.0] * 2, "loss": own})
        return run

    monkeypatch.setattr(R, "_cell", cell)
    assert R.fit_ranking(planted(spark), rank=3, epochs=1, blocks=5).losses == [0.0]


def test_step_gets_no_null_lists(spark, monkeypatch):
    samples, shape = N.weighted(planted(spark)).withColumn("side", F.array().cast("array<double>")), N.Shape(3, (4, 3))
    empty = [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in N._ROWS.split(", ")[6:]]
    table = N.start_embeddings(samples, shape).select(*N._STATE, *empty).localCheckpoint()
    grads = N._gradients(samples.localCheckpoint(), table, shape, N.Tower.start(shape, 1)).localCheckpoint()
    nulls, met = nulls_in_lists("list"), []
    kind = type(table)
    monkeypatch.setattr(kind, "mapInArrow", lambda df, run, schema: met.append(df) or df)
    N._updated(table, grads, shape.embedding, 0.05)
    monkeypatch.undo()
    assert len(met) == 1 and met[0].count() == table.count() + grads.count()
    assert nulls(met[0].toArrow()) == 0
