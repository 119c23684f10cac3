"""M5: block Lanczos against a dense eigensolver."""

import numpy as np
import pytest

from recengine.operators import spectral as S


def graph(spark, n, edges):
    nodes = spark.createDataFrame([(k,) for k in range(n)], "node long")
    return nodes, spark.createDataFrame([(min(e), max(e)) for e in edges], "src long, dst long")


def dense(n, edges):
    a = np.zeros((n, n))
    for x, y in edges:
        a[x, y] = a[y, x] = 1
    d = a.sum(1)
    s = np.divide(1, np.sqrt(d), out=np.zeros(n), where=d > 0)
    return np.linalg.eigvalsh(np.diag((d > 0).astype(float)) - a * s[:, None] * s)[::-1]


def random_edges(n, m, seed, hub=False):
    rng = np.random.default_rng(seed)
    e = {tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(m)}
    return sorted(e | {(0, k) for k in range(1, n) if hub})


@pytest.mark.parametrize("n, m, hub, options", [(60, 150, False, {}), (40, 50, True, {"block": 8, "max_basis": 24})])
def test_against_dense(spark, n, m, hub, options):
    edges = random_edges(n, m, n, hub)
    found = S.leading_eigenpairs(*graph(spark, n, edges), 4, tol=1e-5, **options)
    assert np.allclose(found.values, dense(n, edges)[:4], atol=1e-9)
    assert found.residuals.max() <= 1e-5 and (np.diff(found.values) <= 0).all()
    residual, error = S.largest_residual(found, *graph(spark, n, edges))
    assert residual <= 2e-5 and error < 1e-9
    assert residual == pytest.approx(found.residuals.max(), abs=1e-8)


def test_all_pairs_of_a_small_graph(spark):
    # k as large as the graph, an isolated node, a double edge in both directions
    edges = [(0, 1), (1, 2), (2, 3), (0, 3)]
    found = S.leading_eigenpairs(*graph(spark, 5, [*edges, (0, 1)]), 5)
    assert np.allclose(found.values, dense(5, edges), atol=1e-9) and found.steps <= 3
    emb = {r.node: r.vec for r in S.scaled(found).collect()}
    assert len(emb) == 5 and np.allclose(np.square(list(emb.values())).sum(0), np.maximum(found.values, 0))


def test_stops_unconverged_and_says_so(spark):
    edges = random_edges(60, 150, 5)
    found = S.leading_eigenpairs(*graph(spark, 60, edges), 4, tol=1e-12, block=4, max_steps=2)
    assert found.steps == 2 and found.residuals.max() > 1e-6


def test_string_nodes_and_empty(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert np.allclose(S.leading_eigenpairs(nodes, edges, 2).values, [2, 1])
    assert S.spectral_embedding(*graph(spark, 0, []), 3).count() == 0


@pytest.mark.parametrize("cells", [(1, 1), (3, 2)])
def test_cell_sums(spark, monkeypatch, cells):
    # string nodes, an id with two vectors, an id without one, a null end, more arcs of a node than a step's rows
    monkeypatch.setattr(S, "OUT_NUMBERS", 6)
    rng = np.random.default_rng(3)
    arcs = [("hub", f"n{k}") for k in range(20)] + [(f"n{k}", f"n{int(rng.integers(20))}") for k in range(15)] + [("n1", "gone"), ("n2", None), ("lost", "gone")]
    held = [(f"n{k}", rng.normal(size=2).tolist()) for k in range(20)]
    held += [("n3", [1.0, 2.0])]
    a, v = spark.createDataFrame(arcs, "node string, nbr string"), spark.createDataFrame(held, "node string, vec array<double>")
    got = {r.node: r["sum"] for r in S.cell_sums(a, v, 2, cells).collect()}
    plain = {r.node: r["sum"] for r in S.neighbour_sum(a, v).collect()}
    assert got.keys() == plain.keys() and "lost" not in got and all(np.allclose(got[k], plain[k]) for k in got)
    parts = S.cell_sums(a, v, 2, cells)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in parts          # an arc carries no vector


def test_grid_is_bounded():
    assert S.grid(100, 10) == (4, 4)
    sources, targets = S.grid(2_100_000, 161)
    assert 2_100_000 * 161 / sources <= S.CELL_NUMBERS and sources * targets >= S.CELLS


def test_null_node_has_no_vector(spark):
    nodes, edges = graph(spark, 5, [(0, 1), (1, 2), (2, 3), (0, 3)])
    found = S.leading_eigenpairs(nodes.union(spark.createDataFrame([(None,)], "node long")), edges, 2)
    assert sorted(r.node for r in found.vectors.select("node").collect()) == [0, 1, 2, 3, 4]
