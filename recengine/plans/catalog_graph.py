"""Checked queries: graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recengine.operators import gnn as GN
from recengine.operators import graph as G
from recengine.operators import spectral as SP
from recengine.operators import stats
from recengine.operators import triangles as TR
from recengine.plans import fixtures
from recengine.plans import sqlparts as q
from recengine.plans.catalog import register
from recengine.session import cut_lineage, written
from recengine.sources.tables import load

WIDTH = 64
M5_TOL = 0.01


def purchase_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Customers, parts and suppliers as nodes, an edge between any two that
    meet on an order line.  The rows of the edge list are three per order line, so no order is
    cut and no pairs of a group are formed; suppliers are hubs."""
    log = fixtures.purchases(spark, sf, ["l_suppkey"])
    kinds = [("user_id", 0), ("item_id", 1), ("l_suppkey", 2)]
    node = {c: (F.col(c) * 3 + k) for c, k in kinds}
    pair = lambda a, b: F.struct(node[a].alias("a"), node[b].alias("b"))
    pairs = log.select(F.explode(F.array(pair("user_id", "item_id"), pair("item_id", "l_suppkey"),
                                         pair("user_id", "l_suppkey"))).alias("p"))
    nodes = None
    for table, key, kind in (("customer", "c_custkey", 0), ("part", "p_partkey", 1), ("supplier", "s_suppkey", 2)):
        own = load(spark, sf, table, [key]).select((F.col(key) * 3 + kind).alias("node"))
        nodes = own if nodes is None else nodes.union(own)
    return nodes, G.undirected(pairs.select("p.a", "p.b"), "a", "b")


PURCHASE_GRAPH_SQL = """lines AS (SELECT o_custkey * 3 AS u, l_partkey * 3 + 1 AS p, l_suppkey * 3 + 2 AS s
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  edges AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (
    SELECT u AS a, p AS b FROM lines UNION ALL SELECT p, s FROM lines UNION ALL SELECT u, s FROM lines)),
  nodes AS (SELECT c_custkey * 3 AS node FROM customer UNION ALL SELECT p_partkey * 3 + 1 FROM part
            UNION ALL SELECT s_suppkey * 3 + 2 FROM supplier),
  arcs AS (SELECT src AS node, dst AS nbr FROM edges UNION ALL SELECT dst, src FROM edges),
  deg AS (SELECT n.node, count(a.nbr) AS degree FROM nodes n LEFT JOIN arcs a USING (node) GROUP BY n.node)"""

BIPARTITE_SQL = f"""inter AS ({q.INTERACTIONS}),
  off AS (SELECT max(user_id) + 1 AS o FROM inter),
  edges AS (SELECT DISTINCT least(user_id, item_id + o) AS src, greatest(user_id, item_id + o) AS dst
            FROM inter, off WHERE rating > 0),
  nodes AS (SELECT user_id AS node FROM inter UNION SELECT item_id + o FROM inter, off),
  arcs AS (SELECT src AS node, dst AS nbr FROM edges UNION ALL SELECT dst, src FROM edges),
  deg AS (SELECT n.node, count(a.nbr) AS degree FROM nodes n LEFT JOIN arcs a USING (node) GROUP BY n.node)"""


def bipartite(spark, sf):
    inter = fixtures.interactions(spark, sf).withColumn("label", (F.col("rating") > 0).cast("int"))
    return G.bipartite_graph(inter)


@register("M1_bipartite_graph", f"WITH {BIPARTITE_SQL} SELECT src, dst FROM edges")
def m1(spark, sf):
    return bipartite(spark, sf)[1]


@register("M2_graph_counts", f"""WITH {BIPARTITE_SQL}
SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges""")
def m2(spark, sf):
    return G.graph_counts(*bipartite(spark, sf))


@register("M3_degree_capped", f"WITH {BIPARTITE_SQL} SELECT node, least(degree, 100) AS degree FROM deg")
def m3(spark, sf):
    return G.degrees(*bipartite(spark, sf), cap=100)


@register("M3_degree_histogram", f"""WITH {BIPARTITE_SQL},
  mm AS (SELECT CAST(min(degree) AS DOUBLE) AS lo, CAST(max(degree) AS DOUBLE) AS hi FROM deg),
  b AS (SELECT CAST(CASE WHEN (hi - lo) / 50 = 0 THEN 0 ELSE least(floor((degree - lo) / ((hi - lo) / 50)), 49) END AS BIGINT) AS bin
        FROM deg, mm),
  c AS (SELECT bin, count(*) AS count FROM b GROUP BY bin)
SELECT r.range AS bin, round(lo + r.range * ((hi - lo) / 50), 6) AS lo, round(lo + (r.range + 1) * ((hi - lo) / 50), 6) AS hi,
       coalesce(c.count, 0) AS count
FROM range(50) r CROSS JOIN mm LEFT JOIN c ON c.bin = r.range""")
def m3_hist(spark, sf):
    return stats.histogram(G.degrees(*bipartite(spark, sf)), "degree", 50)


_TRI_SQL = f"""{PURCHASE_GRAPH_SQL},
  tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON y.src = x.dst
          JOIN edges z ON z.src = x.src AND z.dst = y.dst)"""


@register("E11_triangles", f"WITH {_TRI_SQL} SELECT a, b, c FROM tri")
def e11(spark, sf):
    return TR.triangles(*purchase_graph(spark, sf))


@register("M4_average_clustering", f"""WITH {_TRI_SQL},
  per AS (SELECT node, count(*) AS triangles FROM (SELECT a AS node FROM tri UNION ALL SELECT b FROM tri
          UNION ALL SELECT c FROM tri) GROUP BY node),
  cl AS (SELECT d.node, d.degree, coalesce(p.triangles, 0) AS triangles,
                CASE WHEN d.degree < 2 THEN 0.0 ELSE 2.0 * coalesce(p.triangles, 0) / (d.degree * (d.degree - 1)) END AS c
         FROM deg d LEFT JOIN per p USING (node))
SELECT round(avg(c), 6) AS average_clustering, CAST(sum(triangles) AS BIGINT) AS triangle_corners FROM cl""")
def m4(spark, sf):
    return TR.average_clustering(*purchase_graph(spark, sf))


def _features(spark, sf):
    """M1's graph with M11's features: text vectors for items, zeros for users."""
    inter = written(fixtures.interactions(spark, sf), "interactions")
    nodes, edges = G.bipartite_graph(inter.withColumn("label", (F.col("rating") > 0).cast("int")))
    offset = inter.select(F.max("user_id") + 1).scalar()
    emb = load(spark, sf, "embeddings", ["vec_id", "embedding"]).select((F.col("vec_id") + offset).alias("node"), "embedding")
    return nodes, edges, G.node_features(nodes, emb, "node", "embedding", WIDTH)


def _rounded(vectors, digits=6):
    return vectors.select("node", F.posexplode("vec").alias("dim", "value")).select(
        "node", F.col("dim").cast("int").alias("dim"), (F.round("value", digits) + 0.0).alias("value"))


_LONG_SQL = f"""{BIPARTITE_SQL},
  feats AS (SELECT n.node, coalesce(e.embedding, list_transform(range({WIDTH}), lambda i: CAST(0.0 AS FLOAT))) AS vec
            FROM nodes n LEFT JOIN (SELECT vec_id + o AS node, embedding FROM embeddings, off) e ON e.node = n.node),
  lng AS (SELECT node, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS dim, CAST(unnest(vec) AS DOUBLE) AS value FROM feats),
  pdeg AS (SELECT node, count(*) AS d FROM arcs GROUP BY node)"""


@register("M11_node_features", f"""WITH {_LONG_SQL}
SELECT node, CAST(len(vec) AS INTEGER) AS width, round(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE))), 3) AS total
FROM feats""")
def m11(spark, sf):
    return _features(spark, sf)[2].select("node", F.size("vec").alias("width"),
                                          F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@register("M6_neu_enhancement", f"""WITH {_LONG_SQL},
  nrm AS (SELECT node, sqrt(sum(value * value)) AS n FROM lng GROUP BY node),
  r AS (SELECT l.node, l.dim, CASE WHEN n.n > 0 THEN l.value / n.n ELSE l.value END AS value FROM lng l JOIN nrm n USING (node)),
  ar AS (SELECT a.node, r.dim, sum(r.value) / any_value(p.d) AS value FROM arcs a JOIN r ON r.node = a.nbr
         JOIN pdeg p ON p.node = a.node GROUP BY a.node, r.dim),
  aar AS (SELECT a.node, ar.dim, sum(ar.value) / any_value(p.d) AS value FROM arcs a JOIN ar ON ar.node = a.nbr
          JOIN pdeg p ON p.node = a.node GROUP BY a.node, ar.dim)
SELECT r.node, r.dim, round(r.value + 0.5 * coalesce(ar.value, 0.0) + 0.25 * coalesce(aar.value, 0.0), 6) + 0.0 AS value
FROM r LEFT JOIN ar USING (node, dim) LEFT JOIN aar USING (node, dim)""")
def m6(spark, sf):
    nodes, edges, feats = _features(spark, sf)
    return _rounded(G.neu_arrays(feats, edges, 0.5, 0.25, 1, "vec"))


# ---- M7-M9: given weights, by one formula on both sides
def _given(rows: int, cols: int, salt: int):
    import numpy as np
    return ((np.arange(rows)[:, None] * 31 + np.arange(cols) * 17 + salt * 7) % 13 - 6) / 32.0


def _given_sql(row: str, col: str, salt: int) -> str:
    return f"((({row}) * 31 + ({col}) * 17 + {salt * 7}) % 13 - 6) / 32.0"


HEADS, OUT = 3, 8


def _layers():
    """A concatenating layer with projected skip, and an averaging one (its skip adds the input to every head)."""
    first = GN.Attention(_given(WIDTH, HEADS * OUT, 1), 8 * _given(HEADS, OUT, 2), 8 * _given(HEADS, OUT, 3), _given(WIDTH, HEADS * OUT, 4), _given(1, HEADS * OUT, 5)[0])
    wide = HEADS * OUT
    last = GN.Attention(_given(wide, HEADS * wide, 6), 8 * _given(HEADS, wide, 7), 8 * _given(HEADS, wide, 8), "identity", _given(1, wide, 9)[0], concat=False, activation=None)
    return first, last


def _attention_sql(name: str, x: str, out: int, salt: int) -> str:
    """CTEs ``{name}_h`` (node, c, value), ``{name}_att`` (src, dst, head, alpha), ``{name}_mix`` (node, c, value) from features ``x``."""
    return f"""
  {name}_h AS (SELECT l.node, c.range AS c, sum(l.value * {_given_sql('l.dim', 'c.range', salt)}) AS value
        FROM {x} l, range({HEADS * out}) c GROUP BY l.node, c.range),
  {name}_s AS (SELECT node, c // {out} AS head, sum(value * 8 * {_given_sql(f'c // {out}', f'c % {out}', salt + 1)}) AS s_src,
                      sum(value * 8 * {_given_sql(f'c // {out}', f'c % {out}', salt + 2)}) AS s_dst FROM {name}_h GROUP BY ALL),
  {name}_e AS (SELECT a.nbr AS src, a.node AS dst, x.head, CASE WHEN x.s_src + y.s_dst > 0 THEN x.s_src + y.s_dst ELSE (x.s_src + y.s_dst) * 0.2 END AS e
        FROM arcs a JOIN {name}_s x ON x.node = a.nbr JOIN {name}_s y ON y.node = a.node AND y.head = x.head),
  {name}_x AS (SELECT src, dst, head, exp(e - max(e) OVER (PARTITION BY dst, head)) AS x FROM {name}_e),
  {name}_att AS (SELECT src, dst, head, x / sum(x) OVER (PARTITION BY dst, head) AS alpha FROM {name}_x),
  {name}_mix AS (SELECT a.dst AS node, h.c, sum(a.alpha * h.value) AS value FROM {name}_att a JOIN {name}_h h ON h.node = a.src AND h.c // {out} = a.head GROUP BY ALL)"""


_FIRST_SQL = f"""{_LONG_SQL}, {_attention_sql('p', 'lng', OUT, 1)},
  p_skip AS (SELECT l.node, c.range AS c, sum(l.value * {_given_sql('l.dim', 'c.range', 4)}) AS value FROM lng l, range({HEADS * OUT}) c GROUP BY l.node, c.range),
  p_sum AS (SELECT s.node, CAST(s.c AS INTEGER) AS dim, s.value + coalesce(m.value, 0.0) + {_given_sql('0', 's.c', 5)} AS v FROM p_skip s LEFT JOIN p_mix m ON m.node = s.node AND m.c = s.c),
  p_out AS (SELECT node, dim, CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END AS value FROM p_sum)"""


def _arcs(edges):
    return G.both_directions(edges).select(F.col("nbr").alias("src"), F.col("node").alias("dst"))


@register("M7_attention_softmax", f"WITH {_FIRST_SQL} SELECT src, dst, CAST(head AS INTEGER) AS head, round(alpha, 6) AS alpha FROM p_att")
def m7(spark, sf):
    nodes, edges, feats = _features(spark, sf)
    att = GN.attention_coefficients(_arcs(edges), feats, _layers()[0])
    return att.select("src", "dst", F.posexplode("alpha").alias("head", "alpha")).withColumn("alpha", F.round("alpha", 6))


@register("M8_attention_aggregate", f"WITH {_FIRST_SQL} SELECT node, dim, round(value, 6) + 0.0 AS value FROM p_out")
def m8(spark, sf):
    nodes, edges, feats = _features(spark, sf)
    return _rounded(GN.attention_layer(_arcs(edges), feats, _layers()[0]))


@register("M8_attention_two_layers", f"""WITH {_FIRST_SQL}, {_attention_sql('q', 'p_out', HEADS * OUT, 6)},
  heads AS (SELECT o.node, o.dim, sum(coalesce(m.value, 0.0) + o.value) / {HEADS} AS v
            FROM p_out o CROSS JOIN range({HEADS}) h LEFT JOIN q_mix m ON m.node = o.node AND m.c = h.range * {HEADS * OUT} + o.dim GROUP BY o.node, o.dim)
SELECT node, dim, round(v + {_given_sql('0', 'dim', 9)}, 4) + 0.0 AS value FROM heads""")
def m8_two(spark, sf):
    """A concatenating and an averaging layer, as in the published network."""
    nodes, edges, feats = _features(spark, sf)
    arcs = written(_arcs(edges), "arcs")
    first, last = _layers()
    out = GN.attention_layer(arcs, written(GN.attention_layer(arcs, feats, first), "features"), last)
    return _rounded(out, 4)


GCN_WIDE, GCN_OUT = 16, 4


@register("M9_gcn_two_layers", f"""WITH {_LONG_SQL},
  sarcs AS (SELECT node, nbr FROM arcs UNION ALL SELECT node, node FROM nodes),
  sdeg AS (SELECT node, CAST(count(*) AS DOUBLE) AS d FROM sarcs GROUP BY node),
  w AS (SELECT a.node, a.nbr, 1.0 / sqrt(x.d * y.d) AS w FROM sarcs a JOIN sdeg x ON x.node = a.node JOIN sdeg y ON y.node = a.nbr),
  x1 AS (SELECT l.node, c.range AS c, sum(l.value * {_given_sql('l.dim', 'c.range', 1)}) AS value FROM lng l, range({GCN_WIDE}) c GROUP BY l.node, c.range),
  h1 AS (SELECT w.node, x.c, greatest(sum(w.w * x.value) + {_given_sql('0', 'x.c', 2)}, 0.0) AS value FROM w JOIN x1 x ON x.node = w.nbr GROUP BY w.node, x.c),
  x2 AS (SELECT l.node, c.range AS c, sum(l.value * {_given_sql('l.c', 'c.range', 3)}) AS value FROM h1 l, range({GCN_OUT}) c GROUP BY l.node, c.range),
  h2 AS (SELECT w.node, x.c, sum(w.w * x.value) + {_given_sql('0', 'x.c', 4)} AS value FROM w JOIN x2 x ON x.node = w.nbr GROUP BY w.node, x.c),
  z AS (SELECT node, max(value) + ln(sum(exp(value - m))) AS z FROM (SELECT *, max(value) OVER (PARTITION BY node) AS m FROM h2) GROUP BY node)
SELECT node, CAST(c AS INTEGER) AS dim, round(value - z, 6) + 0.0 AS value FROM h2 JOIN z USING (node)""")
def m9(spark, sf):
    """Two layers with weights and biases: ReLU, then log-softmax."""
    nodes, edges, feats = _features(spark, sf)
    arcs = written(G.both_directions(edges), "arcs")
    h = GN.convolution_layer(arcs, feats, _given(WIDTH, GCN_WIDE, 1), _given(1, GCN_WIDE, 2)[0], "relu")
    return _rounded(GN.convolution_layer(arcs, h, _given(GCN_WIDE, GCN_OUT, 3), _given(1, GCN_OUT, 4)[0], "log_softmax"))


@register("M10_inherited_labels", """
WITH arcs AS (SELECT DISTINCT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, l_orderkey AS ord FROM lineitem),
  lab AS (SELECT 'order:' || o_orderkey AS node, o_orderstatus AS label FROM orders),
  citers AS (SELECT node, label FROM lab WHERE node IN (SELECT src FROM arcs)),
  cited AS (SELECT a.dst AS node, arg_min(l.label, a.ord) AS label FROM arcs a JOIN lab l ON l.node = a.src GROUP BY a.dst)
SELECT node, label, 'citer' AS role FROM citers
UNION ALL SELECT node, label, 'cited' FROM cited WHERE node NOT IN (SELECT node FROM citers)""")
def m10(spark, sf):
    li = load(spark, sf, "lineitem", ["l_orderkey", "l_partkey"])
    arcs = li.select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("src"),
                     F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dst"),
                     F.col("l_orderkey").alias("ord")).distinct()
    lab = load(spark, sf, "orders", ["o_orderkey", "o_orderstatus"]).select(
        F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("node"), F.col("o_orderstatus").alias("label"))
    return G.inherit_labels(arcs, lab, order="ord")


@register("M12_edge_split_labels", f"""
WITH inter AS ({q.INTERACTIONS}), {q.latest_per_user('inter')},
  train AS (SELECT * FROM inter i WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.user_id = i.user_id AND l.item_id = i.item_id)),
  {q.negatives('inter', 4, 42, 'train', 'ntr')}, {q.negatives('inter', 50, 42, 'test', 'nte')},
  {q.lists('train', 'ntr', 'tr_lists')}, {q.lists('latest', 'nte', 'te_lists')},
  e AS (SELECT 'train' AS split, * FROM tr_lists UNION ALL SELECT 'test', * FROM te_lists)
SELECT split, label, count(*) AS n_edges, CAST(sum(user_id) AS BIGINT) AS sum_src, CAST(sum(item_id) AS BIGINT) AS sum_dst FROM e GROUP BY split, label""")
def m12(spark, sf):
    """The labelled edges of both ranges, each selected by its split."""
    from recengine.operators import negatives, splits
    inter = written(fixtures.interactions(spark, sf), "interactions")
    split = splits.leave_one_out(inter)
    negs = negatives.train_test_negatives(inter, 4, 50, 42)
    lists = None
    for name in ("train", "test"):
        own = negatives.labelled_lists(split.where(F.col("split") == name), negs.where(F.col("split") == name)).withColumn("split", F.lit(name))
        lists = own if lists is None else lists.unionByName(own)
    edges = written(G.edge_split(lists), "edges")
    ranges = [G.edge_range(edges, name).groupBy(F.lit(name).alias("split"), "label").agg(
        F.count(F.lit(1)).alias("n_edges"), F.sum("src").alias("sum_src"), F.sum("dst").alias("sum_dst")) for name in ("train", "test")]
    return ranges[0].unionByName(ranges[1])


@register("M5_spectral_embedding_check", f"""WITH {BIPARTITE_SQL}
SELECT count(*) AS n_nodes, CAST(129 AS BIGINT) AS width, true AS converged, true AS orthonormal, true AS descending,
       true AS leading_is_two, true AS scaled_by_roots FROM nodes""")
def m5(spark, sf):
    """128 + 1 leading eigenpairs of M1's graph.  Residuals and the Gram matrix are computed anew from the vectors; the largest
    eigenvalue of a bipartite graph is 2; an embedded column's squares sum to its eigenvalue."""
    nodes, edges = bipartite(spark, sf)
    nodes, edges = cut_lineage(nodes), cut_lineage(edges)
    found = SP.leading_eigenpairs(nodes, edges, 129, tol=M5_TOL)
    residual, error = SP.largest_residual(found, nodes, edges)
    emb = SP.scaled(found)
    squares = emb.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.sum(F.col("x") * F.col("x")).alias("s"))
    values = F.array(*[F.lit(float(v)) for v in found.values])
    return emb.agg(F.count(F.lit(1)).alias("n_nodes"), F.max(F.size("vec")).cast("bigint").alias("width")).select(
        "n_nodes", "width", F.lit(residual <= M5_TOL).alias("converged"), F.lit(error < 1e-9).alias("orthonormal"),
        F.lit(bool((found.values[:-1] >= found.values[1:]).all())).alias("descending"), F.lit(abs(found.values[0] - 2) < 1e-9).alias("leading_is_two"),
        squares.select(F.max(F.abs(F.col("s") - F.element_at(values, F.col("dim") + 1))) < 1e-9).scalar().alias("scaled_by_roots"))


@register("M2_edge_preview", f"WITH {BIPARTITE_SQL} SELECT src, dst FROM edges ORDER BY src, dst LIMIT 5")
def m2_preview(spark, sf):
    """M2: the first edges of the graph (a preview: the limit is the feature)."""
    return bipartite(spark, sf)[1].orderBy("src", "dst").limit(5)
