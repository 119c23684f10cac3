"""Graph operators on edge and node DataFrames.

Graphs are ``nodes(node)`` and undirected ``edges(src, dst)`` with
``src < dst``.  Vectors are whole arrays, one row per node; message passing
is an equi-join on the edge end plus a sum per node (partial + final
aggregation: a node with a huge degree is pre-summed map-side).  Attention
and convolution layers are in ``gnn``, the spectral embedding in ``spectral``,
triangles and clustering in ``triangles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# ---------------------------------------------------------------- build
def undirected(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """M1: canonical ``(least, greatest)`` edges, self-loops and parallel
    edges collapsed."""
    return (edges.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
            .filter(F.col("src") != F.col("dst")).distinct())


def bipartite_graph(samples: DataFrame, user: str = "user_id", item: str = "item_id",
                    label: str | None = "label") -> tuple[DataFrame, DataFrame]:
    """M1: user-item graph from positive samples; item node = item +
    max(user) + 1 (I5).  Nodes include users and items without edges."""
    offset = samples.select(F.max(user) + 1).scalar()
    pos = samples.filter(F.col(label) == 1) if label else samples
    edges = undirected(pos.select(F.col(user).alias("a"), (F.col(item) + offset).alias("b")), "a", "b")
    nodes = (samples.select(F.col(user).alias("node"))
             .union(samples.select((F.col(item) + offset).alias("node"))).distinct())
    return nodes, edges


def both_directions(edges: DataFrame) -> DataFrame:
    """Each undirected edge as two arcs ``(node, nbr)``."""
    return (edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr"))
            .union(edges.select(F.col("dst").alias("node"), F.col("src").alias("nbr"))))


def degrees(nodes: DataFrame, edges: DataFrame, cap: int | None = None) -> DataFrame:
    """M3: degree of every node (0 for isolated nodes), optionally capped."""
    d = (edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node")
         .agg(F.count(F.lit(1)).alias("degree")))
    out = nodes.select("node").join(d, "node", "left").fillna(0, subset=["degree"])
    if cap is not None:
        out = out.withColumn("degree", F.least(F.col("degree"), F.lit(cap)))
    return out


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """M2: node and edge counts (one row, two scalar subqueries)."""
    return nodes.sparkSession.range(1).select(
        nodes.select(F.count(F.lit(1))).scalar().alias("n_nodes"),
        edges.select(F.count(F.lit(1))).scalar().alias("n_edges"))


# ---------------------------------------------------------------- vectors
def node_features(nodes: DataFrame, vectors: DataFrame, key: str, vec: str, width: int) -> DataFrame:
    """Feature vector per node, zeros where no vector exists."""
    zeros = F.array_repeat(F.lit(0.0), F.lit(width))
    v = vectors.select(F.col(key).alias("node"), F.col(vec).cast("array<double>").alias("__v"))
    return nodes.select("node").join(v, "node", "left").select("node", F.coalesce("__v", zeros).alias("vec"))


def _neighbour_mean_arrays(vec: DataFrame, arcs: DataFrame, name: str, size: tuple[int, int]) -> DataFrame:
    """``(node, array)`` -> ``(node, mean of neighbour arrays)``, summed in the
    cells of a grid (``spectral.cell_sums``), so no vector is sent for an arc; a
    1 behind each vector adds up to the count.  ``size``: about how many vectors, and
    their width."""
    from recengine.operators.spectral import cell_sums, grid
    n, width = size
    counted = vec.select("node", F.concat("__v", F.array(F.lit(1.0))).alias("vec"))
    s = cell_sums(arcs, counted, width + 1, grid(n, width + 1), "__s")
    return s.select("node", F.transform(F.slice("__s", 1, width), lambda x: x / F.element_at("__s", -1)).alias(name))


def neu_arrays(vec: DataFrame, edges: DataFrame, l1: float = 0.5, l2: float = 0.25,
               iterations: int = 1, name: str = "vec") -> DataFrame:
    """M6: Network Embedding Update (published NEU) on ``(node, array)``:
    rows L2-normalised, then ``R + l1 * A R + l2 * A^2 R`` with
    ``A = D^-1 A``; nodes without neighbours keep ``R``.  Vectors of one width stay whole
    arrays (no per-dimension joins); the arcs, ``R`` and ``A R`` are written once since
    more than one step reads them."""
    from recengine.session import written
    arcs = written(both_directions(edges), "arcs")
    r = vec.select("node", F.col(name).cast("array<double>").alias("__v"))
    for _ in range(iterations):
        norm = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda acc, x: acc + x * x))
        # iterative: written, so the plan stays short and survives executor loss
        # the norm as an array, taken once a row: inside a lambda over the vector it would be taken once a number
        norms = F.array_repeat(norm, F.size("__v"))
        r = written(r.withColumn("__v", F.zip_with("__v", norms, lambda x, n: F.when(n > 0, x / n).otherwise(x))), "normalised")
        n, width = r.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("__v")), F.lit(0))).first()
        ar = written(_neighbour_mean_arrays(r, arcs, "__a", (n, width)), "means")
        aar = _neighbour_mean_arrays(ar.withColumnRenamed("__a", "__v"), arcs, "__aa", (n, width))
        zero = F.transform("__v", lambda x: F.lit(0.0))
        r = (r.join(ar, "node", "left").join(aar, "node", "left")
             .select("node", F.zip_with(F.zip_with("__v", F.coalesce("__a", zero), lambda x, y: x + l1 * y),
                                        F.coalesce("__aa", zero), lambda x, y: x + l2 * y).alias("__v")))
    return r.withColumnRenamed("__v", name)


def inherit_labels(arcs: DataFrame, src_label: DataFrame, order: str = "src") -> DataFrame:
    """A cited node takes the label of its first citer (in ``order``);
    citers keep their own.  ``arcs(src, dst)``, ``src_label(node, label)``."""
    lab = arcs.join(src_label.select(F.col("node").alias("src"), "label"), "src")
    cited = lab.groupBy(F.col("dst").alias("node")).agg(F.min_by("label", F.col(order)).alias("label"))
    citers = src_label.join(arcs.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    return citers.select("node", "label", F.lit("citer").alias("role")).unionByName(
        cited.join(citers.select("node"), "node", "left_anti").select("node", "label", F.lit("cited").alias("role")))


def edge_split(samples: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Edges with their label and split, for train/test range selection."""
    return samples.select(F.col("user_id").alias("src"), F.col("item_id").alias("dst"),
                          F.col(label).alias("label"), F.col(split).alias("split"))


def edge_range(edges: DataFrame, split: str) -> DataFrame:
    """The labelled edges of one split, ``(src, dst, label)``."""
    return edges.where(F.col("split") == split).select("src", "dst", "label")
