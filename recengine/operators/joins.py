"""Joins.

Equi-joins only; Spark/AQE choose broadcast vs sort-merge from measured
sizes (``autoBroadcastJoinThreshold`` at plan time, converted again at run
time from shuffle statistics), and AQE splits skewed partitions.  Explicit
``broadcast`` hints are used only for tables whose size is bounded by
construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_with_default(df: DataFrame, other: DataFrame, on: Sequence[str], defaults: dict) -> DataFrame:
    """Left join, missing values replaced by per-column defaults."""
    j = df.join(other, list(on), "left")
    for c, v in defaults.items():
        j = j.withColumn(c, F.coalesce(F.col(c), F.lit(v) if not isinstance(v, Column) else v))
    return j


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key qualifies (``isin`` without collecting ids)."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def anti(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with no partner (set difference by key)."""
    return df.join(other.select(*on), list(on), "left_anti")


def last_writer_map(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """Many-to-one map where the last row in input order wins
    (``max_by``, partial aggregate)."""
    return df.groupBy(key).agg(F.max_by(F.col(value), F.struct(*[F.col(o) for o in order])).alias(value))


def lift_to_edges(edges: DataFrame, nodes: DataFrame, node: str, cols: Sequence[str],
                  src: str = "src", dst: str = "dst") -> DataFrame:
    """Attach node values to both ends of every edge (two equi-joins)."""
    s = nodes.select(F.col(node).alias(src), *[F.col(c).alias(f"{c}_src") for c in cols])
    d = nodes.select(F.col(node).alias(dst), *[F.col(c).alias(f"{c}_dst") for c in cols])
    return edges.join(s, src, "left").join(d, dst, "left")


def pair_vectors(pairs: DataFrame, vectors: DataFrame, key: str, vec: str, width: int,
                 user: str = "user_id", item: str = "item_id", item_offset: Column | int = 0) -> DataFrame:
    """``concat(user_vec, item_vec)`` for (user, item) pairs, looked up
    by key (items at ``item + item_offset``), zeros when missing -- never by
    row position."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.lit(width))
    u = vectors.select(F.col(key).alias(user), F.col(vec).alias("__u"))
    i = vectors.select(F.col(key).alias("__ik"), F.col(vec).alias("__i"))
    off = F.lit(item_offset) if isinstance(item_offset, int) else item_offset
    j = (pairs.join(u, user, "left")
         .withColumn("__ik", F.col(item) + off)
         .join(i, "__ik", "left"))
    return j.withColumn("pair_vec", F.concat(F.coalesce("__u", zeros), F.coalesce("__i", zeros))) \
            .drop("__u", "__i", "__ik")


def union_all(*dfs: DataFrame) -> DataFrame:
    """H1: union all by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def union_roles(df: DataFrame, a: str, b: str, label_a: str, label_b: str, out: str = "id") -> DataFrame:
    """H3: one id column from two roles (e.g. paper as source / as reference)."""
    return (df.select(F.col(a).alias(out), F.lit(label_a).alias("role"))
            .unionByName(df.select(F.col(b).alias(out), F.lit(label_b).alias("role"))))
