"""Aggregations and descriptive statistics.

Everything is a ``groupBy``/``agg`` (partial + final phases, so a hot key is
pre-combined map-side) or a scalar subquery; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recengine.operators.ordering import dense_index
from recengine.operators.selection import order_statistics


def group_count(df: DataFrame, key: str, col: str, name: str = "n") -> DataFrame:
    """non-null ``col`` values per ``key``."""
    return df.groupBy(key).agg(F.count(col).alias(name))


def keep_groups_by_count(df: DataFrame, key: str, col: str, lo: int, hi: int) -> DataFrame:
    """rows whose ``key`` has a count of ``col`` in ``[lo, hi]`` (inclusive);
    a semi-join against the qualifying keys, never a collected id list."""
    ok = group_count(df, key, col).filter(F.col("n").between(lo, hi)).select(key)
    return df.join(ok, key, "left_semi")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """``(value, count)`` ordered by count desc, then value; null is no
    value."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col(col).asc()))


def summary(df: DataFrame, col: str, group: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """mean, sample std, min, max, median (interpolated), smallest mode.

    Exact, and without an unbounded buffer in one task: the median's two
    middle values by histogram selection (``selection``), the mode from a
    ``groupBy(value)`` count reduced by ``min_by`` (partial aggregates).
    Spark's exact ``median``/``mode`` aggregates would keep every distinct
    value of a group in one buffer.  Rows of a null group are a group."""
    c = F.col(col)
    g = list(group)
    vals = df.select(*g, c.alias("__x")).filter(F.col("__x").isNotNull())
    base = (df.groupBy(*g) if g else df.groupBy()).agg(
        F.round(F.avg(c), digits).alias("mean"), F.round(F.stddev_samp(c), digits).alias("std"),
        F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"))
    middle = order_statistics(vals, "__x", {"lo": F.floor((F.col("n") + 1) / 2), "hi": F.ceil((F.col("n") + 1) / 2)}, g)
    med = middle.select(*g, F.round((F.col("lo").cast("double") + F.col("hi").cast("double")) / 2, digits).alias("median"))
    counts = vals.groupBy(*g, "__x").agg(F.count(F.lit(1)).alias("__c"))
    mode = (counts.groupBy(*g) if g else counts.groupBy()).agg(
        F.min_by(F.col("__x"), F.struct((-F.col("__c")).alias("c"), F.col("__x").alias("x")))
        .cast("double").alias("mode"))
    if g:
        return _join_groups(_join_groups(base, med, g, "median"), mode, g, "mode")
    return base.select("*", med.select("median").scalar().alias("median"),
                       mode.select("mode").scalar().alias("mode"))


def _join_groups(left: DataFrame, right: DataFrame, group: list[str], col: str) -> DataFrame:
    """Left join on the group columns, null equal to null."""
    renamed = right.select(*[F.col(c).alias(f"__j{k}") for k, c in enumerate(group)], col)
    same = F.lit(True)
    for k, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__j{k}"))
    return left.join(renamed, same, "left").drop(*[f"__j{k}" for k in range(len(group))])


def fanout_stats(df: DataFrame, a: str, b: str, relation: str = "") -> DataFrame:
    """for a two-column relation, the F5 summary of "b per a" and of
    "a per b" (count of rows per key, as the pandas ``groupby().count()``).
    Two rows: ``direction`` = ``'a->b'`` and ``'b->a'``."""
    out = None
    for key, other, direction in ((a, b, f"{a}->{b}"), (b, a, f"{b}->{a}")):
        per = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(other).alias("_n"))
        s = summary(per, "_n").select(F.lit(relation).alias("relation"),
                                      F.lit(direction).alias("direction"), "*")
        out = s if out is None else out.unionByName(s)
    return out


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """equal-width bins between min and max; the last bin is closed.
    ``(bin, lo, hi, count)`` for all bins, empty ones included.  min/max are
    scalar subqueries; the bin table has ``bins`` rows."""
    c = F.col(col).cast("double")
    lo = df.select(F.min(c)).scalar()
    hi = df.select(F.max(c)).scalar()
    width = (hi - lo) / bins
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((c - lo) / width), F.lit(bins - 1))).cast("bigint")
    counts = df.filter(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    frame = spark.range(bins).select(F.col("id").alias("bin"))
    return (frame.join(counts, "bin", "left").fillna(0, subset=["count"])
            .select("bin", F.round(lo + F.col("bin") * width, 6).alias("lo"),
                    F.round(lo + (F.col("bin") + 1) * width, 6).alias("hi"), "count"))


def popularity_rank(df: DataFrame, item: str, order: Sequence[str | Column]) -> DataFrame:
    """F8: interactions per item and distinct ranks 1..n by count desc; ties
    keep first-appearance order (``order`` is the input order)."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    c = df.groupBy(item).agg(F.count(F.lit(1)).alias("interactions"),
                             F.min(F.struct(*cols)).alias("_first"))
    r = dense_index(c, [F.col("interactions").desc(), F.col("_first").asc(), F.col(item).asc()], "_idx")
    return r.select(item, "interactions", (F.col("_idx") + 1).alias("popularity_rank"))


def earliest(df: DataFrame, keys: Sequence[str], ts: str = "ts", name: str = "first_ts") -> DataFrame:
    """earliest time per key."""
    return df.groupBy(*keys).agg(F.min(ts).alias(name))


def distinct_with_first(df: DataFrame, key: str, value: str, ts: str, order: Sequence[str]) -> DataFrame:
    """distinct values per key and the time of the key's first row in
    input order (``min_by(ts, order)``)."""
    return df.groupBy(key).agg(F.countDistinct(value).alias(f"n_{value}"),
                               F.min_by(F.col(ts), F.struct(*[F.col(o) for o in order])).alias("first_ts"))


def node_union(a: DataFrame, b: DataFrame, col: str = "node") -> DataFrame:
    """Distinct union of two id columns."""
    return a.select(F.col(a.columns[0]).alias(col)).union(b.select(F.col(b.columns[0]).alias(col))).distinct()


def shape(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """Row count and distinct count per column (``approx`` as a flag)."""
    agg = [F.count(F.lit(1)).alias("rows")]
    for c in cols:
        f = F.countDistinct(c) if exact else F.approx_count_distinct(c)
        agg.append(f.alias(f"distinct_{c}"))
    return df.agg(*agg)
