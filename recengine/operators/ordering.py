"""Skew-safe exact row numbers and dense indexes.

``row_number()`` over a window without ``partitionBy`` runs in one task, and a
window partitioned by a hot key (one user holding a third of all rows) does
too.  Here the rows are range-partitioned on ``(group..., order...)`` so a hot
group is spread over many tasks; each task numbers its slice locally and the
per-(group, partition) counts -- a table of at most
``#groups + #partitions`` rows -- give every slice its offset.  There is one
path for any size.

The local numbering depends on the physical partition of each row, so the
numbered rows are written once (to the shared folder): both the count branch
and the row branch then read the same numbers, whatever AQE does afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recengine.session import written

_LOW_BITS = (1 << 33) - 1


def _as_cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str | Column],
           rank_col: str = "rank", size_col: str | None = None,
           num_partitions: int | None = None) -> DataFrame:
    """Append ``rank_col`` = 1-based ``row_number()`` within ``by`` ordered by
    ``order`` (which must be a total order inside each group), and optionally
    ``size_col`` = group size.  Exact and deterministic; null is a group."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by] + _as_cols(order)
    # the range partitioner samples its input in a job of its own: hold the
    # input so it is computed once, not once for sampling and once to shuffle
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tagged = written(src.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                         .withColumn("__mid", F.monotonically_increasing_id()), "ranked")
    finally:
        src.unpersist()
    tagged = (tagged.withColumn("__pid", F.shiftright(F.col("__mid"), 33))
              .withColumn("__loc", F.col("__mid").bitwiseAND(F.lit(_LOW_BITS))))
    slices = (tagged.groupBy(*by, "__pid")
              .agg(F.count(F.lit(1)).alias("__cnt"), F.min("__loc").alias("__first")))
    # Per group, the slices are few (one per partition the group spans), so
    # this window is bounded by the partition count even for a hot group.
    wg = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    slices = slices.withColumn(
        "__off", F.coalesce(F.sum("__cnt").over(
            wg.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if size_col:
        slices = slices.withColumn(size_col, F.sum("__cnt").over(wg))
    # null-safe, so that rows of a null group keep their slice
    keep = [F.col("__pid").alias("__spid"), *[F.col(c).alias(f"__s{k}") for k, c in enumerate(by)], "__off", "__first"]
    slices = slices.select(*keep, *([size_col] if size_col else []))
    same = F.col("__pid") == F.col("__spid")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__s{k}"))
    out = tagged.join(slices, same).drop("__spid", *[f"__s{k}" for k in range(len(by))])
    out = out.withColumn(rank_col, (F.col("__off") + F.col("__loc") - F.col("__first") + 1).cast("bigint"))
    return out.drop("__mid", "__pid", "__loc", "__off", "__first")


def dense_index(df: DataFrame, order: Sequence[str | Column], idx_col: str = "idx",
                num_partitions: int | None = None) -> DataFrame:
    """0-based dense index by ``order`` (a total order), by ``ranked``."""
    out = ranked(df, [], order, rank_col="__rk", num_partitions=num_partitions)
    return out.withColumn(idx_col, F.col("__rk") - 1).drop("__rk")
