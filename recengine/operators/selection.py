"""Exact order statistics by histogram selection: no sort, no rank of every row.

The wanted ranks of a group start with the group's smallest and largest value.  A round counts the rows of
every open interval in ``BINS`` bins of equal width, finds the bin that holds the wanted rank and goes on with that bin's own
smallest and largest value.  The ends of an interval fall into different bins, so each round narrows it; a rank is found
when they are equal.  A round is one pass with partial aggregates, so neither a hot group nor the whole table meets in a
task; the tables between rounds have one row per group and rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recengine.session import discard, written

BINS = 1024


def _bin(kind: T.DataType) -> Column:
    """Bin of ``__x`` in [__lo, __hi]: monotone, 0 for __lo, never 0 for __hi."""
    if isinstance(kind, T.LongType):
        return F.floor((F.col("__x") - F.col("__lo")) / F.greatest(F.ceil((F.col("__hi") - F.col("__lo") + 1) / F.lit(BINS)), F.lit(1)))
    return F.least(F.floor((F.col("__x") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * BINS), F.lit(BINS - 1))


def order_statistics(df: DataFrame, value: str | Column, ranks: dict[str, Column], group: Sequence[str] = ()) -> DataFrame:
    """One row per group (one in all without ``group``, none for no rows): for each name of ``ranks`` (1-based ranks, an expression
    of the group's row count ``n``) ``<name>``, the value at that rank in ascending order, and ``<name>_at``, the rank's place among
    the rows equal to it; and ``n``.  Nulls are left out; integers of up to 62 bits are exact, other numbers go as
    doubles (finite).  Ranks beyond [1, n] are clipped.  A null group is a group."""
    g = list(group)
    x = F.col(value) if isinstance(value, str) else value
    kind = df.select(x.alias("__x")).schema["__x"].dataType
    whole = isinstance(kind, T.IntegralType)
    kind = T.LongType() if whole else T.DoubleType()
    rows = written(df.select(*g, x.cast(kind).alias("__x")).where(F.col("__x").isNotNull()), "values")
    base = rows.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    wanted = F.array(*[F.struct(F.lit(name).alias("which"), F.greatest(F.least(r.cast("long"), F.col("n")), F.lit(1).cast("long")).alias("r"))
                       for name, r in ranks.items()])
    state = written(base.where("n > 0").select(*g, "n", "__lo", "__hi", F.explode(wanted).alias("w")).select(
        *g, "n", F.col("w.which").alias("which"), F.col("w.r").alias("r"), "__lo", "__hi"), "ranks")
    by = [F.col(c).alias(f"__g{k}") for k, c in enumerate(g)]
    cells = [f"__g{k}" for k in range(len(g))]
    while state.where("__lo < __hi").limit(1).count():
        open_ = state.where("__lo < __hi").select(*by, "which", "n", "r", "__lo", "__hi")
        inside = (F.col("__x") >= F.col("__lo")) & (F.col("__x") <= F.col("__hi"))
        for c, cell in zip(g, cells):
            inside = inside & F.col(c).eqNullSafe(F.col(cell))
        # without a group the other side is one row per wanted rank
        met = rows.join(open_ if g else F.broadcast(open_), inside)
        counts = (met.withColumn("__bin", _bin(kind)).groupBy(*cells, "which", "n", "r", "__bin")
                  .agg(F.count(F.lit(1)).alias("__c"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi")))
        before = Window.partitionBy(*cells, "which").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0)))
        narrowed = counts.where((F.col("__before") < F.col("r")) & (F.col("r") <= F.col("__before") + F.col("__c"))).select(
            *[F.col(cell).alias(c) for c, cell in zip(g, cells)], "n", "which", (F.col("r") - F.col("__before")).alias("r"), "__lo", "__hi")
        after = written(state.where("__lo >= __hi").unionByName(narrowed), "ranks")
        discard(state)
        state = after
    found = state.groupBy(*g).agg(F.first("n").alias("n"), *[c for name in ranks for c in (
        F.max(F.when(F.col("which") == name, F.col("__lo"))).alias(name), F.max(F.when(F.col("which") == name, F.col("r"))).alias(f"{name}_at"))])
    return found.where("n is not null")
