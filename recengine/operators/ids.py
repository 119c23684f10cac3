"""Identifier encoding.

Dictionaries are tables ``(key, idx)`` built with the distributed
``dense_index`` and applied with joins -- never a driver-side dict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recengine.operators.ordering import dense_index


def index_by_value(df: DataFrame, key: str, idx_col: str = "idx") -> DataFrame:
    """Dense ids ``0..n-1`` by sorted key value (LabelEncoder order)."""
    return dense_index(df.select(key).distinct().filter(F.col(key).isNotNull()), [key], idx_col)


def index_by_first_appearance(df: DataFrame, key: str, order: Sequence[str | Column],
                              idx_col: str = "idx") -> DataFrame:
    """Dense ids by first appearance; ``order`` is the input order
    (a total order of the rows).  ``min(struct(order))`` per key is a partial
    aggregate, so a hot key never lands whole in one task."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    first = df.groupBy(key).agg(F.min(F.struct(*cols)).alias("_first"))
    return dense_index(first, ["_first", key], idx_col).select(key, idx_col)


def apply_mapping(df: DataFrame, mapping: DataFrame, key: str, idx_col: str = "idx",
                  out_col: str | None = None, mode: str = "error", unknown: int = -1) -> DataFrame:
    """Replace ``key`` by its index.

    ``mode='error'``: a key missing from the mapping fails the job
    (``assert_true``), like a strict dict lookup; ``'drop'``: rows with an
    unknown key are skipped (soft lookup, inner join); ``'unknown'``: they get
    ``unknown``.
    """
    out_col = out_col or key
    m = mapping.select(F.col(key).alias("_k"), F.col(idx_col).alias("_v"))
    if mode == "drop":
        j = df.join(m, df[key] == m["_k"], "inner")
        return j.withColumn(out_col, F.col("_v")).drop("_k", "_v")
    j = df.join(m, df[key] == m["_k"], "left")
    if mode == "error":
        v = F.when(F.assert_true(F.col("_v").isNotNull() | F.col(key).isNull(),
                                 F.lit(f"key not in mapping: {key}")).isNull(), F.col("_v"))
    elif mode == "unknown":
        v = F.coalesce(F.col("_v"), F.lit(unknown).cast(m.schema["_v"].dataType))
    else:
        raise ValueError(f"mode must be error/drop/unknown, got {mode!r}")
    return j.withColumn(out_col, v).drop("_k", "_v")


def binarise(col: str | Column) -> Column:
    """B2: ``float(x > 0)``."""
    c = F.col(col) if isinstance(col, str) else col
    return (c > 0).cast("double")


def field_offsets(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """I4: field sizes ``max+1`` and offsets = exclusive cumulative sum,
    one row per field (a tiny table: one aggregate pass)."""
    agg = df.agg(*[(F.max(f) + 1).cast("bigint").alias(f) for f in fields]).first()
    rows, off = [], 0
    for f in fields:
        rows.append((f, int(agg[f]), off))
        off += int(agg[f])
    return df.sparkSession.createDataFrame(rows, "field string, size bigint, offset bigint")


def offset_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """I4 applied: each field plus the total size of the fields before it,
    computed in-plan as scalar subqueries (one global aggregate each)."""
    out = df
    off = F.lit(0).cast("bigint")
    for f in fields:
        out = out.withColumn(f, F.col(f) + off)
        off = off + df.select((F.max(f) + 1).cast("bigint")).scalar()
    return out


def bipartite_item_node(df: DataFrame, user: str = "user_id", item: str = "item_id",
                        node_col: str = "item_node") -> DataFrame:
    """Item node id = item + max(user) + 1 (a scalar subquery)."""
    return df.withColumn(node_col, F.col(item) + df.select(F.max(user) + 1).scalar())
