"""Projection, filter and cleaning.

Column expressions only -- they stay inside whole-stage codegen -- plus the
keep-first de-duplication, which is an aggregate (``min_by``), not a window,
so a key holding a third of the rows is still pre-combined map-side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recengine.operators.ordering import dense_index


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def rename(df: DataFrame, mapping: Mapping[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """B1: rename and drop columns."""
    return df.withColumnsRenamed(dict(mapping)).drop(*drop)


def scale(col: str | Column, by: float = 5.0) -> Column:
    """``x / by`` (rating to [0, 1])."""
    return _c(col) / F.lit(float(by))


def id_from_suffix(col: str | Column, sep: str = "_") -> Column:
    """Numeric id after the last ``sep`` (``'user_12' -> 12``); null when
    the suffix is not a number (``try_cast``, ANSI-safe)."""
    return F.element_at(F.split(_c(col), F.lit(sep), -1), -1).try_cast("bigint")


def with_default(col: str | Column, default) -> Column:
    """Missing value -> shared default."""
    return F.coalesce(_c(col), F.lit(default))


def empty_to_null(col: str | Column) -> Column:
    """``''`` -> null."""
    return F.nullif(_c(col), F.lit(""))


def zero_based(col: str | Column) -> Column:
    """1-based -> 0-based ids."""
    return _c(col) - 1


def keep_first(df: DataFrame, subset: Sequence[str], order: Sequence[str]) -> DataFrame:
    """B10 keep-first: one row per ``subset`` key, the first in ``order``
    (an explicit input order -- ``dropDuplicates`` keeps an arbitrary one)."""
    others = [c for c in df.columns if c not in subset]
    key = F.struct(*[F.col(o) for o in order])
    agg = df.groupBy(*subset).agg(F.min_by(F.struct(*others), key).alias("__row"))
    return agg.select(*subset, *[F.col(f"__row.{c}").alias(c) for c in others]).select(*df.columns)


def sample_rows(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """``n`` rows in seeded md5 order of ``key`` -- a distributed top-n
    (TakeOrderedAndProject), reproducible, unlike ``sample``/``rand``."""
    from recengine.functions.hashing import hash_hex
    h = hash_hex(seed, *key)
    return df.withColumn("__h", h).orderBy("__h", *key).limit(n).drop("__h")


def stride(df: DataFrame, order: Sequence[str], step: int = 2, offset: int = 1) -> DataFrame:
    """Every ``step``-th record by a stable index (idx % step == offset)."""
    idx = dense_index(df, list(order), "__i")
    return idx.filter(F.pmod(F.col("__i"), F.lit(step)) == offset).drop("__i")


def index_window(df: DataFrame, order: Sequence[str], start: int, stop: int,
                 idx_col: str = "record") -> DataFrame:
    """B17 core: records ``[start, stop)`` of the stable order, keeping the index."""
    idx = dense_index(df, list(order), idx_col)
    return idx.filter((F.col(idx_col) >= start) & (F.col(idx_col) < stop))
