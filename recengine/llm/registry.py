"""Queries of this subpackage: ``name -> f(spark, sf_dir)`` and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a query and, when SQL can express it, its oracle."""
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> tuple[dict[str, QueryFn], dict[str, str]]:
    import corpus_pipeline
    from recengine.llm import queries  # noqa: F401  (fills the registry)
    return QUERIES | {"pipeline": corpus_pipeline.run}, dict(ORACLES)
