"""Registry of checked queries: ``name -> f(spark, sf_dir) -> DataFrame`` and
``name -> DuckDB SQL`` over the driver's views.

Names are ``<SURVEY id>_<operator>``.  Every query reads the whole driver
tables (or tables Spark derives from them); computed columns are aliased and
cast identically on both sides, floats rounded to 6 digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a query (and its oracle SQL, when SQL can express it)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> tuple[dict[str, QueryFn], dict[str, str]]:
    # importing the modules fills the registry
    from recengine.plans import (  # noqa: F401
        catalog_flow, catalog_tables, catalog_text, catalog_graph, catalog_models, catalog_files)
    return dict(QUERIES), dict(ORACLES)
