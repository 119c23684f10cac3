"""Domain tables built from the driver tables (see FIXTURES.md §3).

customer = user, part = item, brand = course, part = resource of its brand.
Everything here is a lazy plan over the whole tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recengine.functions.text import json_int
from recengine.session import scratch_path
from recengine.sources.files import read_delimited, read_whitespace, write_delimited, write_whitespace
from recengine.sources.positions import with_input_pos
from recengine.sources.tables import load


def purchases(spark: SparkSession, sf_dir: str, more: Sequence[str] = ()) -> DataFrame:
    """Activity log with repeats: one row per line item.

    ``(user_id, item_id, ts, order_id, line_no, quantity)`` and the line's
    columns named in ``more``; the natural input order is ``(ts, order_id, line_no)``.
    """
    li = load(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", *more])
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
                    F.col("o_orderdate").alias("ts"), F.col("l_orderkey").alias("order_id"),
                    F.col("l_linenumber").alias("line_no"), F.col("l_quantity").alias("quantity"), *more))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (user, item): ``rating = max(quantity)/10``, ``ts = max(date)``."""
    return (purchases(spark, sf_dir).groupBy("user_id", "item_id")
            .agg((F.max("quantity") / 10.0).alias("rating"), F.max("ts").alias("ts")))


def purchase_log(spark: SparkSession, sf_dir: str, kind: str = "parquet") -> DataFrame:
    """The activity log as files in the order (order_id, line_no, item_id), scanned
    with ``input_pos``; ``kind``: 'parquet' or 'csv'.  The days are coarse, so
    a user's latest rows are tied."""
    log = purchases(spark, sf_dir).select("user_id", "item_id", F.to_date("ts").alias("ts"), "order_id", "line_no").orderBy("order_id", "line_no", "item_id")
    path = scratch_path(spark, "log")
    if kind == "csv":
        write_delimited(log, path, ",", header=True)
        return with_input_pos(read_delimited(spark, path, log.schema, ",", header=True), "text")
    log.write.parquet(path)
    return with_input_pos(spark.read.schema(log.schema).parquet(path), "parquet")


def problem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a problem log ``(user_id, problem, ts)`` in the order
    (value, event_id), which is not that of time, scanned with ``input_pos``."""
    ev = load(spark, sf_dir, "events", ["event_id", "user_id", "props", "ts", "value"])
    log = ev.orderBy("value", "event_id").select("user_id", json_int("props", "k").alias("problem"), "ts")
    path = scratch_path(spark, "problems")
    log.write.parquet(path)
    return with_input_pos(spark.read.schema(log.schema).parquet(path), "parquet")


def exercise_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(exercise, problem)`` lines: part and part modulo 97, in the order
    of part names, so that a problem has many exercises; with ``input_pos``."""
    part = load(spark, sf_dir, "part", ["p_partkey", "p_name"])
    path = scratch_path(spark, "exercises")
    write_whitespace(part.orderBy("p_name", "p_partkey").select("p_partkey", F.col("p_partkey") % 97), path)
    return read_whitespace(spark, path, ["exercise", "problem"], ["bigint", "bigint"], pos="input_pos")


INTERACTIONS_SQL = """
  SELECT o_custkey AS user_id, l_partkey AS item_id,
         max(l_quantity) / 10.0 AS rating, max(o_orderdate) AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY o_custkey, l_partkey"""

PURCHASES_SQL = """
  SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS ts,
         l_orderkey AS order_id, l_linenumber AS line_no, l_quantity AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
