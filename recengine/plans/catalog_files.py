"""Checked queries: file-format round trips (A1-A10).

Each query writes a whole driver table (or one Spark derives) into a fresh
folder under the session's shared checkpoint folder, reads it back with an
explicit schema, and returns what was read; the oracle is the source table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from recengine.operators import negatives as N
from recengine.operators import splits as S
from recengine.plans import fixtures
from recengine.plans import sqlparts as q
from recengine.plans.catalog import register
from recengine.session import scratch_path, written
from recengine.sources import files as IO
from recengine.sources.tables import SCHEMAS, load


@register("A1_jsonl_roundtrip", "SELECT * FROM part")
def a1(spark, sf):
    p = scratch_path(spark, "a1")
    IO.write_jsonl(load(spark, sf, "part"), p)
    return IO.read_jsonl(spark, p, SCHEMAS["part"])


_PAPER_SCHEMA = ("doc_id BIGINT, lang STRING, n_chars BIGINT, "
                 "labels STRUCT<quality: INT, toxic: INT>, words ARRAY<STRING>")


@register("A2_json_array_roundtrip", """
SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic, CAST(len(string_split(d.source, ' ')) AS INTEGER) AS n_words
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def a2(spark, sf):
    d = load(spark, sf, "documents", ["doc_id", "lang", "n_chars", "source"])
    lab = load(spark, sf, "labels")
    nested = d.join(lab, "doc_id", "left").select(
        "doc_id", "lang", "n_chars",
        F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(),
               F.struct("quality", "toxic")).alias("labels"),
        F.split("source", " ").alias("words"))
    p = scratch_path(spark, "a2")
    IO.write_json_array(nested, p)
    back = IO.read_json_array(spark, p, _PAPER_SCHEMA)
    return back.select("doc_id", "lang", "n_chars", F.col("labels.quality").alias("quality"),
                       F.col("labels.toxic").alias("toxic"), F.size("words").alias("n_words"))


@register("A3_tsv_relation", "SELECT l_suppkey AS supplier, l_partkey AS part FROM lineitem")
def a3(spark, sf):
    rel = load(spark, sf, "lineitem", ["l_suppkey", "l_partkey"])
    p = scratch_path(spark, "a3")
    IO.write_delimited(rel, p, "\t")
    return IO.read_delimited(spark, p, "supplier BIGINT, part BIGINT", "\t")


@register("A4_whitespace_relation", "SELECT p_partkey AS exercise, CAST(p_size AS BIGINT) AS problem FROM part")
def a4(spark, sf):
    p = scratch_path(spark, "a4")
    IO.write_whitespace(load(spark, sf, "part", ["p_partkey", "p_size"]), p)
    return IO.read_whitespace(spark, p, ["exercise", "problem"], ["bigint", "bigint"])


@register("A5_double_colon_latin1", f"""
WITH inter AS ({q.INTERACTIONS})
SELECT user_id, item_id, rating, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp FROM inter""")
def a5(spark, sf):
    inter = fixtures.interactions(spark, sf).select("user_id", "item_id", "rating",
                                                    F.unix_timestamp("ts").alias("timestamp"))
    p = scratch_path(spark, "a5")
    IO.write_delimited(inter, p, "::", encoding="ISO-8859-1")
    return IO.read_delimited(spark, p, "user_id BIGINT, item_id BIGINT, rating DOUBLE, timestamp BIGINT", "::",
                             encoding="ISO-8859-1")


@register("A6_pipe_positional", "SELECT c_custkey AS user_id, c_nationkey AS occupation, c_mktsegment AS zip_code FROM customer")
def a6(spark, sf):
    c = load(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    p = scratch_path(spark, "a6")
    IO.write_delimited(c, p, "|")
    return IO.read_delimited(spark, p, "user_id BIGINT, occupation INT, zip_code STRING", "|")


@register("A7_header_csv", "SELECT user_id AS userId, event_id AS movieId, value AS rating, event_type FROM events")
def a7(spark, sf):
    e = load(spark, sf, "events", ["user_id", "event_id", "value", "event_type"]).select(
        F.col("user_id").alias("userId"), F.col("event_id").alias("movieId"), F.col("value").alias("rating"), "event_type")
    p = scratch_path(spark, "a7")
    IO.write_delimited(e, p, ",", header=True)
    return IO.read_delimited(spark, p, "userId BIGINT, movieId BIGINT, rating DOUBLE, event_type STRING", ",", header=True)


@register("A8_parquet_roundtrip", f"""
WITH inter AS ({q.INTERACTIONS}) SELECT user_id, item_id, rating FROM inter""")
def a8(spark, sf):
    p = scratch_path(spark, "a8")
    IO.write_parquet(fixtures.interactions(spark, sf).select("user_id", "item_id", "rating"), p)
    return IO.read_parquet(spark, p, "user_id BIGINT, item_id BIGINT, rating DOUBLE")


@register("A9_samples_partitioned", f"""
WITH inter AS ({q.INTERACTIONS}), {q.latest_per_user('inter')},
  train AS (SELECT * FROM inter i WHERE NOT EXISTS
            (SELECT 1 FROM latest l WHERE l.user_id = i.user_id AND l.item_id = i.item_id)),
  {q.negatives('inter', 4, 42, 'train', 'ntr')},
  {q.negatives('inter', 50, 42, 'test', 'nte')},
  {q.lists('train', 'ntr', 'tr_lists')},
  {q.lists('latest', 'nte', 'te_lists')},
  s AS (SELECT 'train' AS split, * FROM tr_lists UNION ALL SELECT 'test', * FROM te_lists)
SELECT split, label, count(*) AS n FROM s GROUP BY split, label""")
def a9(spark, sf):
    inter = written(fixtures.interactions(spark, sf), "interactions")
    split = S.leave_one_out(inter)
    negs = N.train_test_negatives(inter, 4, 50, 42)
    out = None
    for name in ("train", "test"):
        lists = N.labelled_lists(split.filter(F.col("split") == name), negs.filter(F.col("split") == name))
        lists = lists.withColumn("split", F.lit(name))
        out = lists if out is None else out.unionByName(lists)
    back = IO.materialise_samples(out, scratch_path(spark, "a9") + "/samples", overwrite=False, splits=("train", "test"))
    return back.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@register("A10_embedding_roundtrip", """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS width,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 3) AS total FROM embeddings""")
def a10(spark, sf):
    p = scratch_path(spark, "a10")
    IO.write_parquet(load(spark, sf, "embeddings", ["vec_id", "embedding"]), p)
    back = IO.read_parquet(spark, p, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    return back.select("vec_id", F.size("embedding").alias("width"),
                       F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 3).alias("total"))
