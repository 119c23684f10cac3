"""Checked queries: cleaning (B), arrays/maps (C), joins (E), statistics (F),
set operations (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recengine.functions import arrays as A
from recengine.functions import text as T
from recengine.operators import clean, joins, splits, stats
from recengine.operators.ids import apply_mapping, binarise, index_by_value
from recengine.plans import fixtures
from recengine.plans import sqlparts as q
from recengine.plans.catalog import register
from recengine.plans.sqlparts_stats import fanout, summary_select
from recengine.sources.tables import load

SEED = 42


def _t(spark, sf, name, cols=None):
    return load(spark, sf, name, cols)


# ---------------------------------------------------------------- B
@register("B1_rename_drop", """
SELECT c_custkey AS user_id, c_name AS name, c_nationkey, c_mktsegment FROM customer""")
def b1(spark, sf):
    return clean.rename(_t(spark, sf, "customer"), {"c_custkey": "user_id", "c_name": "name"}, drop=["c_acctbal"])


@register("B2_binarise", """
SELECT event_id, CAST(CASE WHEN value > 0 THEN 1 ELSE 0 END AS DOUBLE) AS label FROM events""")
def b2(spark, sf):
    return _t(spark, sf, "events").select("event_id", binarise("value").alias("label"))


@register("B3_scale_target", f"""
WITH inter AS ({q.INTERACTIONS}) SELECT user_id, item_id, rating / 5.0 AS target FROM inter""")
def b3(spark, sf):
    return fixtures.interactions(spark, sf).select("user_id", "item_id", clean.scale("rating", 5).alias("target"))


@register("B4_id_from_suffix", """
SELECT c_custkey, TRY_CAST(string_split(c_name, '#')[-1] AS BIGINT) AS parsed_id FROM customer""")
def b4(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", clean.id_from_suffix("c_name", "#").alias("parsed_id"))


@register("B5_type_narrowing", """
SELECT CAST(l_orderkey AS INTEGER) AS order_id, CAST(l_linenumber AS SMALLINT) AS line_no,
       CAST(l_extendedprice AS FLOAT) AS price FROM lineitem""")
def b5(spark, sf):
    return _t(spark, sf, "lineitem").select(F.col("l_orderkey").cast("int").alias("order_id"),
                                            F.col("l_linenumber").cast("smallint").alias("line_no"),
                                            F.col("l_extendedprice").cast("float").alias("price"))


@register("B6_missing_default", """
SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def b6(spark, sf):
    j = _t(spark, sf, "documents", ["doc_id"]).join(_t(spark, sf, "labels"), "doc_id", "left")
    return j.select("doc_id", clean.with_default("quality", -1).alias("quality"),
                    clean.with_default("toxic", 0).alias("toxic"))


@register("B7_empty_to_null", r"""
SELECT doc_id, nullif(regexp_extract(text, '^\((\d+)\)', 1), '') AS area_code FROM documents""")
def b7(spark, sf):
    d = _t(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", clean.empty_to_null(F.regexp_extract("text", r"^\((\d+)\)", 1)).alias("area_code"))


@register("B8_optional_nested_field", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       json_extract_string(props, '$.venue.raw') AS venue_raw FROM events""")
def b8(spark, sf):
    e = _t(spark, sf, "events", ["event_id", "props"])
    p = F.from_json("props", "k INT, venue STRUCT<raw: STRING, id: BIGINT>")
    return e.select("event_id", p["k"].alias("k"), p["venue"]["raw"].alias("venue_raw"))


@register("B9_parents_without_children", """
SELECT c.c_custkey, coalesce(o.o_orderkey, -1) AS o_orderkey
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey""")
def b9(spark, sf):
    c = _t(spark, sf, "customer", ["c_custkey"])
    o = _t(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    j = c.join(o, c.c_custkey == o.o_custkey, "left")
    return j.select("c_custkey", F.coalesce("o_orderkey", F.lit(-1).cast("bigint")).alias("o_orderkey"))


@register("B10_keep_first_duplicates", f"""
WITH p AS ({q.PURCHASES}),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, order_id, line_no, quantity) AS rn FROM p)
SELECT user_id, item_id, order_id, line_no, quantity FROM r WHERE rn = 1""")
def b10(spark, sf):
    p = fixtures.purchases(spark, sf)
    kept = clean.keep_first(p, ["user_id", "item_id"], ["ts", "order_id", "line_no", "quantity"])
    return kept.select("user_id", "item_id", "order_id", "line_no", "quantity")


@register("B10_distinct_rows", f"""
SELECT DISTINCT user_id, item_id FROM ({q.PURCHASES})""")
def b10_distinct(spark, sf):
    return fixtures.purchases(spark, sf).select("user_id", "item_id").distinct()


@register("B11_zero_based", "SELECT p_partkey, p_partkey - 1 AS prev_id, p_size - 1 AS size0 FROM part")
def b11(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", clean.zero_based("p_partkey").alias("prev_id"),
                                        clean.zero_based("p_size").alias("size0"))


@register("B12_filter_sentinel", """
SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
WHERE o.o_orderkey <> -1 AND o.o_orderkey IS NOT NULL""")
def b12(spark, sf):
    return b9(spark, sf).filter((F.col("o_orderkey") != -1) & F.col("o_orderkey").isNotNull())


@register("B13_one_user_ratings", f"""
WITH inter AS ({q.INTERACTIONS})
SELECT item_id, rating FROM inter
WHERE user_id = (SELECT user_id FROM inter GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)""")
def b13(spark, sf):
    inter = fixtures.interactions(spark, sf)
    top = (inter.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.col("n").desc(), "user_id").limit(1).select("user_id"))
    return inter.join(top, "user_id", "left_semi").select("item_id", "rating")


@register("B14_sample_rows", f"""
SELECT doc_id, lang FROM documents ORDER BY {q.h_hex(SEED, 'doc_id')}, doc_id LIMIT 5""")
def b14(spark, sf):
    return clean.sample_rows(_t(spark, sf, "documents", ["doc_id", "lang"]), 5, SEED, ["doc_id"])


@register("B15_positional_stride", """
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
WHERE i % 2 = 1""")
def b15(spark, sf):
    return clean.stride(_t(spark, sf, "documents", ["doc_id", "source"]), ["doc_id"], 2, 1)


@register("B16_shape_distinct", f"""
WITH inter AS ({q.INTERACTIONS})
SELECT count(*) AS rows, count(DISTINCT user_id) AS distinct_user_id, count(DISTINCT item_id) AS distinct_item_id
FROM inter""")
def b16(spark, sf):
    return stats.shape(fixtures.interactions(spark, sf), ["user_id", "item_id"])


@register("B17_record_window_flatten", """
WITH r AS (SELECT doc_id, lang, source, row_number() OVER (ORDER BY doc_id) - 1 AS record FROM documents)
SELECT r.record, r.doc_id, nullif(r.lang, '') AS lang, l.quality, l.toxic
FROM r LEFT JOIN labels l USING (doc_id) WHERE r.record >= 300 AND r.record < 430""")
def b17(spark, sf):
    w = clean.index_window(_t(spark, sf, "documents", ["doc_id", "lang", "source"]), ["doc_id"], 300, 430)
    j = w.join(_t(spark, sf, "labels"), "doc_id", "left")
    return j.select("record", "doc_id", clean.empty_to_null("lang").alias("lang"), "quality", "toxic")


# ---------------------------------------------------------------- C
_WORDS_SQL = "string_split(text, ' ')"


@register("C1_posexplode_words", f"""
SELECT doc_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, unnest(w) AS word
FROM (SELECT doc_id, {_WORDS_SQL} AS w FROM documents)""")
def c1(spark, sf):
    d = _t(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))


@register("C2_map_to_rows", """
SELECT event_id, key, CAST(json_extract_string(props, '$.' || key) AS INTEGER) AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""")
def c2(spark, sf):
    e = _t(spark, sf, "events", ["event_id", "props"])
    m = F.from_json("props", "MAP<STRING, INT>")
    return e.select("event_id", F.explode(m).alias("key", "value"))


@register("C3_filter_list_length", """
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines FROM documents
WHERE len(string_split(text, chr(10))) >= 3""")
def c3(spark, sf):
    d = _t(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", F.split("text", "\n").alias("lines"))
    return d.filter(F.size("lines") >= 3).select("doc_id", F.size("lines").alias("n_lines"))


@register("C4_slice_head_tail", """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
  s AS (SELECT doc_id, lines, CAST(ceil(0.2 * len(lines)) AS BIGINT) AS n FROM d)
SELECT doc_id, md5(array_to_string(lines[1:len(lines) - n], chr(10))) AS head_md5,
       md5(array_to_string(lines[len(lines) - n + 1:], chr(10))) AS tail_md5,
       CAST(len(lines) - n AS INTEGER) AS n_head, CAST(n AS INTEGER) AS n_tail FROM s""")
def c4(spark, sf):
    d = _t(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", F.split("text", "\n").alias("lines"))
    n = F.ceil(F.lit(0.2) * F.size("lines")).cast("int")
    d = d.withColumn("n", n)
    h, t = A.head("lines", F.col("n")), A.tail("lines", F.col("n"))
    return d.select("doc_id", F.md5(F.array_join(h, "\n")).alias("head_md5"),
                    F.md5(F.array_join(t, "\n")).alias("tail_md5"),
                    F.size(h).alias("n_head"), F.size(t).alias("n_tail"))


@register("C5_distinct_per_row_and_pairs", f"""
SELECT doc_id, CAST(len(list_distinct({_WORDS_SQL})) AS INTEGER) AS n_distinct_words FROM documents""")
def c5(spark, sf):
    d = _t(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", F.size(F.array_distinct(F.split("text", " "))).alias("n_distinct_words"))


@register("C6_set_difference", f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w, string_split(string_split(text, chr(10))[1], ' ') AS f FROM documents)
SELECT doc_id, CAST(len(list_filter(list_distinct(w), lambda x: NOT list_contains(f, x))) AS INTEGER) AS n_new_words FROM d""")
def c6(spark, sf):
    d = _t(spark, sf, "documents", ["doc_id", "text"])
    w = F.split("text", " ")
    first = F.split(F.split("text", "\n")[0], " ")
    return d.select("doc_id", F.size(F.array_except(w, first)).alias("n_new_words"))


_GAP_TERMS = ("the", "de")


@register("C7_inverted_index_to_text", f"""
SELECT doc_id, array_to_string(list_transform({_WORDS_SQL},
       lambda w: CASE WHEN w IN {_GAP_TERMS} THEN '' ELSE w END), ' ') AS rebuilt FROM documents""")
def c7(spark, sf):
    from recengine.operators.text import inverted_index
    d = _t(spark, sf, "documents", ["doc_id", "text"])
    idx = inverted_index(d, "doc_id", "text", drop_terms=_GAP_TERMS)
    pairs = idx.withColumn("pairs", T.index_pairs("index"))
    return pairs.select("doc_id", T.text_from_pairs("pairs", "length").alias("rebuilt"))


@register("C8_struct_names_join", """
SELECT page_id, replace(url, '/', chr(10)) AS names FROM pages""")
def c8(spark, sf):
    p = _t(spark, sf, "pages", ["page_id", "url"])
    fos = F.transform(F.split("url", "/"), lambda s: F.struct(s.alias("name")))
    return p.select("page_id", A.struct_names(fos, "name", "\n").alias("names"))


@register("C9_sort_struct_array", """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(
         list_sort(list_transform(lines, lambda l, i: {'len': length(l), 'pos': i, 'line': l})),
         lambda x: x.line), chr(10))) AS sorted_md5 FROM d""")
def c9(spark, sf):
    d = _t(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", F.split("text", "\n").alias("lines"))
    s = A.sort_structs(F.transform("lines", lambda l, i: F.struct(F.length(l).alias("len"), i.alias("pos"),
                                                                  l.alias("line"))))
    return d.select("doc_id", F.md5(F.array_join(F.transform(s, lambda x: x["line"]), "\n")).alias("sorted_md5"))


@register("C10_C11_vector_ops", """
SELECT vec_id, CAST(len(embedding) * 2 AS INTEGER) AS concat_width,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 3) AS self_dot
FROM embeddings""")
def c10_c11(spark, sf):
    e = _t(spark, sf, "embeddings", ["vec_id", "embedding"])
    prod = A.hadamard(F.col("embedding").cast("array<double>"), F.col("embedding").cast("array<double>"))
    return e.select("vec_id", F.size(A.concat_vectors("embedding", "embedding")).alias("concat_width"),
                    F.round(F.aggregate(prod, F.lit(0.0), lambda a, x: a + x), 3).alias("self_dot"))


@register("C12_pad_truncate", """
SELECT doc_id, array_to_string(list_resize(string_split(text, ' ')[1:16], 16, '<pad>'), '|') AS tokens16,
       array_to_string(list_resize(string_split(source, ' ')[1:4], 4, '<pad>'), '|') AS source4 FROM documents""")
def c12(spark, sf):
    d = _t(spark, sf, "documents", ["doc_id", "text", "source"])
    return d.select("doc_id", F.array_join(A.pad_truncate(F.split("text", " "), 16, "<pad>"), "|").alias("tokens16"),
                    F.array_join(A.pad_truncate(F.split("source", " "), 4, "<pad>"), "|").alias("source4"))


@register("C13_vector_width_check", """
SELECT CAST(len(embedding) AS INTEGER) AS width, count(*) AS n,
       CAST(sum(CASE WHEN len(embedding) <> 64 THEN 1 ELSE 0 END) AS BIGINT) AS wrong FROM embeddings GROUP BY 1""")
def c13(spark, sf):
    e = _t(spark, sf, "embeddings", ["embedding"])
    return e.groupBy(F.size("embedding").alias("width")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.size("embedding") != 64).cast("bigint")).alias("wrong"))


# ---------------------------------------------------------------- E
@register("E2_left_join_text_default", """
SELECT l.doc_id, coalesce(d.lang, '') AS lang, coalesce(d.n_chars, 0) AS n_chars
FROM labels l LEFT JOIN documents d USING (doc_id)""")
def e2(spark, sf):
    j = joins.left_with_default(_t(spark, sf, "labels", ["doc_id"]), _t(spark, sf, "documents", ["doc_id", "lang", "n_chars"]),
                                ["doc_id"], {"lang": "", "n_chars": 0})
    return j.select("doc_id", "lang", "n_chars")


@register("E3_semi_join_qualifying", f"""
WITH p AS ({q.PURCHASES}),
  ok AS (SELECT order_id FROM p GROUP BY order_id HAVING count(item_id) BETWEEN 5 AND 100)
SELECT order_id, item_id, line_no FROM p WHERE order_id IN (SELECT order_id FROM ok)""")
def e3(spark, sf):
    p = fixtures.purchases(spark, sf)
    return stats.keep_groups_by_count(p, "order_id", "item_id", 5, 100).select("order_id", "item_id", "line_no")


@register("E4_anti_join_never_bought", """
SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)""")
def e4(spark, sf):
    part = _t(spark, sf, "part", ["p_partkey"])
    li = _t(spark, sf, "lineitem", ["l_partkey"]).withColumnRenamed("l_partkey", "p_partkey")
    return joins.anti(part, li, ["p_partkey"])


@register("E7_name_id_lookup", """
SELECT l.doc_id, coalesce(d.source, '') AS name, coalesce(b.item_id, 0) AS bench_id
FROM labels l LEFT JOIN documents d USING (doc_id) LEFT JOIN benchmark b ON b.item_id = l.doc_id""")
def e7(spark, sf):
    l = _t(spark, sf, "labels", ["doc_id"])
    d = _t(spark, sf, "documents", ["doc_id", "source"])
    b = _t(spark, sf, "benchmark", ["item_id"]).withColumn("doc_id", F.col("item_id"))
    j = joins.left_with_default(l, d, ["doc_id"], {"source": ""})
    j = joins.left_with_default(j, b, ["doc_id"], {"item_id": 0})
    return j.select("doc_id", F.col("source").alias("name"), F.col("item_id").alias("bench_id"))


@register("E5_train_index_applied_to_test", f"""
WITH inter AS ({q.INTERACTIONS}), {q.latest_per_user('inter')},
  train AS (SELECT * FROM inter i WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.user_id = i.user_id AND l.item_id = i.item_id)),
  m AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM train))
SELECT l.user_id, coalesce(m.idx, -1) AS item_idx FROM latest l LEFT JOIN m USING (item_id)""")
def e5_cold(spark, sf):
    s = splits.leave_one_out(fixtures.interactions(spark, sf))
    train, test = s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")
    m = index_by_value(train, "item_id", "idx")
    return apply_mapping(test, m, "item_id", "idx", out_col="item_idx", mode="unknown").select("user_id", "item_idx")


@register("E8_last_writer_map", """
SELECT p_name, arg_max(p_brand, p_partkey) AS p_brand FROM part GROUP BY p_name""")
def e8(spark, sf):
    return joins.last_writer_map(_t(spark, sf, "part", ["p_name", "p_brand", "p_partkey"]), "p_name", "p_brand", ["p_partkey"])


@register("E9_pair_embedding_gather", f"""
WITH inter AS ({q.INTERACTIONS}),
  z AS (SELECT list_transform(range(64), lambda i: CAST(0.0 AS FLOAT)) AS zero)
SELECT i.user_id, i.item_id, CAST(len(coalesce(u.embedding, z.zero)) + len(coalesce(v.embedding, z.zero)) AS INTEGER) AS width,
       round(list_sum(list_transform(coalesce(u.embedding, z.zero), lambda x: CAST(x AS DOUBLE))), 3) AS user_sum,
       round(list_sum(list_transform(coalesce(v.embedding, z.zero), lambda x: CAST(x AS DOUBLE))), 3) AS item_sum
FROM inter i CROSS JOIN z LEFT JOIN embeddings u ON u.vec_id = i.user_id LEFT JOIN embeddings v ON v.vec_id = i.item_id""")
def e9(spark, sf):
    pairs = fixtures.interactions(spark, sf).select("user_id", "item_id")
    v = joins.pair_vectors(pairs, _t(spark, sf, "embeddings", ["vec_id", "embedding"]), "vec_id", "embedding", 64)
    pv = F.col("pair_vec").cast("array<double>")
    first, second = F.slice(pv, 1, 64), F.slice(pv, 65, 64)
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 3)
    return v.select("user_id", "item_id", F.size("pair_vec").alias("width"),
                    total(first).alias("user_sum"), total(second).alias("item_sum"))


@register("E10_lift_to_edges", f"""
WITH p AS (SELECT DISTINCT user_id, item_id FROM ({q.PURCHASES}))
SELECT p.user_id AS src, p.item_id AS dst, c.c_acctbal AS value_src, pt.p_retailprice AS value_dst
FROM p LEFT JOIN customer c ON c.c_custkey = p.user_id LEFT JOIN part pt ON pt.p_partkey = p.item_id""")
def e10(spark, sf):
    """One node table: customers, and parts from the offset on."""
    edges = fixtures.purchases(spark, sf).select(F.col("user_id").alias("src"), F.col("item_id").alias("dst")).distinct()
    cust = _t(spark, sf, "customer", ["c_custkey", "c_acctbal"]).select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("value"))
    part = _t(spark, sf, "part", ["p_partkey", "p_retailprice"])
    offset = cust.select(F.max("node") + 1).scalar()
    nodes = cust.unionByName(part.select((F.col("p_partkey") + offset).alias("node"), F.col("p_retailprice").alias("value")))
    lifted = joins.lift_to_edges(edges.withColumn("dst", F.col("dst") + offset), nodes, "node", ["value"])
    return lifted.select("src", (F.col("dst") - offset).alias("dst"), "value_src", "value_dst")


@register("F1_group_count", f"""
WITH inter AS ({q.INTERACTIONS}) SELECT user_id, count(item_id) AS n FROM inter GROUP BY user_id""")
def f1(spark, sf):
    return stats.group_count(fixtures.interactions(spark, sf), "user_id", "item_id")


@register("F2_keep_groups_count_between", f"""
WITH inter AS ({q.INTERACTIONS}),
  ok AS (SELECT item_id FROM inter GROUP BY item_id HAVING count(user_id) BETWEEN 5 AND 100)
SELECT user_id, item_id FROM inter WHERE item_id IN (SELECT item_id FROM ok)""")
def f2(spark, sf):
    inter = fixtures.interactions(spark, sf)
    return stats.keep_groups_by_count(inter, "item_id", "user_id", 5, 100).select("user_id", "item_id")


@register("F3_users_more_than_one", f"""
WITH inter AS ({q.INTERACTIONS})
SELECT user_id, item_id FROM inter WHERE user_id IN (SELECT user_id FROM inter GROUP BY user_id HAVING count(*) > 1)""")
def f3(spark, sf):
    return splits.users_with_min_rows(fixtures.interactions(spark, sf), min_rows=2).select("user_id", "item_id")


@register("F4_value_counts", """
SELECT event_type, count(*) AS count FROM events GROUP BY event_type""")
def f4(spark, sf):
    return stats.value_counts(_t(spark, sf, "events", ["event_type"]), "event_type")


@register("F5_summary_quantity", summary_select("lineitem", "l_quantity"))
def f5(spark, sf):
    return stats.summary(_t(spark, sf, "lineitem", ["l_quantity"]), "l_quantity")


_RELATIONS = {
    "nation_customer": ("SELECT c_nationkey AS a, c_custkey AS b FROM customer",
                        lambda s, sf: _t(s, sf, "customer").select(F.col("c_nationkey").alias("a"), F.col("c_custkey").alias("b"))),
    "supplier_part": ("SELECT l_suppkey AS a, l_partkey AS b FROM lineitem",
                      lambda s, sf: _t(s, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))),
    "order_part": ("SELECT l_orderkey AS a, l_partkey AS b FROM lineitem",
                   lambda s, sf: _t(s, sf, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"))),
    "customer_part": (f"SELECT user_id AS a, item_id AS b FROM ({q.INTERACTIONS})",
                      lambda s, sf: fixtures.interactions(s, sf).select(F.col("user_id").alias("a"), F.col("item_id").alias("b"))),
    "brand_part": ("SELECT p_brand AS a, p_partkey AS b FROM part",
                   lambda s, sf: _t(s, sf, "part").select(F.col("p_brand").alias("a"), F.col("p_partkey").alias("b"))),
    "region_nation": ("SELECT n_regionkey AS a, n_nationkey AS b FROM nation",
                      lambda s, sf: _t(s, sf, "nation").select(F.col("n_regionkey").alias("a"), F.col("n_nationkey").alias("b"))),
    "source_lang": ("SELECT source AS a, lang AS b FROM documents",
                    lambda s, sf: _t(s, sf, "documents").select(F.col("source").alias("a"), F.col("lang").alias("b"))),
    "conversation_role": ("SELECT conv_id AS a, role AS b FROM conversations",
                          lambda s, sf: _t(s, sf, "conversations").select(F.col("conv_id").alias("a"), F.col("role").alias("b"))),
}


def _fanout_query(rel, build):
    def fn(spark, sf):
        return stats.fanout_stats(build(spark, sf), "a", "b", rel)
    return fn


for _rel, (_sql, _build) in _RELATIONS.items():
    register(f"F6_fanout_{_rel}", fanout(_sql, "a", "b", _rel))(_fanout_query(_rel, _build))


@register("F7_histogram_ratings", f"""
WITH inter AS ({q.INTERACTIONS}),
  mm AS (SELECT min(rating) AS lo, max(rating) AS hi FROM inter),
  b AS (SELECT CAST(CASE WHEN (hi - lo) / 20 = 0 THEN 0 ELSE least(floor((rating - lo) / ((hi - lo) / 20)), 19) END AS BIGINT) AS bin
        FROM inter, mm),
  c AS (SELECT bin, count(*) AS count FROM b GROUP BY bin)
SELECT r.range AS bin, round(lo + r.range * ((hi - lo) / 20), 6) AS lo, round(lo + (r.range + 1) * ((hi - lo) / 20), 6) AS hi,
       coalesce(c.count, 0) AS count
FROM range(20) r CROSS JOIN mm LEFT JOIN c ON c.bin = r.range""")
def f7(spark, sf):
    return stats.histogram(fixtures.interactions(spark, sf), "rating", 20)


@register("F9_earliest_time", f"""
WITH p AS ({q.PURCHASES})
SELECT user_id, item_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_epoch FROM p GROUP BY user_id, item_id""")
def f9(spark, sf):
    e = stats.earliest(fixtures.purchases(spark, sf), ["user_id", "item_id"])
    return e.select("user_id", "item_id", F.unix_timestamp("first_ts").alias("first_epoch"))


@register("F10_distinct_and_first_time", f"""
WITH p AS ({q.PURCHASES})
SELECT user_id, count(DISTINCT item_id) AS n_item_id,
       CAST(floor(epoch(arg_min(ts, (order_id, line_no)))) AS BIGINT) AS first_epoch FROM p GROUP BY user_id""")
def f10(spark, sf):
    d = stats.distinct_with_first(fixtures.purchases(spark, sf), "user_id", "item_id", "ts", ["order_id", "line_no"])
    return d.select("user_id", "n_item_id", F.unix_timestamp("first_ts").alias("first_epoch"))


@register("F11_node_union_max", f"""
WITH inter AS ({q.INTERACTIONS}),
  nodes AS (SELECT user_id AS node FROM inter UNION SELECT item_id + (SELECT max(user_id) + 1 FROM inter) FROM inter)
SELECT count(*) AS n_nodes, max(node) AS max_node FROM nodes""")
def f11(spark, sf):
    from recengine.operators.ids import bipartite_item_node
    inter = bipartite_item_node(fixtures.interactions(spark, sf))
    nodes = stats.node_union(inter.select("user_id"), inter.select("item_node"))
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.max("node").alias("max_node"))


# ---------------------------------------------------------------- H
@register("H1_union_all_splits", f"""
WITH inter AS ({q.INTERACTIONS}) SELECT user_id, item_id, rating FROM inter""")
def h1(spark, sf):
    s = splits.leave_one_out(fixtures.interactions(spark, sf))
    tr = s.filter(F.col("split") == "train").select("user_id", "item_id", "rating")
    te = s.filter(F.col("split") == "test").select("user_id", "item_id", "rating")
    return joins.union_all(tr, te)


@register("H2_union_distinct", """
SELECT l_partkey AS item FROM lineitem UNION SELECT p_partkey FROM part""")
def h2(spark, sf):
    return stats.node_union(_t(spark, sf, "lineitem", ["l_partkey"]), _t(spark, sf, "part", ["p_partkey"]), "item")


@register("H3_union_two_roles", """
SELECT l_orderkey AS id, 'order' AS role FROM lineitem UNION ALL SELECT l_partkey, 'part' FROM lineitem""")
def h3(spark, sf):
    return joins.union_roles(_t(spark, sf, "lineitem", ["l_orderkey", "l_partkey"]), "l_orderkey", "l_partkey", "order", "part")


@register("H4_difference", f"""
WITH inter AS ({q.INTERACTIONS}), {q.latest_per_user('inter')}
SELECT user_id, item_id FROM inter EXCEPT ALL SELECT user_id, item_id FROM latest""")
def h4(spark, sf):
    inter = fixtures.interactions(spark, sf).select("user_id", "item_id")
    test = splits.leave_one_out(fixtures.interactions(spark, sf)).filter(F.col("split") == "test").select("user_id", "item_id")
    return inter.exceptAll(test)


@register("C12_pad_to_longest", """
WITH s AS (SELECT page_id, string_split(url, '/') AS parts FROM pages),
  m AS (SELECT max(len(parts)) AS w FROM s)
SELECT page_id, array_to_string(list_resize(parts, (SELECT w FROM m), '<pad>'), '|') AS padded,
       CAST((SELECT w FROM m) AS INTEGER) AS width FROM s""")
def c12_longest(spark, sf):
    p = _t(spark, sf, "pages", ["page_id", "url"]).select("page_id", F.split("url", "/").alias("parts"))
    longest = p.select(F.max(F.size("parts"))).scalar()
    padded = A.pad_truncate("parts", longest, "<pad>")
    return p.select("page_id", F.array_join(padded, "|").alias("padded"), F.size(padded).alias("width"))
