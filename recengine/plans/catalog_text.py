"""Checked queries: documents, strings, tokens (D), text features (K8) and
interaction building (J1-J5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recengine.functions import arrays as A
from recengine.functions import text as T
from recengine.operators import interactions as I
from recengine.operators import joins
from recengine.operators import text as TX
from recengine.plans import fixtures
from recengine.plans import sqlparts as q
from recengine.plans.catalog import register
from recengine.session import written
from recengine.sources.tables import load


def _t(spark, sf, name, cols=None):
    return load(spark, sf, name, cols)


@register("D1_course_document", """
SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '),
         lambda f, i: 'Topic ' || i || ': ' || f || chr(10)), '') || 'Description: ' || coalesce(p_type, '') AS document
FROM part""")
def d1(spark, sf):
    p = _t(spark, sf, "part", ["p_partkey", "p_name", "p_type"])
    return p.select("p_partkey", T.course_document(F.split("p_name", " "), "p_type").alias("document"))


_PAPER_SQL = """
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey, concat_ws(chr(10), 'Order ' || o.o_orderkey, 'Year: ' || year(o.o_orderdate),
         '#Citations: ' || coalesce(n.n, 0), o.o_orderstatus, c.c_mktsegment, d.text) AS document
FROM orders o LEFT JOIN n ON n.l_orderkey = o.o_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN documents d ON d.doc_id = o.o_orderkey"""


@register("D2_paper_document", _PAPER_SQL)
def d2(spark, sf):
    o = _t(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"])
    n = _t(spark, sf, "lineitem", ["l_orderkey"]).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"))
    c = _t(spark, sf, "customer", ["c_custkey", "c_mktsegment"]).withColumnRenamed("c_custkey", "o_custkey")
    d = _t(spark, sf, "documents", ["doc_id", "text"]).withColumnRenamed("doc_id", "o_orderkey")
    j = o.join(n, "o_orderkey", "left").join(c, "o_custkey", "left").join(d, "o_orderkey", "left")
    doc = T.paper_document(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.year("o_orderdate"),
                           F.coalesce("n", F.lit(0)), "o_orderstatus", "c_mktsegment", abstract="text")
    return j.select("o_orderkey", doc.alias("document"))


@register("D3_movie_document", """
SELECT p_partkey, 'Name: ' || p_name || ' Genres: ' || replace(p_brand || '|' || p_type, '|', ', ') AS document FROM part""")
def d3(spark, sf):
    p = _t(spark, sf, "part", ["p_partkey", "p_name", "p_brand", "p_type"])
    return p.select("p_partkey", T.movie_document("p_name", F.concat_ws("|", "p_brand", "p_type")).alias("document"))


def _html_sql(col: str) -> str:
    expr = col
    for pat in T.HTML_DROP:
        expr = f"regexp_replace({expr}, '{pat}', '', 'g')"
    for ent, ch in T.HTML_ENTITIES:
        ch = ch.replace("'", "''")
        expr = f"replace({expr}, '{ent}', '{ch}')"
    return f"translate({expr}, chr(10) || chr(13) || chr(9), '')"


@register("D4_strip_html", f"SELECT page_id, {_html_sql('html')} AS text FROM pages")
def d4(spark, sf):
    return _t(spark, sf, "pages", ["page_id", "html"]).select("page_id", T.strip_html("html").alias("text"))


@register("D5_clean_title", f"""
SELECT doc_id, regexp_replace(regexp_replace(text, '{T.BRACKETED}', '', 'g'), '^{T.BLANK}+|{T.BLANK}+$', '', 'g') AS title FROM documents""")
def d5(spark, sf):
    return _t(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", T.clean_title("text").alias("title"))


_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
_GENRES = ("LARGE", "MEDIUM", "PROMO", "SMALL")          # the flags consulted (a parameter)


@register("D6_first_active_genre", f"""
SELECT p_partkey, CASE {' '.join(f"WHEN p_type = '{g}' THEN '{g}'" for g in _GENRES)} ELSE '' END AS genre FROM part""")
def d6(spark, sf):
    p = _t(spark, sf, "part", ["p_partkey", "p_type"])
    flags = p.select("p_partkey", *[(F.col("p_type") == t).cast("int").alias(t) for t in _TYPES])
    return flags.select("p_partkey", T.first_active(list(_GENRES)).alias("genre"))


@register("D7_epoch_from_string", """
SELECT event_id, CAST(epoch(strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S')) AS BIGINT) AS epoch FROM events""")
def d7(spark, sf):
    e = _t(spark, sf, "events", ["event_id", "ts"])
    return e.select("event_id", T.epoch_seconds(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("epoch"))


_VOCAB_SQL = r"""toks AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '') AS w FROM documents),
  vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS token_id
            FROM (SELECT unnest(w) AS token FROM toks) GROUP BY token)"""


@register("D8_token_ids", f"""
WITH {_VOCAB_SQL},
  pos AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS token FROM toks),
  ids AS (SELECT p.doc_id, list(v.token_id ORDER BY p.pos) AS ids FROM pos p JOIN vocab v USING (token)
          WHERE p.pos < 32 GROUP BY p.doc_id),
  pad AS (SELECT t.doc_id, list_resize(coalesce(i.ids, []::BIGINT[]), 32, 0) AS ids, len(t.w) AS n_tokens
          FROM toks t LEFT JOIN ids i USING (doc_id))
SELECT doc_id, array_to_string(ids, ',') AS input_ids,
       CAST(len(list_filter(ids, lambda x: x <> 0)) AS INTEGER) AS mask_sum, CAST(n_tokens AS INTEGER) AS n_tokens FROM pad""")
def d8(spark, sf):
    d = _t(spark, sf, "documents", ["doc_id", "text"])
    tok = TX.tokenize(d, "doc_id", "text", TX.build_vocabulary(d, "text"), 32)
    return tok.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"), "n_tokens")


@register("D9_item_tokens_dedup_join", rf"""
WITH inter AS ({q.INTERACTIONS}),
  items AS (SELECT DISTINCT p.p_partkey AS item_id, p.p_name AS text FROM part p WHERE p.p_partkey IN (SELECT item_id FROM inter)),
  toks AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '') AS w FROM items),
  vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS token_id
            FROM (SELECT unnest(w) AS token FROM toks) GROUP BY token),
  pos AS (SELECT item_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS token FROM toks),
  ids AS (SELECT p.item_id, list(v.token_id ORDER BY p.pos) AS ids FROM pos p JOIN vocab v USING (token)
          WHERE p.pos < 8 GROUP BY p.item_id)
SELECT i.user_id, i.item_id, array_to_string(list_resize(coalesce(x.ids, []::BIGINT[]), 8, 0), ',') AS input_ids
FROM inter i LEFT JOIN ids x USING (item_id)""")
def d9(spark, sf):
    inter = fixtures.interactions(spark, sf)
    items = (_t(spark, sf, "part", ["p_partkey", "p_name"]).withColumnRenamed("p_partkey", "item_id")
             .join(inter.select("item_id").distinct(), "item_id", "left_semi"))
    tok = TX.tokenize(items, "item_id", "p_name", TX.build_vocabulary(items, "p_name"), 8)   # per distinct item
    j = inter.select("user_id", "item_id").join(tok.select("item_id", "input_ids"), "item_id", "left")
    return j.select("user_id", "item_id", F.array_join("input_ids", ",").alias("input_ids"))


@register("D10_math_scalars", """
SELECT event_id, round(sqrt(abs(value)), 6) + 0.0 AS sqrt_abs, CAST(ceil(value) AS BIGINT) AS ceil_v,
       round(1.0 / log2(abs(value) + 2), 6) + 0.0 AS inv_log2, round(exp(-abs(value) / 100), 6) + 0.0 AS exp_neg,
       round(1 / (1 + exp(-(value - 10))), 6) + 0.0 AS sigmoid, round(greatest(value - 10, 0.0), 6) + 0.0 AS relu,
       round(CASE WHEN value - 10 > 0 THEN value - 10 ELSE (value - 10) * 0.2 END, 6) + 0.0 AS leaky_relu,
       round(CASE WHEN value - 10 > 0 THEN value - 10 ELSE exp(value - 10) - 1 END, 6) + 0.0 AS elu
FROM events""")
def d10(spark, sf):
    e = _t(spark, sf, "events", ["event_id", "value"])
    v = F.col("value")
    r = lambda c: F.round(c, 6) + 0.0
    return e.select("event_id", r(F.sqrt(F.abs(v))).alias("sqrt_abs"), F.ceil(v).cast("bigint").alias("ceil_v"),
                    r(A.inv_log2_rank(F.abs(v) + 1)).alias("inv_log2"), r(F.exp(-F.abs(v) / 100)).alias("exp_neg"),
                    r(A.sigmoid(v - 10)).alias("sigmoid"), r(A.relu(v - 10)).alias("relu"),
                    r(A.leaky_relu(v - 10, 0.2)).alias("leaky_relu"), r(A.elu(v - 10)).alias("elu"))


@register("D11_json_functions", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       json_extract_string(props, '$.k') IS NOT NULL AS has_k,
       CAST(len(json_keys(props)) AS INTEGER) AS n_keys FROM events""")
def d11(spark, sf):
    e = _t(spark, sf, "events", ["event_id", "props"])
    m = F.from_json("props", "MAP<STRING, STRING>")
    return e.select("event_id", T.json_int("props", "k").alias("k"), F.map_contains_key(m, "k").alias("has_k"),
                    F.size(F.map_entries(m)).alias("n_keys"))


@register("K8_text_features_check", "SELECT count(*) AS n_docs, CAST(256 AS INTEGER) AS width, true AS finite FROM documents")
def k8(spark, sf):
    from pyspark.ml.functions import vector_to_array
    feats = TX.text_features(_t(spark, sf, "documents", ["doc_id", "text"]), "doc_id", "text", 256)
    arr = feats.select(vector_to_array("features").alias("v"))
    return arr.agg(F.count(F.lit(1)).alias("n_docs"), F.max(F.size("v")).alias("width"),
                   F.min(F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))).alias("finite"))


@register("K8_default_vectors", """
SELECT count(*) AS n_ids, count(*) FILTER (WHERE coalesce(d.text, '') = '') AS n_default, CAST(256 AS INTEGER) AS width, true AS default_is_empty_texts
FROM part p LEFT JOIN documents d ON d.doc_id = p.p_partkey""")
def k8_default(spark, sf):
    """Vectors for the parts whose id is a document's; the others get the vector of an empty text."""
    from pyspark.ml.functions import vector_to_array
    keys = _t(spark, sf, "part", ["p_partkey"]).withColumnRenamed("p_partkey", "doc_id")
    texts = _t(spark, sf, "documents", ["doc_id", "text"])
    table = written(TX.text_vectors(keys, texts, "doc_id", "text", 256), "vectors").withColumn("v", vector_to_array("features"))
    # the empty text's vector: no word, so no weight
    zero = F.forall("v", lambda x: x == 0)
    empty = table.join(texts.where(F.coalesce("text", F.lit("")) != "").select("doc_id"), "doc_id", "left_anti")
    return table.agg(F.count(F.lit(1)).alias("n_ids"), F.max(F.size("v")).alias("width")).select(
        "n_ids", empty.select(F.count(F.lit(1))).scalar().alias("n_default"), "width",
        (empty.where(~zero).select(F.count(F.lit(1))).scalar() == 0).alias("default_is_empty_texts"))


# ---------------------------------------------------------------- J1-J5
@register("J1_completion_rating", f"""
WITH inter AS ({q.INTERACTIONS})
SELECT user_id, item_id, round(CASE WHEN rating >= 0.8 THEN 5.0 ELSE 5.0 * sqrt(rating / 0.8) END, 6) AS completion FROM inter""")
def j1(spark, sf):
    inter = fixtures.interactions(spark, sf)
    return inter.select("user_id", "item_id", F.round(I.completion_rating(F.col("rating"), 0.8), 6).alias("completion"))


_EXERCISE_SQL = """
  owner AS (SELECT p_partkey % 97 AS problem, arg_max(p_partkey, (p_name, p_partkey)) AS exercise FROM part GROUP BY p_partkey % 97),
  ev AS (SELECT user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS problem, ts, value, event_id FROM events),
  kept AS (SELECT ev.user_id, o.exercise, ev.ts, ev.value, ev.event_id FROM ev JOIN owner o USING (problem)),
  first AS (SELECT user_id, arg_min(ts, (value, event_id)) AS ts FROM kept GROUP BY user_id),
  ex AS (SELECT DISTINCT k.user_id, k.exercise, f.ts FROM kept k JOIN first f USING (user_id))"""


def _exercise_rows(spark, sf):
    return I.exercise_interactions(fixtures.problem_log(spark, sf), fixtures.exercise_relation(spark, sf))


@register("J3_exercise_interactions", f"""WITH {_EXERCISE_SQL}
SELECT user_id, exercise, CAST(floor(epoch(ts)) AS BIGINT) AS first_epoch FROM ex""")
def j3(spark, sf):
    """The time of the user's first row in the files, not the earliest."""
    return _exercise_rows(spark, sf).select("user_id", "exercise", F.unix_timestamp("ts").alias("first_epoch"))


@register("E8_last_writer_by_input", "SELECT p_partkey % 97 AS problem, arg_max(p_partkey, (p_name, p_partkey)) AS exercise FROM part GROUP BY p_partkey % 97")
def e8_input(spark, sf):
    return joins.last_writer_map(fixtures.exercise_relation(spark, sf), "problem", "exercise", ["input_pos"])


@register("J2_behaviour_interactions", f"""
WITH {_EXERCISE_SQL},
  rc AS (SELECT p_partkey AS resource, arg_max(p_brand, p_partkey) AS course FROM part GROUP BY p_partkey),
  size AS (SELECT course, count(DISTINCT resource) AS course_size FROM rc GROUP BY course),
  act AS (SELECT o_custkey AS user_id, l_partkey AS resource, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          UNION ALL SELECT user_id, exercise, ts FROM ex),
  agg AS (SELECT a.user_id, rc.course, count(DISTINCT a.resource) AS touched, min(a.ts) AS first_ts
          FROM act a JOIN rc USING (resource) GROUP BY a.user_id, rc.course)
SELECT a.user_id, a.course, a.touched, round(a.touched / s.course_size, 6) AS progress,
       round(CASE WHEN a.touched / s.course_size >= 0.5 THEN 5.0 ELSE 5.0 * sqrt((a.touched / s.course_size) / 0.5) END, 6) AS rating,
       CAST(floor(epoch(a.first_ts)) AS BIGINT) AS first_epoch
FROM agg a JOIN size s USING (course)""")
def j2(spark, sf):
    part = _t(spark, sf, "part", ["p_partkey", "p_brand"])
    rc = joins.last_writer_map(part.withColumn("resource", F.col("p_partkey")), "resource", "p_brand", ["p_partkey"])
    rc = rc.withColumnRenamed("p_brand", "course")
    video = fixtures.purchases(spark, sf).select("user_id", F.col("item_id").alias("resource"), "ts")
    exer = _exercise_rows(spark, sf).select("user_id", F.col("exercise").alias("resource"), "ts")
    out = I.behaviour_interactions(video.unionByName(exer), rc, threshold=0.5)
    return out.select("user_id", "course", "touched", F.round("progress", 6).alias("progress"),
                      F.round("rating", 6).alias("rating"), F.unix_timestamp("first_ts").alias("first_epoch"))


@register("J4_enrolment_interactions", f"""
WITH p AS ({q.PURCHASES}),
  e AS (SELECT user_id, item_id, min((ts, order_id, line_no)) AS pos FROM p GROUP BY user_id, item_id),
  k AS (SELECT * FROM e WHERE user_id IN (SELECT user_id FROM e GROUP BY user_id HAVING count(*) >= 3)),
  r AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC, item_id DESC) AS rn,
               count(*) OVER (PARTITION BY user_id) AS n FROM k)
SELECT user_id, item_id, 1 AS rating, CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM r""")
def j4(spark, sf):
    p = fixtures.purchases(spark, sf)
    e = p.groupBy("user_id", "item_id").agg(F.min(F.struct("ts", "order_id", "line_no")).alias("pos"))
    return I.enrolment_interactions(e, 3, 0.2)


@register("J5_citation_interactions", """
WITH c AS (SELECT o.o_orderkey AS paper, coalesce(l.l_partkey, -1) AS reference
           FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey),
  ok AS (SELECT paper FROM c WHERE reference <> -1 GROUP BY paper HAVING count(reference) BETWEEN 5 AND 100)
SELECT paper AS user_id, reference AS item_id, 1 AS rating FROM c WHERE reference <> -1 AND paper IN (SELECT paper FROM ok)""")
def j5(spark, sf):
    o = _t(spark, sf, "orders", ["o_orderkey"])
    li = _t(spark, sf, "lineitem", ["l_orderkey", "l_partkey"])
    c = o.join(li, o.o_orderkey == li.l_orderkey, "left").select(
        F.col("o_orderkey").alias("paper"), F.coalesce("l_partkey", F.lit(-1).cast("bigint")).alias("reference"))
    return I.citation_interactions(c, 5, 100)
