"""Checked queries: interactions, ids, splits, negatives, lists, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from recengine.operators import ids, itemsets, negatives, splits
from recengine.operators.evaluate import ranking_metrics
from recengine.plans import fixtures
from recengine.plans import sqlparts as q
from recengine.plans.catalog import register
from recengine.plans.flagship import dense_interactions, evaluate_popularity, popularity_scores
from recengine.session import written
from recengine.sources.tables import load

SEED = 42


def _inter(spark, sf):
    return fixtures.interactions(spark, sf)


# ---------------------------------------------------------------- flagship
@register("L6_evaluate_popularity", f"""
WITH {q.DENSE},
  {q.latest_per_user('dense')},
  train AS (SELECT * FROM dense d WHERE NOT EXISTS
            (SELECT 1 FROM latest l WHERE l.user_id = d.user_id AND l.item_id = d.item_id)),
  {q.negatives('dense', 50, SEED, 'test')},
  {q.lists('latest', 'neg')},
  pop AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM train GROUP BY item_id),
  scored AS (SELECT l.*, coalesce(p.score, 0.0) AS score FROM lists l LEFT JOIN pop p USING (item_id))
  {q.ranking_metrics('scored')}""")
def l6_evaluate_popularity(spark, sf):
    return evaluate_popularity(spark, sf, n_test=50, seed=SEED)


@register("L9_evaluate_all_relevant_mrr_at_10", f"""
WITH {q.DENSE},
  {q.latest_per_user('dense')},
  train AS (SELECT * FROM dense d WHERE NOT EXISTS
            (SELECT 1 FROM latest l WHERE l.user_id = d.user_id AND l.item_id = d.item_id)),
  {q.negatives('dense', 50, SEED, 'test')},
  {q.lists('latest', 'neg')},
  pop AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM train GROUP BY item_id),
  scored AS (SELECT l.*, coalesce(p.score, 0.0) AS score FROM lists l LEFT JOIN pop p USING (item_id))
  {q.ranking_metrics('scored', relevance='all', mrr_at=10)}""")
def l9_evaluate_variant(spark, sf):
    inter = dense_interactions(spark, sf)
    split = splits.leave_one_out(inter)
    train = split.filter(F.col("split") == "train")
    test = split.filter(F.col("split") == "test")
    lists = negatives.labelled_lists(test, negatives.sample_negatives(inter, 50, SEED, "test"))
    scored = lists.join(popularity_scores(train), "item_id", "left").fillna(0.0, subset=["score"])
    return ranking_metrics(scored, ["user_id", "list_item"], relevance="all", mrr_at=10)


# ---------------------------------------------------------------- ids
@register("I2_index_by_value", f"""
WITH inter AS ({q.INTERACTIONS})
SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM inter)""")
def i2_index_by_value(spark, sf):
    return ids.index_by_value(_inter(spark, sf), "item_id", "idx")


@register("I1_index_by_first_appearance", f"""
WITH p AS ({q.PURCHASES}),
  f AS (SELECT user_id, min((ts, order_id, line_no)) AS first FROM p GROUP BY user_id)
SELECT user_id, row_number() OVER (ORDER BY first, user_id) - 1 AS idx FROM f""")
def i1_first_appearance(spark, sf):
    p = fixtures.purchases(spark, sf)
    return ids.index_by_first_appearance(p, "user_id", ["ts", "order_id", "line_no"], "idx")


@register("I3_apply_mapping_binarise", f"""
WITH {q.DENSE}
SELECT user_id, item_id, CAST(CASE WHEN rating > 0 THEN 1 ELSE 0 END AS DOUBLE) AS label FROM dense""")
def i3_apply_mapping(spark, sf):
    d = dense_interactions(spark, sf)
    return d.select("user_id", "item_id", ids.binarise("rating").alias("label"))


@register("E5_strict_lookup", f"""
WITH inter AS ({q.INTERACTIONS}),
  m AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM inter))
SELECT user_id, m.idx AS item_idx FROM inter JOIN m USING (item_id)""")
def e5_strict_lookup(spark, sf):
    inter = _inter(spark, sf)
    m = ids.index_by_value(inter, "item_id", "idx")
    out = ids.apply_mapping(inter, m, "item_id", "idx", out_col="item_idx", mode="error")
    return out.select("user_id", "item_idx")


@register("E6_soft_lookup", f"""
WITH inter AS ({q.INTERACTIONS}), {q.latest_per_user('inter')},
  train AS (SELECT * FROM inter i WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.user_id = i.user_id AND l.item_id = i.item_id)),
  m AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM train))
SELECT l.user_id, m.idx AS item_idx FROM latest l JOIN m USING (item_id)""")
def e6_soft_lookup(spark, sf):
    s = splits.leave_one_out(_inter(spark, sf))
    train, test = s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")
    m = ids.index_by_value(train, "item_id", "idx")
    return ids.apply_mapping(test, m, "item_id", "idx", out_col="item_idx", mode="drop").select("user_id", "item_idx")


@register("I4_field_offsets", f"""
WITH inter AS ({q.INTERACTIONS})
SELECT user_id, item_id + (SELECT max(user_id) + 1 FROM inter) AS item_id FROM inter""")
def i4_field_offsets(spark, sf):
    return ids.offset_fields(_inter(spark, sf).select("user_id", "item_id"), ["user_id", "item_id"])


@register("I5_bipartite_item_node", f"""
WITH inter AS ({q.INTERACTIONS})
SELECT user_id, item_id, item_id + (SELECT max(user_id) + 1 FROM inter) AS item_node FROM inter""")
def i5_bipartite(spark, sf):
    return ids.bipartite_item_node(_inter(spark, sf).select("user_id", "item_id"))


# ---------------------------------------------------------------- splits
@register("G1_recency_rank", f"""
WITH inter AS ({q.INTERACTIONS})
SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id) AS recency_rank
FROM inter""")
def g1_recency_rank(spark, sf):
    return splits.recency_rank(_inter(spark, sf)).select("user_id", "item_id", "recency_rank")


_LOG_SQL = f"""log AS (SELECT user_id, item_id, CAST(ts AS DATE) AS ts, order_id, line_no FROM ({q.PURCHASES})),
  rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, order_id, line_no, item_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM log)"""


@register("G1_recency_rank_input_order", f"WITH {_LOG_SQL} SELECT user_id, order_id, line_no, rn AS recency_rank FROM rk")
def g1_input_order(spark, sf):
    """Ties by the row's place in the files (CSV)."""
    log = fixtures.purchase_log(spark, sf, "csv")
    return splits.recency_rank(log, pos="input_pos").select("user_id", "order_id", "line_no", "recency_rank")


@register("J7_last_row_of_log", f"""WITH {_LOG_SQL}
SELECT user_id, order_id, line_no, CASE WHEN rn = 1 THEN 'test' ELSE 'train' END AS split FROM rk WHERE n > 1""")
def j7_log(spark, sf):
    """The log repeats (user, item): one row is test, by its place in the files (Parquet)."""
    log = splits.users_with_min_rows(fixtures.purchase_log(spark, sf), min_rows=2)
    return splits.leave_one_out(log, pos="input_pos").select("user_id", "order_id", "line_no", "split")


@register("J8_last_two_rows_string_ids", f"""WITH {_LOG_SQL}
SELECT 'u_' || user_id AS user_id, 'i_' || item_id AS item_id, order_id, line_no, CASE WHEN rn = 1 THEN 'test' ELSE 'train' END AS split FROM rk WHERE rn <= 2""")
def j8_log(spark, sf):
    log = fixtures.purchase_log(spark, sf).withColumns({c: F.concat(F.lit(f"{c[0]}_"), F.col(c).cast("string")) for c in ("user_id", "item_id")})
    return splits.leave_one_out(log, train="second", pos="input_pos").select("user_id", "item_id", "order_id", "line_no", "split")


@register("J8_leave_one_out", f"""
WITH inter AS ({q.INTERACTIONS}), {q.latest_per_user('inter')}
SELECT i.user_id, i.item_id, CASE WHEN l.item_id IS NULL THEN 'train' ELSE 'test' END AS split
FROM inter i LEFT JOIN latest l ON i.user_id = l.user_id AND i.item_id = l.item_id""")
def j8_leave_one_out(spark, sf):
    return splits.leave_one_out(_inter(spark, sf)).select("user_id", "item_id", "split")


@register("J8_leave_one_out_second_only", f"""
WITH inter AS ({q.INTERACTIONS}),
  r AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id) AS rn FROM inter)
SELECT user_id, item_id, CASE WHEN rn = 1 THEN 'test' ELSE 'train' END AS split FROM r WHERE rn <= 2""")
def j8_second(spark, sf):
    return splits.leave_one_out(_inter(spark, sf), train="second").select("user_id", "item_id", "split")


@register("J7_last_item_split", f"""
WITH inter AS ({q.INTERACTIONS}),
  keep AS (SELECT * FROM inter WHERE user_id IN (SELECT user_id FROM inter GROUP BY user_id HAVING count(*) > 1)),
  r AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id) AS rn FROM keep)
SELECT user_id, item_id, CASE WHEN rn = 1 THEN 'test' ELSE 'train' END AS split FROM r""")
def j7_last_item(spark, sf):
    keep = splits.users_with_min_rows(_inter(spark, sf), min_rows=2)
    return splits.leave_one_out(keep).select("user_id", "item_id", "split")


@register("J6_tail_split", f"""
WITH inter AS ({q.INTERACTIONS}),
  r AS (SELECT user_id, item_id,
               row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS rn,
               count(*) OVER (PARTITION BY user_id) AS n FROM inter)
SELECT user_id, item_id, CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM r""")
def j6_tail_split(spark, sf):
    return splits.tail_split(_inter(spark, sf), 0.2).select("user_id", "item_id", "split")


@register("J9_random_within_user", f"""
WITH inter AS ({q.INTERACTIONS}),
  r AS (SELECT user_id, item_id,
               row_number() OVER (PARTITION BY user_id ORDER BY {q.h_hex(SEED, 'user_id', 'item_id')}, user_id, item_id) AS rn,
               count(*) OVER (PARTITION BY user_id) AS n FROM inter)
SELECT user_id, item_id, CASE WHEN rn <= ceil(0.3 * n) THEN 'test' ELSE 'train' END AS split FROM r""")
def j9_random_within_user(spark, sf):
    return splits.random_within_user(_inter(spark, sf), 0.3, SEED).select("user_id", "item_id", "split")


@register("J10_exact_random_split", f"""
WITH inter AS ({q.INTERACTIONS}),
  r AS (SELECT user_id, item_id,
               row_number() OVER (ORDER BY {q.h_hex(SEED, 'user_id', 'item_id')}, user_id, item_id) AS rn,
               count(*) OVER () AS n FROM inter)
SELECT user_id, item_id,
       CASE WHEN rn <= floor(0.8 * n) THEN 'train'
            WHEN rn <= floor(0.8 * n) + floor(0.1 * n) THEN 'valid' ELSE 'test' END AS split FROM r""")
def j10_exact_random_split(spark, sf):
    return splits.exact_random_split(_inter(spark, sf), (0.8, 0.1), seed=SEED).select("user_id", "item_id", "split")


@register("J11_stratified_split", f"""
WITH inter AS ({q.INTERACTIONS}),
  r AS (SELECT user_id, item_id, rating,
               row_number() OVER (PARTITION BY rating ORDER BY {q.h_hex(SEED, 'user_id', 'item_id')}, user_id, item_id) AS rn,
               count(*) OVER (PARTITION BY rating) AS n FROM inter)
SELECT user_id, item_id, rating, CASE WHEN rn <= ceil(0.1 * n) THEN 'test' ELSE 'train' END AS split FROM r""")
def j11_stratified(spark, sf):
    return splits.stratified_split(_inter(spark, sf), "rating", 0.1, SEED).select("user_id", "item_id", "rating", "split")


@register("J12_user_sample_split", f"""
WITH inter AS ({q.INTERACTIONS}),
  chosen AS (SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY {q.h_hex(f'{SEED}|user', 'user_id')}, user_id) AS rn
             FROM (SELECT DISTINCT user_id FROM inter)) WHERE rn <= 1000),
  r AS (SELECT user_id, item_id,
               row_number() OVER (PARTITION BY user_id ORDER BY {q.h_hex(SEED, 'user_id', 'item_id')}, user_id, item_id) AS rn,
               count(*) OVER (PARTITION BY user_id) AS n FROM inter WHERE user_id IN (SELECT user_id FROM chosen))
SELECT user_id, item_id, CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM r
UNION ALL
SELECT user_id, item_id, 'train' FROM inter WHERE user_id NOT IN (SELECT user_id FROM chosen)""")
def j12_user_sample(spark, sf):
    return splits.user_sample_split(_inter(spark, sf), 1000, 0.2, SEED).select("user_id", "item_id", "split")


# ---------------------------------------------------------------- negatives
@register("J13_negative_sampling", f"""
WITH inter AS ({q.INTERACTIONS}),
  {q.negatives('inter', 4, SEED, 'train', 'ntr')},
  {q.negatives('inter', 50, SEED, 'test', 'nte')}
SELECT user_id, item_id, 'train' AS split, neg_rank FROM ntr
UNION ALL SELECT user_id, item_id, 'test', neg_rank FROM nte""")
def j13_negatives(spark, sf):
    return negatives.train_test_negatives(_inter(spark, sf), 4, 50, SEED)


@register("J14_disjoint_negatives", f"""
WITH inter AS ({q.INTERACTIONS}),
  {q.negatives('inter', 54, SEED, 'draw')}
SELECT user_id, item_id, CASE WHEN neg_rank <= 4 THEN 'train' ELSE 'test' END AS split,
       CASE WHEN neg_rank <= 4 THEN neg_rank ELSE neg_rank - 4 END AS neg_rank FROM neg""")
def j14_disjoint(spark, sf):
    return negatives.train_test_negatives(_inter(spark, sf), 4, 50, SEED, disjoint=True)


_EVENT_TYPES = """SELECT DISTINCT user_id, event_type AS item_id FROM events"""


@register("J16_underfilled_report", f"""
WITH seen AS ({_EVENT_TYPES}),
  {q.negatives('seen', 4, SEED, 'test')},
  got AS (SELECT user_id, count(*) AS n_drawn FROM neg GROUP BY user_id)
SELECT u.user_id, coalesce(g.n_drawn, 0) AS n_drawn, CAST(4 AS BIGINT) AS n_wanted
FROM (SELECT DISTINCT user_id FROM seen) u LEFT JOIN got g USING (user_id)
WHERE coalesce(g.n_drawn, 0) < 4""")
def j16_underfilled(spark, sf):
    seen = load(spark, sf, "events", ["user_id", "event_type"]).select(
        "user_id", F.col("event_type").alias("item_id")).distinct()
    negs = negatives.sample_negatives(seen, 4, SEED, "test")
    return negatives.underfilled(negs, seen, 4).select("user_id", "n_drawn", "n_wanted")


@register("J15_labelled_samples", f"""
WITH inter AS ({q.INTERACTIONS}), {q.latest_per_user('inter')},
  train AS (SELECT * FROM inter i WHERE NOT EXISTS
            (SELECT 1 FROM latest l WHERE l.user_id = i.user_id AND l.item_id = i.item_id)),
  {q.negatives('inter', 4, SEED, 'train', 'ntr')},
  {q.negatives('inter', 50, SEED, 'test', 'nte')},
  {q.lists('train', 'ntr', 'tr_lists')},
  {q.lists('latest', 'nte', 'te_lists')}
SELECT 'train' AS split, * FROM tr_lists UNION ALL SELECT 'test', * FROM te_lists""")
def j15_labelled(spark, sf):
    inter = written(_inter(spark, sf), "interactions")
    split = splits.leave_one_out(inter)
    negs = negatives.train_test_negatives(inter, 4, 50, SEED)
    out = None
    for name in ("train", "test"):
        lists = negatives.labelled_lists(split.filter(F.col("split") == name),
                                         negs.filter(F.col("split") == name))
        lists = lists.select(F.lit(name).alias("split"), *lists.columns)
        out = lists if out is None else out.unionByName(lists)
    return out


@register("F8_popularity_rank", f"""
WITH p AS ({q.PURCHASES}),
  c AS (SELECT item_id, count(*) AS n, min((ts, order_id, line_no)) AS first FROM p GROUP BY item_id)
SELECT item_id, n AS interactions, row_number() OVER (ORDER BY n DESC, first, item_id) AS popularity_rank FROM c""")
def f8_popularity_rank(spark, sf):
    from recengine.operators.stats import popularity_rank
    return popularity_rank(fixtures.purchases(spark, sf), "item_id", ["ts", "order_id", "line_no"])


# ---------------------------------------------------------------- item sets
@register("C5_user_item_sets", f"""
WITH {q.DENSE}
SELECT user_id, count(DISTINCT item_id) AS n_items, CAST(sum(item_id) AS BIGINT) AS sum_items, CAST(sum(item_id * item_id) AS BIGINT) AS sum_squares
FROM dense GROUP BY user_id""")
def c5_sets(spark, sf):
    """Each user's set, built as bitmaps and read back from the bits."""
    sets = itemsets.item_sets(dense_interactions(spark, sf), item="item_id")
    members = itemsets.items_of(sets, item="item_id").groupBy("user_id").agg(
        F.sum("item_id").alias("sum_items"), F.sum(F.col("item_id") * F.col("item_id")).alias("sum_squares"))
    return itemsets.set_sizes(sets).join(members, "user_id")


@register("C6_pool_minus_seen", f"""
WITH {q.DENSE}, pool AS (SELECT DISTINCT item_id FROM dense),
  u AS (SELECT user_id, count(DISTINCT item_id) AS n, CAST(sum(item_id) AS BIGINT) AS s FROM dense GROUP BY user_id)
SELECT user_id, (SELECT count(*) FROM pool) - n AS n_items, CAST((SELECT sum(item_id) FROM pool) - s AS BIGINT) AS sum_items FROM u""")
def c6_pool(spark, sf):
    dense = written(dense_interactions(spark, sf).select("user_id", "item_id"), "dense")
    sets = itemsets.item_sets(dense, item="item_id")
    pool = itemsets.item_sets(dense.select(F.lit(0).alias("owner"), "item_id"), "owner", "item_id")
    rest = itemsets.pool_minus(pool, sets, dense)
    sums = itemsets.items_of(rest, item="item_id").groupBy("user_id").agg(F.sum("item_id").alias("sum_items"))
    return itemsets.set_sizes(rest).join(sums, "user_id")


@register("E4_unseen_of_neighbour", f"""
WITH {q.DENSE}
SELECT n.user_id - 1 AS user_id, n.item_id FROM dense n
WHERE n.user_id > 0 AND NOT EXISTS (SELECT 1 FROM dense d WHERE d.user_id = n.user_id - 1 AND d.item_id = n.item_id)""")
def e4_unseen(spark, sf):
    """What the next user has and the user has not: membership by bit test."""
    dense = written(dense_interactions(spark, sf).select("user_id", "item_id"), "dense")
    wanted = dense.where("user_id > 0").select((F.col("user_id") - 1).alias("user_id"), "item_id")
    return itemsets.without(wanted, itemsets.item_sets(dense, item="item_id"), item="item_id").select("user_id", "item_id")


# ---------------------------------------------------------------- the ranking itself
@register("G1_recency_rank_range_path", f"""
WITH inter AS ({q.INTERACTIONS})
SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id) AS recency_rank
FROM inter""")
def g1_range(spark, sf):
    from recengine.operators.ordering import ranked
    inter = _inter(spark, sf)
    return ranked(inter, ["user_id"], [F.col("ts").desc(), F.col("item_id").asc()], "recency_rank").select("user_id", "item_id", "recency_rank")


@register("I2_index_by_value_range_path", f"""
WITH inter AS ({q.INTERACTIONS})
SELECT user_id, item_id, row_number() OVER (ORDER BY user_id, item_id) - 1 AS idx FROM inter""")
def i2_range(spark, sf):
    from recengine.operators.ordering import dense_index
    return dense_index(_inter(spark, sf).select("user_id", "item_id"), ["user_id", "item_id"], "idx")


@register("J6_tail_split_range_path", f"""
WITH inter AS ({q.INTERACTIONS}),
  r AS (SELECT user_id, item_id,
               row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS rn,
               count(*) OVER (PARTITION BY user_id) AS n FROM inter)
SELECT user_id, item_id, rn AS rank, n AS size FROM r""")
def j6_range(spark, sf):
    from recengine.operators.ordering import ranked
    r = ranked(_inter(spark, sf), ["user_id"], [F.col("ts").desc(), F.col("item_id").desc()], "rank", "size")
    return r.select("user_id", "item_id", "rank", "size")


# ---------------------------------------------------------------- lists, rankings, sorts
_SCORED_SQL = f"""{q.DENSE},
  {q.latest_per_user('dense')},
  train AS (SELECT * FROM dense d WHERE NOT EXISTS
            (SELECT 1 FROM latest l WHERE l.user_id = d.user_id AND l.item_id = d.item_id)),
  {q.negatives('dense', 50, SEED, 'test')},
  {q.lists('latest', 'neg')},
  pop AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM train GROUP BY item_id),
  scored AS (SELECT l.*, coalesce(p.score, 0.0) AS score FROM lists l LEFT JOIN pop p USING (item_id)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, list_item ORDER BY score DESC, item_id) AS rank FROM scored)"""


def _scored_lists(spark, sf):
    inter = dense_interactions(spark, sf)
    split = splits.leave_one_out(inter)
    train = split.filter(F.col("split") == "train")
    test = split.filter(F.col("split") == "test")
    lists = negatives.labelled_lists(test, negatives.sample_negatives(inter, 50, SEED, "test"))
    return lists.join(popularity_scores(train), "item_id", "left").fillna(0.0, subset=["score"])


@register("E1_positives_join_negatives", f"""
WITH inter AS ({q.INTERACTIONS}), {q.latest_per_user('inter')},
  {q.negatives('inter', 50, SEED, 'test')}
SELECT l.user_id, l.item_id AS list_item, n.item_id, n.neg_rank FROM latest l JOIN neg n USING (user_id)""")
def e1(spark, sf):
    inter = written(_inter(spark, sf), "interactions")
    test = splits.leave_one_out(inter).filter(F.col("split") == "test").select("user_id", F.col("item_id").alias("list_item"))
    negs = negatives.sample_negatives(inter, 50, SEED, "test")
    return test.join(negs, "user_id").select("user_id", "list_item", "item_id", "neg_rank")


@register("G4_full_ranking_per_list", f"WITH {_SCORED_SQL} SELECT user_id, list_item, item_id, rank FROM rk")
def g4(spark, sf):
    from recengine.operators.evaluate import rank_lists
    return rank_lists(_scored_lists(spark, sf), ["user_id", "list_item"]).select(
        "user_id", "list_item", "item_id", F.col("rank").cast("bigint").alias("rank"))


@register("G3_top_k_per_list", f"WITH {_SCORED_SQL} SELECT user_id, list_item, item_id, rank FROM rk WHERE rank <= 10")
def g3(spark, sf):
    from recengine.operators.evaluate import top_k
    return top_k(_scored_lists(spark, sf), ["user_id", "list_item"], 10).select(
        "user_id", "list_item", "item_id", F.col("rank").cast("bigint").alias("rank"))


@register("L1_L5_per_list_metrics", f"""WITH {_SCORED_SQL},
  agg AS (SELECT user_id, list_item, sum(CASE WHEN label = 1 AND pos_in_list = 0 THEN 1 ELSE 0 END) AS n_rel,
                 count(*) AS n_items, min(CASE WHEN label = 1 AND pos_in_list = 0 THEN rank END) AS best_rank,
                 sum(CASE WHEN label = 1 AND pos_in_list = 0 AND rank <= 10 THEN 1 ELSE 0 END) AS hits,
                 sum(CASE WHEN label = 1 AND pos_in_list = 0 AND rank <= 10 THEN 1.0 / log2(rank + 1) ELSE 0.0 END) AS dcg
          FROM rk GROUP BY user_id, list_item)
SELECT user_id, list_item, CAST(CASE WHEN hits > 0 THEN 1 ELSE 0 END AS DOUBLE) AS hr_10,
       round(dcg / list_sum(list_transform(range(1, CAST(greatest(n_rel, 1) AS BIGINT) + 1), lambda j: 1.0 / log2(j + 1))), 6) AS ndcg_10,
       round(hits / n_rel, 6) AS recall_10, round(hits / least(10, n_items), 6) AS precision_10,
       round(CASE WHEN best_rank IS NULL THEN 0.0 ELSE 1.0 / best_rank END, 6) AS mrr
FROM agg""")
def l1_l5(spark, sf):
    from recengine.operators.evaluate import per_list_metrics, rank_lists
    per = per_list_metrics(rank_lists(_scored_lists(spark, sf), ["user_id", "list_item"]), ["user_id", "list_item"], ks=(10,))
    return per.select("user_id", "list_item", "hr_10", *[F.round(c, 6).alias(c) for c in
                                                         ("ndcg_10", "recall_10", "precision_10", "mrr")])


@register("F12_mean_of_per_list_metrics", f"""WITH {_SCORED_SQL},
  agg AS (SELECT user_id, list_item, min(CASE WHEN label = 1 AND pos_in_list = 0 THEN rank END) AS best_rank FROM rk
          GROUP BY user_id, list_item)
SELECT round(avg(CASE WHEN best_rank IS NULL THEN 0.0 ELSE 1.0 / best_rank END), 6) AS mean_mrr,
       round(avg(CASE WHEN best_rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS mean_hr_10 FROM agg""")
def f12(spark, sf):
    from recengine.operators.evaluate import per_list_metrics, rank_lists
    per = per_list_metrics(rank_lists(_scored_lists(spark, sf), ["user_id", "list_item"]), ["user_id", "list_item"], ks=(10,))
    return per.agg(F.round(F.avg("mrr"), 6).alias("mean_mrr"), F.round(F.avg("hr_10"), 6).alias("mean_hr_10"))


@register("G2_out_of_order_rows", f"""
WITH p AS ({q.PURCHASES}),
  r AS (SELECT user_id, item_id, order_id, line_no, ts,
               lag(ts) OVER (PARTITION BY user_id ORDER BY order_id, line_no, item_id, quantity) AS prev_ts FROM p)
SELECT user_id, item_id, order_id, line_no FROM r WHERE prev_ts > ts""")
def g2(spark, sf):
    p = fixtures.purchases(spark, sf)
    rows = splits.out_of_order_rows(p, order=["order_id", "line_no", "item_id", "quantity"])
    return rows.select("user_id", "item_id", "order_id", "line_no")


@register("G5_per_user_sort_by_score", f"""
WITH inter AS ({q.INTERACTIONS}),
  est AS (SELECT item_id, count(*) AS est FROM inter GROUP BY item_id)
SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY e.est DESC, item_id) AS rank
FROM inter JOIN est e USING (item_id)""")
def g5(spark, sf):
    from recengine.operators.ordering import ranked
    inter = _inter(spark, sf)
    est = inter.groupBy("item_id").agg(F.count(F.lit(1)).alias("est"))     # the score: item popularity
    r = ranked(inter.join(est, "item_id"), ["user_id"], [F.col("est").desc(), F.col("item_id").asc()], "rank")
    return r.select("user_id", "item_id", "rank")


@register("G6_global_sort", """
SELECT event_type, count(*) AS count FROM events GROUP BY event_type ORDER BY count DESC, event_type""")
def g6(spark, sf):
    e = load(spark, sf, "events", ["event_type"])
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "event_type")


@register("G7_best_row_by_metric", """
SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id ASC LIMIT 1""")
def g7(spark, sf):
    e = load(spark, sf, "events", ["event_id", "user_id", "value"])
    return e.orderBy(F.col("value").desc(), F.col("event_id").asc()).limit(1)


@register("J8_user_set_check", f"""
WITH inter AS ({q.INTERACTIONS}), {q.latest_per_user('inter')},
  train AS (SELECT DISTINCT i.user_id FROM inter i WHERE NOT EXISTS
            (SELECT 1 FROM latest l WHERE l.user_id = i.user_id AND l.item_id = i.item_id)),
  test AS (SELECT DISTINCT user_id FROM latest)
SELECT (SELECT count(*) FROM train) AS train_users, (SELECT count(*) FROM test) AS test_users,
       (SELECT count(*) FROM test WHERE user_id NOT IN (SELECT user_id FROM train)) AS test_only_users""")
def j8_user_check(spark, sf):
    """J8 data-quality check: the leave-one-out user sets (the reference
    asserts they are equal; users with one interaction are test-only)."""
    s = splits.leave_one_out(_inter(spark, sf))
    tr = s.filter(F.col("split") == "train").select("user_id").distinct()
    te = s.filter(F.col("split") == "test").select("user_id").distinct()
    return spark.range(1).select(tr.select(F.count(F.lit(1))).scalar().alias("train_users"),
                                 te.select(F.count(F.lit(1))).scalar().alias("test_users"),
                                 te.join(tr, "user_id", "left_anti").select(F.count(F.lit(1))).scalar()
                                 .alias("test_only_users"))
