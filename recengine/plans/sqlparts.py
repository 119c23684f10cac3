"""DuckDB SQL fragments for the oracles (the brute-force side of the check).

They restate the operators' definitions in plain SQL: global windows and
correlated subqueries are fine here, since this side only verifies results
on the small scale factor.
"""

from __future__ import annotations

INTERACTIONS = """SELECT o_custkey AS user_id, l_partkey AS item_id,
         max(l_quantity) / 10.0 AS rating, max(o_orderdate) AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY o_custkey, l_partkey"""

PURCHASES = """SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS ts,
         l_orderkey AS order_id, l_linenumber AS line_no, l_quantity AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

DENSE = f"""inter AS ({INTERACTIONS}),
  u_map AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS uidx
            FROM (SELECT DISTINCT user_id FROM inter)),
  i_map AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS iidx
            FROM (SELECT DISTINCT item_id FROM inter)),
  dense AS (SELECT u.uidx AS user_id, i.iidx AS item_id, rating, ts
            FROM inter JOIN u_map u USING (user_id) JOIN i_map i USING (item_id))"""


def h_hex(seed: str | int, *cols: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(cols)}))"


def h_int(seed: str | int, *cols: str) -> str:
    return f"CAST('0x' || substr({h_hex(seed, *cols)}, 1, 15) AS BIGINT)"


def latest_per_user(src: str, name: str = "latest") -> str:
    return f"""{name} AS (SELECT user_id, item_id FROM (
      SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id ASC) AS rn
      FROM {src}) WHERE rn = 1)"""


def negatives(seen: str, n: int, seed: int, salt: str, p: str = "neg") -> str:
    """CTEs ending in ``{p}(user_id, item_id, neg_rank)``: the hashed
    permutation sampler of ``recengine.operators.negatives``."""
    return f"""{p}_pairs AS (SELECT DISTINCT user_id, item_id FROM {seen}),
  {p}_pool AS (SELECT item_id, row_number() OVER (ORDER BY {h_hex(f'{seed}|pool', 'item_id')}, item_id) - 1 AS item_idx
               FROM (SELECT DISTINCT item_id FROM {p}_pairs)),
  {p}_pn AS (SELECT count(*) AS pool_n FROM {p}_pool),
  {p}_prime AS (SELECT min(c) AS big_p FROM (SELECT pool_n + i AS c FROM {p}_pn, range(0, 400) r(i)) q
               WHERE c >= 2 AND NOT EXISTS (SELECT 1 FROM range(2, CAST(floor(sqrt(q.c)) AS BIGINT) + 1) d(d)
                                            WHERE q.c % d = 0)),
  {p}_seen AS (SELECT DISTINCT s.user_id, x.item_idx FROM {p}_pairs s JOIN {p}_pool x USING (item_id)),
  {p}_users AS (SELECT u.user_id, count(z.item_idx) AS seen_n
                FROM (SELECT DISTINCT user_id FROM {p}_pairs) u LEFT JOIN {p}_seen z USING (user_id)
                GROUP BY u.user_id),
  {p}_slots AS (SELECT user_id, slot,
                  ((1 + {h_int(f'{seed}|{salt}|a', 'user_id')} % (big_p - 1)) * slot
                   + {h_int(f'{seed}|{salt}|b', 'user_id')} % big_p) % big_p AS item_idx
                FROM (SELECT user_id, big_p, unnest(range(0, CAST(least({n} + seen_n + big_p - pool_n, big_p) AS BIGINT))) AS slot
                      FROM {p}_users, {p}_pn, {p}_prime) w, {p}_pn),
  {p}_free AS (SELECT s.* FROM {p}_slots s, {p}_pn
               WHERE s.item_idx < pool_n
                 AND NOT EXISTS (SELECT 1 FROM {p}_seen z WHERE z.user_id = s.user_id AND z.item_idx = s.item_idx)),
  {p} AS (SELECT user_id, item_id, CAST(neg_rank AS BIGINT) AS neg_rank FROM (
            SELECT user_id, item_idx, row_number() OVER (PARTITION BY user_id ORDER BY slot) AS neg_rank
            FROM {p}_free) r JOIN {p}_pool USING (item_idx) WHERE neg_rank <= {n})"""


def lists(positives: str, negs: str, name: str = "lists") -> str:
    return f"""{name} AS (
    SELECT user_id, item_id AS list_item, item_id, CAST(1.0 AS DOUBLE) AS label, CAST(0 AS BIGINT) AS pos_in_list
    FROM (SELECT DISTINCT user_id, item_id FROM {positives})
    UNION ALL
    SELECT p.user_id, p.item_id AS list_item, n.item_id, CAST(0.0 AS DOUBLE) AS label, n.neg_rank AS pos_in_list
    FROM (SELECT DISTINCT user_id, item_id FROM {positives}) p JOIN {negs} n USING (user_id))"""


def ranking_metrics(scored: str, ks=(1, 3, 5, 10), relevance: str = "first", mrr_at: int | None = None) -> str:
    """Final SELECT producing ``(k, metric, value)`` from a CTE ``scored``
    with (user_id, list_item, item_id, label, pos_in_list, score)."""
    rel = "(label = 1 AND pos_in_list = 0)" if relevance == "first" else "(label = 1)"
    per_k = ",\n".join(
        f"sum(CASE WHEN {rel} AND rnk <= {k} THEN 1 ELSE 0 END) AS hits_{k}, "
        f"sum(CASE WHEN {rel} AND rnk <= {k} THEN 1.0 / log2(rnk + 1) ELSE 0.0 END) AS dcg_{k}"
        for k in ks)
    mrr = "CASE WHEN best_rank IS NULL THEN 0.0 ELSE 1.0 / best_rank END"
    if mrr_at is not None:
        mrr = f"CASE WHEN best_rank <= {mrr_at} THEN 1.0 / best_rank ELSE 0.0 END"
    metric_cols = ",\n".join(
        f"CASE WHEN hits_{k} > 0 THEN 1.0 ELSE 0.0 END AS hr_{k}, dcg_{k} / idcg AS ndcg_{k}, "
        f"hits_{k} / n_rel AS recall_{k}, hits_{k} / least({k}, n_items) AS precision_{k}"
        for k in ks)
    rows = ["SELECT CAST(0 AS BIGINT) AS k, 'MRR' AS metric, avg(CASE WHEN n_rel > 0 THEN mrr END) AS value FROM per",
            "SELECT 0, 'lists', CAST(sum(CASE WHEN n_rel > 0 THEN 1 ELSE 0 END) AS DOUBLE) FROM per",
            "SELECT 0, 'lists_without_relevant', CAST(sum(CASE WHEN n_rel > 0 THEN 0 ELSE 1 END) AS DOUBLE) FROM per",
            "SELECT 0, 'tied_positive_share', avg(CASE WHEN n_rel > 0 THEN CASE WHEN n_tied > 0 THEN 1.0 ELSE 0.0 END END) FROM per"]
    for k in ks:
        for m, label in (("hr", "HR"), ("ndcg", "NDCG"), ("recall", "Recall"), ("precision", "Precision")):
            rows.append(f"SELECT {k}, '{label}', avg(CASE WHEN n_rel > 0 THEN {m}_{k} END) FROM per")
    union = "\n    UNION ALL ".join(rows)
    return f""",
  rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, list_item ORDER BY score DESC, item_id ASC) AS rnk,
                max(CASE WHEN {rel} THEN score END) OVER (PARTITION BY user_id, list_item) AS pos_score
         FROM {scored}),
  agg AS (SELECT user_id, list_item,
                 sum(CASE WHEN {rel} THEN 1 ELSE 0 END) AS n_rel, count(*) AS n_items,
                 min(CASE WHEN {rel} THEN rnk END) AS best_rank,
                 sum(CASE WHEN NOT {rel} AND score = pos_score THEN 1 ELSE 0 END) AS n_tied,
                 {per_k}
          FROM rk GROUP BY user_id, list_item),
  per AS (SELECT *, {mrr} AS mrr, {metric_cols}
          FROM (SELECT *, list_sum(list_transform(range(1, CAST(greatest(n_rel, 1) AS BIGINT) + 1), lambda j: 1.0 / log2(j + 1))) AS idcg
                FROM agg))
  SELECT k, metric, round(CAST(value AS DOUBLE), 6) AS value FROM (
    {union})"""
