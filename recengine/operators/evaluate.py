"""Ranking and rating evaluation.

A scored candidate table has one row per (list, item) with ``score`` and
``label``.  Each list is ranked **once** (score desc, item asc -- ties are
broken by item id, not by chance), then one ``groupBy(list)`` computes every
K's hit count and DCG, and one global ``avg`` gives the means.  Lists are
bounded by construction (1 positive + n negatives), so the per-list window
is small; the final aggregate is partial/final, so no list or metric is
computed in one task.

Output is long: ``(k, metric, value)``; ``k = 0`` means "the whole list"
(MRR and the list counts).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_KS = (1, 3, 5, 10)


def rank_lists(scored: DataFrame, list_cols: Sequence[str], score: str = "score",
               item: str = "item_id", rank_col: str = "rank") -> DataFrame:
    """Full ranking inside each list (1 = best)."""
    w = Window.partitionBy(*list_cols).orderBy(F.col(score).desc(), F.col(item).asc())
    return scored.withColumn(rank_col, F.row_number().over(w))


def top_k(scored: DataFrame, list_cols: Sequence[str], k: int, score: str = "score",
          item: str = "item_id") -> DataFrame:
    """The best ``k`` rows of each list.  ``row_number() <= k`` is
    planned with a partial WindowGroupLimit before the shuffle."""
    return rank_lists(scored, list_cols, score, item).filter(F.col("rank") <= k)


def _relevant(relevance: str) -> Column:
    if relevance == "first":          # the list's own positive (row 0, label 1)
        return (F.col("label") == 1) & (F.col("pos_in_list") == 0)
    if relevance == "all":            # every labelled row of the list
        return F.col("label") == 1
    raise ValueError(f"relevance must be 'first' or 'all', got {relevance!r}")


def per_list_metrics(ranked: DataFrame, list_cols: Sequence[str], ks: Sequence[int] = DEFAULT_KS,
                     relevance: str = "first", mrr_at: int | None = None,
                     score: str = "score") -> DataFrame:
    """One row per list: HR/NDCG/recall/precision at each K and MRR.

    NDCG divides by the ideal DCG over **all** relevant items of the list
    (not min(K, n)); precision divides by the number returned,
    ``least(K, list size)``; MRR uses the whole list unless ``mrr_at``.
    Lists without a relevant row get ``n_rel = 0`` and are left out of the
    means by ``ranking_metrics``.
    """
    rel = _relevant(relevance)
    gain = F.lit(1.0) / F.log2(F.col("rank") + 1)
    aggs = [F.sum(F.when(rel, 1).otherwise(0)).alias("n_rel"),
            F.count(F.lit(1)).alias("n_items"),
            F.min(F.when(rel, F.col("rank"))).alias("best_rank")]
    if "_pos_score" in ranked.columns:
        aggs.append(F.sum(F.when(~rel & (F.col(score) == F.col("_pos_score")), 1).otherwise(0))
                    .alias("n_tied"))
    for k in ks:
        hit_k = rel & (F.col("rank") <= k)
        aggs.append(F.sum(F.when(hit_k, 1).otherwise(0)).alias(f"hits_{k}"))
        aggs.append(F.sum(F.when(hit_k, gain).otherwise(0.0)).alias(f"dcg_{k}"))
    per = ranked.groupBy(*list_cols).agg(*aggs)
    idcg = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n_rel"), F.lit(1))), F.lit(0.0),
                       lambda acc, j: acc + F.lit(1.0) / F.log2(j + 1))
    cols = [*list_cols, "n_rel", "n_items", *(["n_tied"] if "_pos_score" in ranked.columns else [])]
    out = per.select(*cols, "best_rank", *[F.col(f"hits_{k}") for k in ks],
                     *[F.col(f"dcg_{k}") for k in ks], idcg.alias("idcg"))
    exprs = []
    for k in ks:
        h = F.col(f"hits_{k}")
        has = F.col("n_rel") > 0            # lists without a relevant row: null (left out of means)
        exprs += [(h > 0).cast("double").alias(f"hr_{k}"),
                  F.when(has, F.col(f"dcg_{k}") / F.col("idcg")).alias(f"ndcg_{k}"),
                  F.when(has, h / F.col("n_rel")).alias(f"recall_{k}"),
                  (h / F.least(F.lit(k), F.col("n_items"))).alias(f"precision_{k}")]
    best = F.col("best_rank")
    mrr = F.when(best.isNull(), 0.0).otherwise(1.0 / best)
    if mrr_at is not None:
        mrr = F.when(best <= mrr_at, mrr).otherwise(0.0)
    return out.select(*cols, *exprs, mrr.alias("mrr"))


def ranking_metrics(scored: DataFrame, list_cols: Sequence[str], ks: Sequence[int] = DEFAULT_KS,
                    relevance: str = "first", mrr_at: int | None = None, score: str = "score",
                    item: str = "item_id", digits: int = 6) -> DataFrame:
    """Mean HR, NDCG, Recall, Precision @K and MRR over lists that
    have a relevant row, plus ``lists`` (evaluated), ``lists_without_relevant``
    and ``tied_positive_share`` (share of lists whose positive ties with
    another candidate -- where the rank depends on the tie-break)."""
    ranked = rank_lists(scored, list_cols, score, item)
    w = Window.partitionBy(*list_cols)
    rel = _relevant(relevance)
    ranked = ranked.withColumn("_pos_score", F.max(F.when(rel, F.col(score))).over(w))
    per = per_list_metrics(ranked, list_cols, ks, relevance, mrr_at, score)
    ok = F.col("n_rel") > 0
    aggs = [F.avg(F.when(ok, F.col("mrr"))).alias("mrr_0"),
            F.sum(ok.cast("int")).cast("double").alias("lists_0"),
            F.sum((~ok).cast("int")).cast("double").alias("lists_without_relevant_0"),
            F.avg(F.when(ok, (F.col("n_tied") > 0).cast("double"))).alias("tied_positive_share_0")]
    for k in ks:
        for m in ("hr", "ndcg", "recall", "precision"):
            aggs.append(F.avg(F.when(ok, F.col(f"{m}_{k}"))).alias(f"{m}_{k}"))
    wide = per.agg(*aggs)
    names = [("mrr", 0, "MRR"), ("lists", 0, "lists"),
             ("lists_without_relevant", 0, "lists_without_relevant"),
             ("tied_positive_share", 0, "tied_positive_share")]
    labels = {"hr": "HR", "ndcg": "NDCG", "recall": "Recall", "precision": "Precision"}
    for k in ks:
        names += [(m, k, labels[m]) for m in ("hr", "ndcg", "recall", "precision")]
    stack = ", ".join(f"cast({k} as bigint), '{label}', `{m}_{k}`" for m, k, label in names)
    long = wide.selectExpr(f"stack({len(names)}, {stack}) as (k, metric, value)")
    return long.withColumn("value", F.round(F.col("value"), digits))


def threshold_precision_recall(pred: DataFrame, k: int = 10, threshold: float = 3.5,
                               user: str = "user_id", item: str = "item_id", est: str = "est",
                               true: str = "rating", digits: int = 6) -> DataFrame:
    """Per user, top-K by estimate; relevant = true >= t, recommended =
    est >= t within top K; precision = rel&rec / rec, recall = rel&rec / rel
    (0 when undefined); means over users.  One row ``(precision, recall)``."""
    # top-K as ``row_number() <= k`` (partial WindowGroupLimit, skew-safe);
    # the relevant count is a plain aggregate over all rows.
    w = Window.partitionBy(user).orderBy(F.col(est).desc(), F.col(item).asc())
    top = pred.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    rel = F.col(true) >= threshold
    rec = F.col(est) >= threshold
    n_rel = pred.groupBy(user).agg(F.sum(rel.cast("int")).alias("n_rel"))
    in_top = top.groupBy(user).agg(F.sum(rec.cast("int")).alias("n_rec"),
                                   F.sum((rel & rec).cast("int")).alias("n_both"))
    per = n_rel.join(in_top, user, "left").fillna(0, subset=["n_rec", "n_both"])
    per = per.select(
        F.when(F.col("n_rec") > 0, F.col("n_both") / F.col("n_rec")).otherwise(0.0).alias("p"),
        F.when(F.col("n_rel") > 0, F.col("n_both") / F.col("n_rel")).otherwise(0.0).alias("r"))
    return per.agg(F.round(F.avg("p"), digits).alias("precision_at_k"),
                   F.round(F.avg("r"), digits).alias("recall_at_k"))


def rating_metrics(pred: DataFrame, true: str = "rating", est: str = "est", group: Sequence[str] = (),
                   digits: int = 6) -> DataFrame:
    """RMSE, MSE, ``5 x MSE`` (the reported "mae"), MAE and binary
    cross-entropy (est clipped to [1e-7, 1-1e-7], true in [0,1]) per group."""
    err = F.col(est) - F.col(true)
    p = F.least(F.greatest(F.col(est), F.lit(1e-7)), F.lit(1 - 1e-7))
    bce = -(F.col(true) * F.log(p) + (1 - F.col(true)) * F.log(1 - p))
    g = pred.groupBy(*group) if group else pred.groupBy()
    return g.agg(F.round(F.sqrt(F.avg(err * err)), digits).alias("rmse"),
                 F.round(F.avg(err * err), digits).alias("mse"),
                 F.round(5 * F.avg(err * err), digits).alias("mse_x5"),
                 F.round(F.avg(F.abs(err)), digits).alias("mae"),
                 F.round(F.avg(bce), digits).alias("bce"),
                 F.count(F.lit(1)).alias("n"))
