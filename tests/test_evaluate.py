import math

import pytest

from recengine.operators.evaluate import ranking_metrics, rating_metrics, threshold_precision_recall

COLS = "user_id long, list_item long, item_id long, label double, pos_in_list long, score double"


def _metrics(spark, rows, **kw):
    df = spark.createDataFrame(rows, COLS)
    out = ranking_metrics(df, ["user_id", "list_item"], ks=(1, 3), **kw).collect()
    return {(r.k, r.metric): r.value for r in out}


def _list(list_id, pos_rank, n=4):
    # positive item 100 placed at rank pos_rank among n candidates (distinct scores)
    rows = []
    for r in range(1, n + 1):
        item = 100 if r == pos_rank else 200 + r
        rows.append((list_id, 100, item, 1.0 if item == 100 else 0.0, 0 if item == 100 else r, float(n - r)))
    return rows


@pytest.mark.parametrize("rank", [1, 2, 4])
def test_single_list_positive_at_rank(spark, rank):
    m = _metrics(spark, _list(1, rank))
    assert m[(1, "HR")] == (1.0 if rank <= 1 else 0.0)
    assert m[(3, "HR")] == (1.0 if rank <= 3 else 0.0)
    assert m[(0, "MRR")] == round(1.0 / rank, 6)
    assert m[(3, "NDCG")] == (round(1 / math.log2(rank + 1), 6) if rank <= 3 else 0.0)
    assert m[(3, "Precision")] == (round(1 / 3, 6) if rank <= 3 else 0.0)
    assert m[(3, "Recall")] == (1.0 if rank <= 3 else 0.0)


def test_all_scores_tied_break_by_item_id(spark):
    rows = [(1, 300, 300, 1.0, 0, 1.0), (1, 300, 5, 0.0, 1, 1.0), (1, 300, 7, 0.0, 2, 1.0)]
    m = _metrics(spark, rows)
    assert m[(0, "MRR")] == round(1 / 3, 6)          # items 5, 7 come first
    assert m[(0, "tied_positive_share")] == 1.0


def test_two_positives_all_relevance_and_ideal_dcg(spark):
    rows = [(1, 1, 1, 1.0, 0, 0.9), (1, 1, 2, 1.0, 1, 0.1), (1, 1, 3, 0.0, 2, 0.5)]
    m = _metrics(spark, rows, relevance="all")
    idcg = 1 + 1 / math.log2(3)
    assert m[(3, "NDCG")] == round((1 + 1 / math.log2(4)) / idcg, 6)
    assert m[(1, "Recall")] == 0.5
    assert m[(0, "MRR")] == 1.0


def test_list_without_positive_is_excluded_and_counted(spark):
    rows = _list(1, 1) + [(2, 9, 9, 0.0, 0, 1.0), (2, 9, 10, 0.0, 1, 0.5)]
    m = _metrics(spark, rows)
    assert m[(0, "lists")] == 1.0
    assert m[(0, "lists_without_relevant")] == 1.0
    assert m[(1, "HR")] == 1.0


def test_threshold_precision_recall(spark):
    df = spark.createDataFrame([(1, 1, 4.0, 4.5), (1, 2, 3.0, 4.0), (1, 3, 5.0, 1.0), (2, 1, 1.0, 1.0)],
                               "user_id long, item_id long, rating double, est double")
    r = threshold_precision_recall(df, k=2, threshold=3.5).first()
    # user 1: top2 = items 1,2 (est 4.5, 4.0), recommended both, relevant among them: item 1 -> p=1/2;
    # relevant overall: items 1, 3 -> r = 1/2.  user 2: nothing relevant/recommended -> 0, 0
    assert r.precision_at_k == 0.25 and r.recall_at_k == 0.25


def test_rating_metrics(spark):
    df = spark.createDataFrame([(1.0, 0.5), (0.0, 0.5)], "rating double, est double")
    r = rating_metrics(df).first()
    assert r.rmse == 0.5 and r.mse == 0.25 and r.mse_x5 == 1.25 and r.bce == round(math.log(2), 6)
