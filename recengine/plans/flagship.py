"""The end-to-end slice, one lazy plan:

orders ⋈ lineitem -> interactions -> dense ids (I2) -> leave-one-out (J8)
-> negatives (J13) -> labelled test lists (J15) -> popularity score (F8)
-> one ranking per list (G4) -> HR/NDCG/MRR/Recall/Precision @K (L6).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recengine.operators.evaluate import DEFAULT_KS, ranking_metrics
from recengine.operators.ids import apply_mapping, index_by_value
from recengine.operators.negatives import labelled_lists, sample_negatives
from recengine.operators.splits import leave_one_out
from recengine.plans.fixtures import interactions
from recengine.session import written


def dense_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions with users and items re-keyed to dense ids by value.

    The interaction table feeds both dictionaries and the re-keyed rows, so
    it is cut once (written to the shared checkpoint folder) instead of
    re-joining the raw logs for every consumer; the re-keyed table is cut
    too, since the split, the sampler and the scores all read it."""
    inter = written(interactions(spark, sf_dir), "interactions")
    users = index_by_value(inter, "user_id", "uidx")
    items = index_by_value(inter, "item_id", "iidx")
    out = apply_mapping(inter, users, "user_id", "uidx")
    return written(apply_mapping(out, items, "item_id", "iidx"), "dense")


def popularity_scores(train: DataFrame, item: str = "item_id") -> DataFrame:
    """F8 score: number of training interactions of each item."""
    return train.groupBy(item).agg(F.count(F.lit(1)).cast("double").alias("score"))


def evaluate_popularity(spark: SparkSession, sf_dir: str, n_test: int = 50, seed: int = 42,
                        ks=DEFAULT_KS) -> DataFrame:
    inter = dense_interactions(spark, sf_dir)
    split = leave_one_out(inter)
    train = split.filter(F.col("split") == "train")
    test = split.filter(F.col("split") == "test")
    negs = sample_negatives(inter, n_test, seed, "test")
    lists = labelled_lists(test, negs)
    scored = (lists.join(popularity_scores(train), "item_id", "left")
              .fillna(0.0, subset=["score"]))
    return ranking_metrics(scored, ["user_id", "list_item"], ks)
