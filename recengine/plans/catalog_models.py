"""Checked queries: factor models and neural scorers (K1-K14) and rating metrics.

Model outputs depend on solver numerics, so each K query that returns metrics
or ranks (checked for rows only) has a ``_check`` beside it: a table of
invariants whose counts come from SQL.  L7/L8/L10 use a deterministic
estimate (item mean rating) and have exact oracles.
"""

from __future__ import annotations

import math
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recengine.operators import graph as G
from recengine.operators import models as MD
from recengine.operators import negatives as N
from recengine.operators import neural as NN
from recengine.operators import ranking_mf as RF
from recengine.operators import spectral as SP
from recengine.operators import splits as S
from recengine.operators import text as TX
from recengine.operators.evaluate import rank_lists, ranking_metrics, rating_metrics, threshold_precision_recall
from recengine.operators.ids import index_by_value
from recengine.plans import fixtures
from recengine.plans import sqlparts as q
from recengine.plans.catalog import register
from recengine.plans.flagship import popularity_scores
from recengine.session import cut_lineage, written
from recengine.sources.tables import load

SEED = 42
RANK = 8
LIST = ["user_id", "list_item"]
TEXT_WIDTH, GRAPH_WIDTH = 32, 9


class _Setup:
    """Dense interactions, leave-one-out split, negatives, labelled lists and
    ALS factors, each built once per (session, sf) when a query first asks for
    it and kept as Parquet (columns, compressed) in the shared folder."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf
        self._als, self._scorers, self._graph, self._ranking, self._text = {}, {}, None, None, None

    @cached_property
    def _inter(self) -> DataFrame:
        return written(fixtures.interactions(self.spark, self.sf), "interactions")

    @cached_property
    def items(self) -> DataFrame:
        return index_by_value(self._inter, "item_id", "iidx")

    @cached_property
    def inter(self) -> DataFrame:
        users = index_by_value(self._inter, "user_id", "uidx")
        return written(self._inter.join(users, "user_id").join(self.items, "item_id")
                       .select(F.col("uidx").alias("user_id"), F.col("iidx").alias("item_id"), "rating", "ts"), "dense")

    @cached_property
    def _split(self) -> DataFrame:
        return written(S.leave_one_out(self.inter), "split", partition_by="split")

    @property
    def train(self) -> DataFrame:
        return self._split.filter(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self._split.filter(F.col("split") == "test")

    @cached_property
    def _negatives(self) -> DataFrame:
        return N.train_test_negatives(self.inter, 4, 50, SEED)

    @cached_property
    def train_lists(self) -> DataFrame:
        return written(N.labelled_lists(self.train, self._negatives.filter(F.col("split") == "train")), "lists")

    @cached_property
    def test_lists(self) -> DataFrame:
        return written(N.labelled_lists(self.test, self._negatives.filter(F.col("split") == "test")), "lists")

    def als(self, implicit: bool = False):
        if implicit not in self._als:
            data = self.train.withColumn("rating", F.lit(1.0)) if implicit else self.train
            self._als[implicit] = MD.fit_als(data, rank=RANK, max_iter=10, implicit=implicit, seed=SEED)
        return self._als[implicit]

    def text(self) -> DataFrame:
        if self._text is None:
            self._text = self._text_vectors()
        return self._text

    def _text_vectors(self) -> DataFrame:
        part = load(self.spark, self.sf, "part", ["p_partkey", "p_name", "p_brand", "p_type"])
        docs = part.select(F.col("p_partkey").alias("item_id"),
                           F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("doc"))
        from pyspark.ml.functions import vector_to_array
        tf = cut_lineage(TX.text_features(docs, "item_id", "doc", TEXT_WIDTH))
        return (tf.join(self.items, "item_id").select(F.col("iidx").alias("item_id"),
                                                      vector_to_array("features").alias("text")))

    def graph(self) -> tuple[DataFrame, int]:
        """Vectors (node, vec) of the user-item graph of the training positives (M1): spectral embedding (M5), then NEU (M6);
        and the offset of the item nodes."""
        if self._graph is None:
            nodes, edges = G.bipartite_graph(self.train_lists)
            emb = SP.spectral_embedding(nodes, edges, GRAPH_WIDTH, tol=0.05, max_steps=6, seed=SEED)
            offset = self.train_lists.select(F.max("user_id") + 1).first()[0]
            self._graph = cut_lineage(G.neu_arrays(emb, edges, name="vec")), offset
        return self._graph

    @cached_property
    def samples(self) -> DataFrame:
        """The distinct rows of the training lists with their weights."""
        return written(NN.weighted(self.train_lists), "samples")

    def _side_parts(self, parts: tuple[str, ...]) -> tuple:
        graph, offset = self.graph() if "graph" in parts else (None, 0)
        return parts, self.text() if "text" in parts else None, graph, offset, (TEXT_WIDTH, GRAPH_WIDTH)

    def with_side(self, pairs: DataFrame, parts: tuple[str, ...]) -> DataFrame:
        return NN.with_side(pairs, *self._side_parts(parts))

    def scorer(self, name: str) -> NN.Scorer:
        if name not in self._scorers:
            shape = NN.shape_of(name, text=TEXT_WIDTH, graph=GRAPH_WIDTH)
            self._scorers[name] = NN.fit(self.samples, shape, epochs=3, batches=4, rate=0.05, seed=SEED,
                                         sides=NN.id_sides(*self._side_parts(NN.SCORERS[name][2])))
        return self._scorers[name]

    def scored(self, name: str, lists: DataFrame | None = None) -> DataFrame:
        return self.scorer(name).score(self.test_lists if lists is None else lists)

    def ranking(self) -> RF.RankingModel:
        if self._ranking is None:
            self._ranking = RF.fit_ranking(self.train, rank=2 * RANK, seed=SEED)
        return self._ranking


@lru_cache(maxsize=2)
def _setup(spark: SparkSession, sf: str) -> _Setup:
    return _Setup(spark, sf)


# counts that the checks of the models are held against
_COUNTS = f"""{q.DENSE}, {q.latest_per_user('dense')},
  train AS (SELECT * FROM dense d WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.user_id = d.user_id AND l.item_id = d.item_id)),
  free AS (SELECT user_id, (SELECT count(DISTINCT item_id) FROM dense) - count(*) AS n FROM dense GROUP BY user_id),
  tr AS (SELECT count(DISTINCT user_id) AS n_users, CAST(sum(1 + least(4, f.n)) AS BIGINT) AS n_rows FROM train JOIN free f USING (user_id)),
  te AS (SELECT count(*) AS n_lists, CAST(sum(1 + least(50, f.n)) AS BIGINT) AS n_rows,
                CAST(sum(least(10, 1 + least(50, f.n))) AS BIGINT) AS n_top FROM latest JOIN free f USING (user_id)),
  ids AS (SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items FROM dense)"""


@register("K1_als_explicit_check", f"""
WITH {q.DENSE}, {q.latest_per_user('dense')}
SELECT count(DISTINCT user_id) AS n_users, true AS finite, true AS beats_mean
FROM dense d WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.user_id = d.user_id AND l.item_id = d.item_id)""")
def k1(spark, sf):
    st = _setup(spark, sf)
    pred = st.als(False).transform(st.train.select(F.col("user_id").cast("int").alias("user_id"),
                                                   F.col("item_id").cast("int").alias("item_id"), "rating"))
    mean = st.train.select(F.avg("rating")).scalar()
    err = pred.select(F.sqrt(F.avg((F.col("prediction") - F.col("rating")) ** 2)).alias("m"),
                      F.sqrt(F.avg((F.col("rating") - mean) ** 2)).alias("b"),
                      F.countDistinct("user_id").alias("n_users"),
                      F.min((~F.isnan("prediction")).cast("int")).alias("ok"))
    return err.select("n_users", (F.col("ok") == 1).alias("finite"), (F.col("m") < F.col("b")).alias("beats_mean"))


@register("K2_als_implicit_ranking")
def k2(spark, sf):
    st = _setup(spark, sf)
    uf, itf = MD.factors(st.als(True))
    scored = MD.gmf_score(st.test_lists, uf, itf).withColumn("score", F.coalesce("gmf", F.lit(0.0)))
    return ranking_metrics(scored, LIST)


@register("K2_ranking_factorization")
def k2_ranking(spark, sf):
    st = _setup(spark, sf)
    return ranking_metrics(st.ranking().score(st.test_lists), LIST)


@register("K2_ranking_factorization_check", f"""WITH {_COUNTS}
SELECT (SELECT count(DISTINCT user_id) FROM train) AS n_users, (SELECT count(DISTINCT item_id) FROM train) AS n_items,
       true AS loss_falls, true AS bias_last, true AS beats_popularity""")
def k2_check(spark, sf):
    """The training lists (the held-out item is independent of the user in these tables): pairwise order against popularity's."""
    st = _setup(spark, sf)
    model = st.ranking()
    pop = st.train_lists.join(popularity_scores(st.train), "item_id", "left").fillna(0.0, subset=["score"])
    auc = [RF.pairwise_auc(x, LIST).first()[0] for x in (model.score(st.train_lists), pop)]
    return model.users.agg(F.count(F.lit(1)).alias("n_users"), F.min((F.element_at("vec", -1) == 1.0)).alias("bias_last")).select(
        "n_users", model.items.select(F.count(F.lit(1))).scalar().alias("n_items"),
        F.lit(all(a > b for a, b in zip(model.losses, model.losses[1:]))).alias("loss_falls"), "bias_last", F.lit(auc[0] > auc[1] + 0.05).alias("beats_popularity"))


@register("K3_compare_models_check", f"""WITH {_COUNTS}
SELECT model, CAST(20 AS BIGINT) AS n_metrics, CAST((SELECT n_lists FROM te) AS DOUBLE) AS n_lists, true AS in_unit_interval
FROM (VALUES ('als_explicit'), ('als_implicit'), ('ranking'), ('popularity')) m(model)""")
def k3_check(spark, sf):
    unit = F.col("metric").isin("lists", "lists_without_relevant") | F.col("value").between(0, 1)
    return (k3(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n_metrics"), F.max(F.when(F.col("metric") == "lists", F.col("value"))).alias("n_lists"),
                                               F.min(unit).alias("in_unit_interval")))


@register("K3_compare_models")
def k3(spark, sf):
    st = _setup(spark, sf)
    out = ranking_metrics(st.ranking().score(st.test_lists), LIST).select(F.lit("ranking").alias("model"), "*")
    for name, implicit in (("als_explicit", False), ("als_implicit", True)):
        uf, itf = MD.factors(st.als(implicit))
        scored = MD.gmf_score(st.test_lists, uf, itf).withColumn("score", F.coalesce("gmf", F.lit(0.0)))
        m = ranking_metrics(scored, LIST).select(F.lit(name).alias("model"), "*")
        out = out.unionByName(m)
    pop = (st.test_lists.join(popularity_scores(st.train), "item_id", "left").fillna(0.0, subset=["score"]))
    return out.unionByName(ranking_metrics(pop, LIST).select(F.lit("popularity").alias("model"), "*"))


@register("K4_gmf_matches_als", f"""
WITH {q.DENSE}, {q.latest_per_user('dense')}
SELECT count(*) AS n_pairs, true AS matches
FROM dense d WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.user_id = d.user_id AND l.item_id = d.item_id)""")
def k4(spark, sf):
    st = _setup(spark, sf)
    model = st.als(False)
    uf, itf = MD.factors(model)
    pairs = st.train.select(F.col("user_id").cast("int").alias("user_id"), F.col("item_id").cast("int").alias("item_id"))
    p = model.transform(pairs).select(F.col("user_id").cast("bigint").alias("user_id"), F.col("item_id").cast("bigint").alias("item_id"), "prediction")
    j = MD.gmf_score(p, uf, itf)          # both scores on one row: the pairs need not meet again
    return j.agg(F.count(F.lit(1)).alias("n_pairs"), (F.max(F.abs(F.col("gmf") - F.col("prediction"))) < 1e-3).alias("matches"))


def _ranking_query(name: str):
    def fn(spark, sf):
        return ranking_metrics(_setup(spark, sf).scored(name), LIST)
    return fn


def _scorer_check(name: str):
    def fn(spark, sf):
        """Widths, counts, and the loss against that of the label mean."""
        st = _setup(spark, sf)
        model = st.scorer(name)
        mean = st.train_lists.agg(F.avg("label")).first()[0]
        constant = -(mean * math.log(mean) + (1 - mean) * math.log(1 - mean))
        widths = (F.min(F.size("vec")) == model.shape.embedding) & (F.max(F.size("vec")) == model.shape.embedding)
        ids = model.embeddings
        return st.scored(name).agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.col("score").between(0, 1)).alias("in_unit_interval")).select(
            F.lit(name).alias("model"), ids.select(F.count(F.lit(1))).scalar().alias("n_ids"), "n_rows", F.lit(model.shape.n_tower).cast("bigint").alias("n_tower"),
            ids.select(widths).scalar().alias("one_width"), "in_unit_interval", F.lit(model.losses[-1] < constant).alias("below_label_mean"))
    return fn


def _tower_size(name: str) -> int:
    """From the model's definition: layers with biases, then one output over the joined parts."""
    gmf, mlp, parts = NN.SCORERS[name]
    dense = sum((a + 1) * b for a, b in zip(NN.LAYERS, NN.LAYERS[1:])) if mlp else 0
    return dense + (NN.LAYERS[-1] if mlp else 0) + (NN.FACTORS if gmf else 0) + ("text" in parts) * TEXT_WIDTH + ("graph" in parts) * 2 * GRAPH_WIDTH + 1


for _qname, _model in (("K5_mlp_tower", "mlp"), ("K6_neumf", "neumf"), ("K7_bertmf", "bertmf"), ("K9_graphmf", "graphmf"), ("K10_multimf", "multimf")):
    register(f"{_qname}_ranking")(_ranking_query(_model))
    register(f"{_qname}_check", f"""WITH {_COUNTS}
SELECT '{_model}' AS model, n_users + n_items AS n_ids, (SELECT n_rows FROM te) AS n_rows, CAST({_tower_size(_model)} AS BIGINT) AS n_tower,
       true AS one_width, true AS in_unit_interval, true AS below_label_mean FROM ids""")(_scorer_check(_model))


_SIDE = {name: ("text" in parts) * TEXT_WIDTH + ("graph" in parts) * 2 * GRAPH_WIDTH for name, (_, _, parts) in NN.SCORERS.items()}


@register("K12_feature_sets_by_name", f"WITH {_COUNTS} " + " UNION ALL ".join(
    f"SELECT '{n}' AS model, CAST({w} AS INTEGER) AS n_side, n_rows FROM te" for n, w in _SIDE.items()))
def k12(spark, sf):
    """The side vectors of every test row, by model name."""
    st = _setup(spark, sf)
    out = None
    for name, (_, _, parts) in NN.SCORERS.items():
        rows = (st.with_side(st.test_lists, parts).groupBy(F.size("side").alias("n_side")).agg(F.count(F.lit(1)).alias("n_rows"))
                .select(F.lit(name).alias("model"), "n_side", "n_rows"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("K11_linear_check", f"""WITH {_COUNTS}
SELECT (SELECT count(*) FROM train) AS n_train, true AS mean_kept, true AS beats_mean""")
def k11_check(spark, sf):
    """A least-squares fit with an intercept keeps the mean and is no worse than it."""
    st = _setup(spark, sf)
    uf, itf = MD.factors(st.als(False))
    train = MD.attach_features(st.train, uf, itf, MD.FEATURE_SETS["linear"])
    pred = MD.score(MD.fit_scorer(train, "linear", SEED, label="rating"), train, "linear")
    mean = st.train.select(F.avg("rating")).scalar()
    return pred.agg(F.count(F.lit(1)).alias("n_train"), (F.abs(F.avg(F.col("score") - F.col("rating"))) < 1e-6).alias("mean_kept"),
                    (F.avg((F.col("score") - F.col("rating")) ** 2) <= F.avg((F.col("rating") - mean) ** 2)).alias("beats_mean"))


@register("K11_linear_regression_rmse")
def k11(spark, sf):
    st = _setup(spark, sf)
    uf, itf = MD.factors(st.als(False))
    train = MD.attach_features(st.train, uf, itf, MD.FEATURE_SETS["linear"])
    test = MD.attach_features(st.test, uf, itf, MD.FEATURE_SETS["linear"])
    model = MD.fit_scorer(train, "linear", SEED, label="rating")
    pred = MD.score(model, test, "linear")
    return rating_metrics(pred.select((F.col("rating") / 5).alias("rating"), (F.col("score") / 5).alias("est")))


@register("K13_bce_logloss")
def k13(spark, sf):
    return rating_metrics(_setup(spark, sf).scored("neumf").select(F.col("label").alias("rating"), F.col("score").alias("est")))


@register("K13_fit_check", f"""WITH {_COUNTS}
SELECT (SELECT n_rows FROM tr) AS n_samples, CAST(3 AS BIGINT) AS n_epochs, true AS loss_falls, true AS loss_is_the_samples""")
def k13_check(spark, sf):
    """The losses of the epochs fall, and the fitted scorer's own loss on its samples is below the last epoch's mean."""
    st = _setup(spark, sf)
    model = st.scorer("neumf")
    p = F.greatest(F.least("score", F.lit(1 - 1e-7)), F.lit(1e-7))
    loss = -F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))
    own = st.scored("neumf", st.samples).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n_samples"), (F.sum(F.col("weight") * loss) / F.sum("weight")).alias("loss"))
    return own.select("n_samples", F.lit(len(model.losses)).cast("bigint").alias("n_epochs"),
                      F.lit(all(a > b for a, b in zip(model.losses, model.losses[1:]))).alias("loss_falls"),
                      F.col("loss").between(0, model.losses[-1]).alias("loss_is_the_samples"))


@register("K14_top_n_per_list")
def k14(spark, sf):
    return rank_lists(_setup(spark, sf).scored("neumf"), LIST).filter(F.col("rank") <= 10).select(*LIST, "item_id", "rank")


@register("K14_top_n_check", f"""WITH {_COUNTS}
SELECT n_lists, n_top AS n_rows, true AS ranks_gapless, true AS items_distinct FROM te""")
def k14_check(spark, sf):
    per = k14(spark, sf).groupBy(*LIST).agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("ranks"), F.countDistinct("item_id").alias("items"))
    return per.agg(F.count(F.lit(1)).alias("n_lists"), F.sum("n").alias("n_rows"), F.min(F.col("ranks") == F.col("n") * (F.col("n") + 1) / 2).alias("ranks_gapless"),
                   F.min(F.col("items") == F.col("n")).alias("items_distinct"))


@register("K14_als_top_n_candidates")
def k14_als(spark, sf):
    """Top-10 per user by ALS score over the user's candidate list (held-out
    item + sampled unseen items).  Open-catalogue top-N (ALS
    ``recommendForUserSubset``) is not used: Spark runs it as a blocked
    cartesian product of all users and items."""
    st = _setup(spark, sf)
    uf, itf = MD.factors(st.als(False))
    scored = MD.gmf_score(st.test_lists, uf, itf).withColumn("score", F.coalesce("gmf", F.lit(0.0)))
    return rank_lists(scored, LIST).filter(F.col("rank") <= 10).select(*LIST, "item_id", "rank")


# ---------------------------------------------------------------- L7/L8/L10
_EST_SQL = f"""inter AS ({q.INTERACTIONS}),
  est AS (SELECT item_id, avg(rating) AS est FROM inter GROUP BY item_id),
  pred AS (SELECT i.user_id, i.item_id, i.rating, e.est FROM inter i JOIN est e USING (item_id))"""


def _pred(spark, sf):
    inter = fixtures.interactions(spark, sf)
    est = inter.groupBy("item_id").agg(F.avg("rating").alias("est"))
    return inter.join(est, "item_id").select("user_id", "item_id", "rating", "est")


@register("L7_threshold_precision_recall", f"""
WITH {_EST_SQL},
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY est DESC, item_id) AS rn FROM pred),
  per AS (SELECT user_id, sum(CASE WHEN rating >= 3.5 THEN 1 ELSE 0 END) AS n_rel,
                 sum(CASE WHEN rn <= 10 AND est >= 3.5 THEN 1 ELSE 0 END) AS n_rec,
                 sum(CASE WHEN rn <= 10 AND est >= 3.5 AND rating >= 3.5 THEN 1 ELSE 0 END) AS n_both FROM r GROUP BY user_id)
SELECT round(avg(CASE WHEN n_rec > 0 THEN n_both / n_rec ELSE 0.0 END), 6) AS precision_at_k,
       round(avg(CASE WHEN n_rel > 0 THEN n_both / n_rel ELSE 0.0 END), 6) AS recall_at_k FROM per""")
def l7(spark, sf):
    return threshold_precision_recall(_pred(spark, sf), k=10, threshold=3.5)


_L8_COLS = """round(sqrt(avg((est - rating) * (est - rating))), 6) AS rmse, round(avg((est - rating) * (est - rating)), 6) AS mse,
       round(5 * avg((est - rating) * (est - rating)), 6) AS mse_x5, round(avg(abs(est - rating)), 6) AS mae,
       round(avg(-(rating * ln(least(greatest(est, 1e-7), 1 - 1e-7)) + (1 - rating) * ln(1 - least(greatest(est, 1e-7), 1 - 1e-7)))), 6) AS bce,
       count(*) AS n"""


@register("L8_rating_metrics", f"""
WITH {_EST_SQL}, p AS (SELECT rating / 5 AS rating, est / 5 AS est FROM pred)
SELECT {_L8_COLS} FROM p""")
def l8(spark, sf):
    p = _pred(spark, sf).select((F.col("rating") / 5).alias("rating"), (F.col("est") / 5).alias("est"))
    return rating_metrics(p)


@register("L10_metrics_by_split", f"""
WITH {_EST_SQL},
  r AS (SELECT user_id, item_id,
               row_number() OVER (ORDER BY {q.h_hex(SEED, 'user_id', 'item_id')}, user_id, item_id) AS rn,
               count(*) OVER () AS n FROM inter),
  s AS (SELECT user_id, item_id, CASE WHEN rn <= floor(0.8 * n) THEN 'train'
               WHEN rn <= floor(0.8 * n) + floor(0.1 * n) THEN 'valid' ELSE 'test' END AS split FROM r),
  p AS (SELECT s.split, pred.rating / 5 AS rating, pred.est / 5 AS est FROM pred JOIN s USING (user_id, item_id))
SELECT split, {_L8_COLS} FROM p GROUP BY split""")
def l10(spark, sf):
    s = S.exact_random_split(fixtures.interactions(spark, sf), (0.8, 0.1), seed=SEED).select("user_id", "item_id", "split")
    p = _pred(spark, sf).join(s, ["user_id", "item_id"]).select(
        "split", (F.col("rating") / 5).alias("rating"), (F.col("est") / 5).alias("est"))
    return rating_metrics(p, group=["split"])
