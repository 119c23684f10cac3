"""Factor models and scorers with Spark ML.

The reference trains PyTorch networks on one GPU; here the same feature
sets -- user factors, item factors, their element-wise product, an item text
vector, graph vectors -- are assembled into one ``features`` column and fed
to Spark ML estimators, which fit in distributed passes (ALS block updates,
L-BFGS aggregates).  Scoring is ``model.transform`` (or a factor join) over candidate rows;
open-catalogue top-N via ``recommendForUserSubset`` is not offered because
it is a blocked cartesian product of users and items.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recengine.functions.arrays import hadamard
from recengine.session import checkpoint_dir

# Feature sets by model name (reference model -> columns assembled)
FEATURE_SETS: dict[str, tuple[str, ...]] = {
    "linear": ("u", "i"),                          # K11 linear model on [u, i]
    "gmf": ("ui",),                                # K4
    "mlp": ("u", "i"),                             # K5
    "neumf": ("u", "i", "ui"),                     # K6
    "bertmf": ("u", "i", "ui", "text"),            # K7
    "graphmf": ("u", "i", "ui", "graph"),          # K9
    "multimf": ("u", "i", "ui", "text", "graph"),  # K10
}


ALS_BLOCKS, ALS_BLOCK_ROWS = 10, 4_000_000     # Spark's own number of blocks, and the ratings that one holds, about


def als_blocks(n_rows: int) -> int:
    """Blocks of users and of items: a task of the fit holds one, with the factors that its ratings meet."""
    return max(ALS_BLOCKS, -(-n_rows // ALS_BLOCK_ROWS))


def fit_als(ratings: DataFrame, rank: int = 32, max_iter: int = 10, reg: float = 0.1,
            implicit: bool = False, alpha: float = 1.0, seed: int = 42, user: str = "user_id",
            item: str = "item_id", rating: str = "rating") -> ALSModel:
    """K1/K2: explicit or implicit ALS.  Ids must be dense ints (I2).  ALS
    checkpoints its factor lineage into the shared checkpoint folder, and then
    deletes its shuffle files: more often with more blocks, to which more
    copies of the factors go."""
    checkpoint_dir(ratings.sparkSession)
    data = ratings.select(F.col(user).cast("int").alias(user), F.col(item).cast("int").alias(item),
                          F.col(rating).cast("float").alias(rating))
    blocks = als_blocks(data.count())
    als = ALS(rank=rank, numUserBlocks=blocks, numItemBlocks=blocks, maxIter=max_iter, regParam=reg, implicitPrefs=implicit, alpha=alpha, seed=seed,
              userCol=user, itemCol=item, ratingCol=rating, coldStartStrategy="nan",
              nonnegative=False, checkpointInterval=5 if blocks == ALS_BLOCKS else 2)
    return als.fit(data)


def factors(model: ALSModel) -> tuple[DataFrame, DataFrame]:
    """``(id, u)`` user factors and ``(id, i)`` item factors as arrays."""
    return (model.userFactors.select(F.col("id").cast("bigint").alias("user_id"), F.col("features").alias("u")),
            model.itemFactors.select(F.col("id").cast("bigint").alias("item_id"), F.col("features").alias("i")))


def gmf_score(pairs: DataFrame, user_f: DataFrame, item_f: DataFrame) -> DataFrame:
    """K4: ``sum(u ⊙ i)`` for (user, item) pairs by key joins (null when a
    side has no factors)."""
    j = pairs.join(user_f, "user_id", "left").join(item_f, "item_id", "left")
    dot = F.aggregate(hadamard("u", "i"), F.lit(0.0), lambda a, x: a + x)
    return j.withColumn("gmf", dot).drop("u", "i")


def attach_features(samples: DataFrame, user_f: DataFrame, item_f: DataFrame, spec: Sequence[str],
                    text: DataFrame | None = None, graph: DataFrame | None = None) -> DataFrame:
    """Join the named parts onto (user_id, item_id) rows and assemble
    them into ``features``.  ``text``: ``(item_id, text)`` array;
    ``graph``: ``(item_id, graph)`` array.  Missing parts become zeros."""
    df = samples.join(user_f, "user_id", "left").join(item_f, "item_id", "left")
    width = len(user_f.select("u").first()[0])
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.lit(width))
    df = df.withColumn("u", F.coalesce("u", zeros)).withColumn("i", F.coalesce("i", zeros))
    cols = []
    for part in spec:
        if part == "u":
            cols.append(array_to_vector(F.col("u")).alias("__f_u"))
        elif part == "i":
            cols.append(array_to_vector(F.col("i")).alias("__f_i"))
        elif part == "ui":
            cols.append(array_to_vector(hadamard("u", "i")).alias("__f_ui"))
        elif part in ("text", "graph"):
            side = text if part == "text" else graph
            if side is None:
                raise ValueError(f"feature set needs a {part} table")
            df = df.join(side, "item_id", "left")
            w = len(side.select(part).first()[0])
            cols.append(array_to_vector(F.coalesce(F.col(part).cast("array<double>"),
                                                   F.array_repeat(F.lit(0.0), F.lit(w)))).alias(f"__f_{part}"))
        else:
            raise ValueError(f"unknown feature part {part!r}")
    df = df.select("*", *cols)
    names = [f"__f_{p}" for p in spec]
    out = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    return out.drop(*names, "u", "i", *(["text"] if "text" in spec else []), *(["graph"] if "graph" in spec else []))


def scorer(kind: str = "logistic", n_features: int | None = None, seed: int = 42, label: str = "label"):
    """The estimator behind a model name."""
    if kind == "logistic":
        return LogisticRegression(featuresCol="features", labelCol=label, maxIter=30, regParam=1e-4)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=[n_features, 16, 8, 2],
                                              maxIter=50, seed=seed)
    if kind == "linear":
        return LinearRegression(featuresCol="features", labelCol=label, maxIter=30, regParam=1e-4)
    raise ValueError(kind)


def fit_scorer(train: DataFrame, kind: str = "logistic", seed: int = 42, label: str = "label") -> PipelineModel:
    """Fit on labelled samples (binary cross-entropy for classifiers)."""
    n = train.select(F.size(vector_to_array("features"))).first()[0] if kind == "mlp" else None
    data = train.withColumn(label, F.col(label).cast("double"))
    return Pipeline(stages=[scorer(kind, n, seed, label)]).fit(data)


def score(model: PipelineModel, candidates: DataFrame, kind: str = "logistic") -> DataFrame:
    """Batch-score candidate rows: ``score`` = P(label = 1) (or the
    regression output)."""
    out = model.transform(candidates)
    s = F.col("prediction") if kind == "linear" else vector_to_array("probability")[1]
    return out.withColumn("score", s.cast("double")).drop("rawPrediction", "probability", "prediction", "features")
