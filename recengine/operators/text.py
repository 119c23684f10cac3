"""Text operators that need a shuffle.

Word tokens replace the reference's WordPiece tokenizer (a per-row library):
the vocabulary is a Spark aggregate over the whole corpus, applied by join
(frequent tokens, which a sketch finds, by broadcast);
the fixed width (truncation + padding) is the operator's defined output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recengine.functions.arrays import pad_truncate
from recengine.operators.ordering import dense_index
from recengine.session import written

PAD_ID = 0
UNK_ID = 1
MAX_KEY = 64            # a longer token is looked up by its digest
FREQUENT = 2_000        # tokens that are broadcast
TRACKED = 100_000       # tokens that the sketch holds


def inverted_index(df: DataFrame, key: str, text: str, drop_terms: Sequence[str] = ()) -> DataFrame:
    """``(key, index map<term, array<pos>>, length)`` from whole texts split on
    single spaces; ``drop_terms`` are left out of the index (they become gaps).
    Rows of one key share the index of all their texts; a null key has an empty one.

    Texts are shuffled by key once, whole; words never are rows.  A text's
    (term, position) pairs are sorted within its row, and each run of equal
    terms is an entry of the index."""
    empty = F.create_map().cast("map<string,array<int>>")
    length = F.size(F.split(text, " ")).alias("length")
    named = df.where(F.col(key).isNotNull()).select(
        key, length, F.collect_list(text).over(Window.partitionBy(key)).alias("__texts"))
    placed = F.flatten(F.transform("__texts", lambda t: F.transform(
        F.split(t, " "), lambda w, i: F.struct(w.alias("term"), i.alias("pos")))))
    if drop_terms:
        placed = F.filter(placed, lambda e: ~e["term"].isin(list(drop_terms)))
    at = named.select(key, "length", F.sort_array(placed).alias("__at"))
    # where a run of equal terms begins: the entry before has another term, or there is none
    first = F.filter(F.sequence(F.lit(0), F.size("__at") - 1), lambda i: F.coalesce(
        F.get("__at", i - 1)["term"] != F.get("__at", i)["term"], F.lit(True)))
    at = at.withColumn("__first", F.when(F.size("__at") > 0, first))
    ends = F.concat(F.slice("__first", 2, F.size("__first")), F.array(F.size("__at")))
    runs = F.zip_with("__first", ends, lambda i, j: F.struct(
        F.get("__at", i)["term"], F.transform(F.slice("__at", i + 1, j - i), lambda e: e["pos"])))
    found = at.select(key, F.coalesce(F.map_from_entries(runs), empty).alias("index"), "length")
    return found.unionByName(df.where(F.col(key).isNull()).select(key, empty.alias("index"), length))


def words(col: str) -> F.Column:
    """Lower-cased whitespace tokens (empty tokens removed; null is empty)."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), r"\s+"), lambda t: t != "")


def build_vocabulary(df: DataFrame, text: str, min_count: int = 1) -> DataFrame:
    """``(token, token_id, count)``: ids from 2 by count desc, token asc
    (0 = padding, 1 = unknown); a distributed aggregate + dense index."""
    counts = (df.select(F.explode(words(text)).alias("token")).groupBy("token")
              .agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= min_count))
    v = dense_index(counts, [F.col("count").desc(), F.col("token").asc()], "__i")
    return v.select("token", (F.col("__i") + 2).alias("token_id"), "count")


def _short(token: str) -> F.Column:
    """The token, or for a long one a digest with a blank before it, which no
    token has: bounds the sketch and what is broadcast."""
    return F.when(F.char_length(token) <= MAX_KEY, F.col(token)).otherwise(F.concat(F.lit(" "), F.sha2(token, 256)))


def frequent_tokens(tokens: DataFrame, vocab: DataFrame, top: int = FREQUENT, tracked: int = TRACKED) -> DataFrame:
    """``(short, token_id)`` of the ``top`` most frequent of ``tokens(short)``
    by a mergeable sketch, at most ``top`` rows of at most 65 characters;
    tokens outside the vocabulary are among them, as unknown.  A token that is
    left out holds at most the greater of 1 / top and 4 / tracked of the rows."""
    kept = tokens.select(F.explode(F.expr(f"approx_top_k(short, {int(top)}, {int(tracked)})")).alias("t"))
    return kept.select(F.col("t.item").alias("short")).join(vocab, "short", "left").select("short", _id("token_id"))


def _id(name: str) -> F.Column:
    return F.coalesce(name, F.lit(UNK_ID)).cast("bigint").alias("token_id")


def tokenize(df: DataFrame, key: str, text: str, vocab: DataFrame, width: int,
             top: int = FREQUENT, tracked: int = TRACKED) -> DataFrame:
    """``(key, input_ids array<bigint>(width), attention_mask array<int>, n_tokens)``.

    Token ids of the first ``width`` tokens (truncation), padded with 0; mask
    = 1 where the id is not padding; ``n_tokens`` counts the whole text.  Null
    text is empty, a null key is a key, and rows equal in key, head and count
    are one row.

    A text is read once and never shuffled: only its first ``width`` tokens
    are kept.  The most frequent of them meet their ids where they lie (a
    broadcast of ``top`` rows); only the others are joined with the
    vocabulary, where no single token is a large share of the rows.
    """
    split = df.select(key, words(text).alias("__w"))
    heads = written(split.select(key, F.size("__w").alias("n_tokens"), F.slice("__w", 1, width).alias("__head"))
                    .withColumn("__row", F.md5(F.concat_ws(" ", "__head"))), "heads")
    row = [key, "n_tokens", "__row"]
    tokens = heads.select(*row, F.posexplode("__head").alias("pos", "token")).select(*row, "pos", _short("token").alias("short"))
    known = vocab.select(_short("token").alias("short"), "token_id")
    frequent = F.broadcast(written(frequent_tokens(tokens, known, top, tracked), "frequent"))
    here = tokens.join(frequent, "short").select(*row, "pos", "token_id")
    others = tokens.join(frequent, "short", "left_anti").join(known, "short", "left").select(*row, "pos", _id("token_id"))
    none = heads.where(F.size("__head") == 0).select(*row, F.lit(None).cast("int").alias("pos"), F.lit(None).cast("bigint").alias("token_id"))
    found = F.when(F.col("pos").isNotNull(), F.struct("pos", "token_id"))
    ids = (here.unionByName(others).unionByName(none).groupBy(*row)
           .agg(F.array_sort(F.collect_set(found)).alias("__s"))
           .withColumn("__ids", F.transform("__s", lambda s: s["token_id"])))
    padded = pad_truncate(F.col("__ids"), width, PAD_ID).cast("array<bigint>")
    return ids.select(key, padded.alias("input_ids"),
                      F.transform(padded, lambda x: F.when(x != PAD_ID, 1).otherwise(0)).alias("attention_mask"),
                      "n_tokens")


def text_features(df: DataFrame, key: str, text: str, num_features: int = 256) -> DataFrame:
    """K8 (re-aimed): TF-IDF vector per text with Spark ML (HashingTF + IDF);
    an external encoder would plug in as an iterator ``pandas_udf`` instead."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF
    base = df.select(key, words(text).alias("__words"))
    model = Pipeline(stages=[HashingTF(inputCol="__words", outputCol="__tf", numFeatures=num_features),
                             IDF(inputCol="__tf", outputCol="features")]).fit(base)
    return model.transform(base).select(key, "features")


def text_vectors(keys: DataFrame, texts: DataFrame, key: str, text: str, num_features: int = 256) -> DataFrame:
    """K8: ``(key, features)`` for every row of ``keys``; a key without a text
    (or with a null one) gets the vector of the empty text.  Weights are
    fitted on ``texts``; vectors are made once per text, then joined."""
    from pyspark.ml.functions import array_to_vector
    made = text_features(texts.select(key, F.coalesce(text, F.lit("")).alias(text)), key, text, num_features)
    empty = array_to_vector(F.array_repeat(F.lit(0.0), F.lit(num_features)))      # no word, no weight
    return keys.select(key).join(made, key, "left").select(key, F.coalesce("features", empty).alias("features"))
