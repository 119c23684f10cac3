"""Item sets per user as compressed bitmaps.

Items are dense indexes (I1, I2).  A set is a few rows ``(user, bucket, words)``: a bucket spans 65,536 indexes, and
``words`` holds its non-empty 64-bit words, sorted, so a row has at most 1,024 of them whoever the user is, and a
hot user is many rows.  Sets are built by OR-ing bits (partial aggregates); membership is a bit test after an equi-join on
(user, bucket), where one side has a row per bucket instead of one per item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BITS, BUCKET_BITS = 6, 16
_IN_BUCKET = (1 << (BUCKET_BITS - WORD_BITS)) - 1


def _bucket(idx: Column) -> Column:
    return F.shiftright(idx, BUCKET_BITS)


def _word(idx: Column) -> Column:
    return F.shiftright(idx, WORD_BITS).bitwiseAND(F.lit(_IN_BUCKET)).cast("int")


def _bit(idx: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), idx.bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int"))


def item_sets(pairs: DataFrame, user: str = "user_id", item: str = "item_idx") -> DataFrame:
    """``(user, bucket, words)`` of the distinct non-negative ``item`` indexes of each user; rows with a null index are
    left out, a null user is a user."""
    i = F.col(item).cast("long")
    words = pairs.where(F.col(item).isNotNull()).groupBy(user, _bucket(i).alias("bucket"), _word(i).alias("w")).agg(F.bit_or(_bit(i)).alias("bits"))
    return words.groupBy(user, "bucket").agg(F.sort_array(F.collect_list(F.struct("w", "bits"))).alias("words"))


def set_sizes(sets: DataFrame, user: str = "user_id", name: str = "n_items") -> DataFrame:
    """(user, ``name``): items in each set."""
    here = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w["bits"]))
    return sets.groupBy(user).agg(F.sum(here).alias(name))


def _tested(candidates: DataFrame, sets: DataFrame, user: str, item: str) -> DataFrame:
    """``candidates`` with ``__in``: whether the user's set holds the item."""
    side = sets.select(F.col(user).alias("__u"), F.col("bucket").alias("__b"), F.col("words").alias("__words"))
    i = F.col(item).cast("long")
    held = F.exists("__words", lambda w: (w["w"] == _word(i)) & (w["bits"].bitwiseAND(_bit(i)) != 0))
    same = F.col(user).eqNullSafe(F.col("__u")) & (_bucket(i) == F.col("__b"))
    return candidates.join(side, same, "left").withColumn("__in", F.coalesce(held, F.lit(False))).drop("__u", "__b", "__words")


def without(candidates: DataFrame, sets: DataFrame, user: str = "user_id", item: str = "item_idx") -> DataFrame:
    """The (user, item) rows whose item is not in the user's set."""
    return _tested(candidates, sets, user, item).where(~F.col("__in")).drop("__in")


def within(candidates: DataFrame, sets: DataFrame, user: str = "user_id", item: str = "item_idx") -> DataFrame:
    """The (user, item) rows whose item is in the user's set."""
    return _tested(candidates, sets, user, item).where("__in").drop("__in")


def pool_minus(pool: DataFrame, sets: DataFrame, users: DataFrame, user: str = "user_id") -> DataFrame:
    """Sets of the pool's items that each of ``users`` has not.  ``pool`` is a set of one owner (bucket, words): a row per
    65,536 items, which the users' rows meet by bucket."""
    # users x buckets rows are the result itself, not a step to it
    buckets = pool.groupBy().agg(F.sort_array(F.collect_set("bucket"))).scalar()
    left = users.select(user).distinct().withColumn("bucket", F.explode(buckets))
    # the map is built here, once a row: inside the lambda below it would be built once a word
    mine = sets.select(F.col(user).alias("__u"), F.col("bucket").alias("__b"), F.map_from_entries("words").alias("__own"))
    met = left.join(mine, F.col(user).eqNullSafe(F.col("__u")) & (F.col("bucket") == F.col("__b")), "left")
    # the pool's words come last, so that they aren't shuffled with the users
    met = met.join(pool.select(F.col("bucket").alias("__pb"), F.col("words").alias("__pool")), F.col("bucket") == F.col("__pb"))
    rest = F.transform("__pool", lambda p: F.struct(p["w"].alias("w"), p["bits"].bitwiseAND(
        F.bitwise_not(F.coalesce(F.try_element_at("__own", p["w"]), F.lit(0).cast("long")))).alias("bits")))
    return met.select(user, "bucket", F.filter(rest, lambda w: w["bits"] != 0).alias("words"))


def items_of(sets: DataFrame, user: str = "user_id", item: str = "item_idx") -> DataFrame:
    """(user, item): the members, one row each."""
    words = sets.select(user, "bucket", F.inline("words").alias("__w", "__bits"))
    base = F.col("bucket") * (1 << BUCKET_BITS) + F.col("__w") * (1 << WORD_BITS)
    # a constant array and a filter, which Spark compiles; a lambda over the bits runs interpreted
    every = words.select(user, base.alias("__base"), "__bits", F.explode(F.sequence(F.lit(0), F.lit((1 << WORD_BITS) - 1))).alias("__k"))
    return every.where(F.call_function("getbit", "__bits", "__k") == 1).select(user, (F.col("__base") + F.col("__k")).alias(item))
