"""Train/test splits.

All splits return the input rows plus a ``split`` column.  Per-user
orderings use ``ranked`` (skew-safe, exact) or an aggregate; randomness is a
seeded md5 of the row key, so a split is the same under any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recengine.functions.hashing import hash_hex, hash_int
from recengine.operators.ordering import dense_index, ranked
from recengine.operators.selection import order_statistics


def recency_rank(df: DataFrame, user: str = "user_id", item: str = "item_id", ts: str = "ts",
                 rank_col: str = "recency_rank", pos: str | None = None) -> DataFrame:
    """G1: 1 = most recent per user; ties by input order ``pos`` (see
    ``sources.positions``), or by item id ascending where none is given.
    Rows without a time come last."""
    return ranked(df, [user], [F.col(ts).desc_nulls_last(), F.col(pos or item).asc()], rank_col=rank_col)


def out_of_order_rows(df: DataFrame, user: str = "user_id", ts: str = "ts",
                      order: list[str] | tuple[str, ...] = ("pos",)) -> DataFrame:
    """Rows whose time is older than the previous row of the same user's
    list (``order`` = list order).  The previous row is found by rank, then an
    equi-join on (user, rank - 1): no window over a user's whole list, so a
    user with a third of all rows is still spread over many tasks."""
    r = ranked(df, [user], [F.col(c) for c in order], rank_col="__r")
    prev = r.select(user, (F.col("__r") + 1).alias("__r"), F.col(ts).alias("prev_ts"))
    return r.join(prev, [user, "__r"]).filter(F.col("prev_ts") > F.col(ts)).drop("__r")


def _newest_first(df: DataFrame, ts: str) -> list[Column]:
    """Columns that put newer rows first and rows without a time last, in
    ascending order (``min`` over a struct has no descending part)."""
    kind, c = df.schema[ts].dataType, F.col(ts)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        c = F.unix_date(c)
    elif not isinstance(kind, T.NumericType):
        raise TypeError(f"{ts} must be a time or a number, is {kind.simpleString()}")
    return [c.isNull().alias("_none"), (-c).alias("_new")]


def _mark_latest(df: DataFrame, user: str, ts: str, tie: str, mark: str) -> DataFrame:
    """``mark`` = True on each user's latest row (ties: smallest ``tie``).  A
    plain aggregate picks it: partial aggregation keeps a hot user's work
    spread out, and the join back is on all of (user, ts, tie)."""
    key = F.struct(*_newest_first(df, ts), F.col(tie).alias("_tie"), F.col(ts).alias("_ts"))
    top = df.groupBy(user).agg(F.min(key).alias("_k")).select(
        F.col(user).alias("_u"), F.col("_k._ts").alias("_ts"), F.col("_k._tie").alias("_tie"), F.lit(True).alias(mark))
    same = F.col(user).eqNullSafe(F.col("_u")) & F.col(ts).eqNullSafe(F.col("_ts")) & F.col(tie).eqNullSafe(F.col("_tie"))
    return df.join(top, same, "left").drop("_u", "_ts", "_tie").withColumn(mark, F.col(mark).isNotNull())


def leave_one_out(df: DataFrame, user: str = "user_id", item: str = "item_id", ts: str = "ts",
                  train: str = "rest", pos: str | None = None) -> DataFrame:
    """Latest row per user -> test; train = all other rows
    (``train='rest'``) or only the second latest (``train='second'``).

    Rows are told apart by ``pos``, their input position
    (``sources.positions``), which also breaks ties; then exactly one row per
    user is test, whatever repeats.  Without ``pos`` ties go to the smaller
    item id, and rows equal in (user, item, ts) are one interaction: they go
    the same way.  Ids of any type; rows without a time are the oldest."""
    if train not in ("rest", "second"):
        raise ValueError(f"train must be 'rest' or 'second', got {train!r}")
    tie = pos or item
    marked = _mark_latest(df, user, ts, tie, "_t")
    split = F.when(F.col("_t"), "test").otherwise("train")
    if train == "rest":
        return marked.withColumn("split", split).drop("_t")                    # one pass, no union
    rest = _mark_latest(marked.filter(~F.col("_t")), user, ts, tie, "_s").filter(F.col("_s")).drop("_s")
    return marked.filter(F.col("_t")).unionByName(rest).withColumn("split", split).drop("_t")


def users_with_min_rows(df: DataFrame, user: str = "user_id", min_rows: int = 2) -> DataFrame:
    """keep users with at least ``min_rows`` rows (semi-join, no collect)."""
    keep = df.groupBy(user).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows)
    return df.join(keep.select(user), user, "left_semi")


def tail_split(df: DataFrame, frac: float = 0.2, user: str = "user_id", item: str = "item_id",
               ts: str = "ts") -> DataFrame:
    """Last ``ceil(frac * n)`` rows of each user's time-ordered list -> test."""
    r = ranked(df, [user], [F.col(ts).desc(), F.col(item).desc()], rank_col="_r", size_col="_n")
    return (r.withColumn("split", F.when(F.col("_r") <= F.ceil(F.lit(frac) * F.col("_n")), "test")
                         .otherwise("train")).drop("_r", "_n"))


def random_within_group(df: DataFrame, frac: float, seed: int, group: list[str], key: list[str]) -> DataFrame:
    """J9/J11 core: per group, the first ``ceil(frac * n)`` rows in seeded
    md5 order of ``key`` -> test."""
    r = ranked(df, group, [hash_hex(seed, *key), *[F.col(k) for k in key]],
               rank_col="_r", size_col="_n")
    return (r.withColumn("split", F.when(F.col("_r") <= F.ceil(F.lit(frac) * F.col("_n")), "test")
                         .otherwise("train")).drop("_r", "_n"))


def random_within_user(df: DataFrame, frac: float = 0.3, seed: int = 42, user: str = "user_id",
                       item: str = "item_id") -> DataFrame:
    """Random 70/30 inside each user (test size rounded up)."""
    return random_within_group(df, frac, seed, [user], [user, item])


def _lowest(df: DataFrame, seed: int | str, key: Sequence[str], cuts: dict[str, Column], group: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``_place``: the name of the first of ``cuts`` (row counts per
    group, ascending, expressions of ``n``) that a row is within, in seeded
    hash order of ``key``; null beyond the last.  The hash at each cut is
    found by ``selection`` (one row per group); a row is compared with it, and
    only rows equal to it are put in order among themselves."""
    h = hash_int(seed, *key)
    g = list(group)
    found = order_statistics(df.select(*g, h.alias("_h")), "_h", cuts, g)
    cut = found.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(g)],
                       *[F.col(f"{c}{end}").alias(f"_{c}{end}") for c in cuts for end in ("", "_at")],
                       *[(rank > 0).alias(f"_{c}_some") for c, rank in cuts.items()])
    same = F.lit(True)
    for k, c in enumerate(g):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    # without a group the cuts are one row
    out = df.withColumn("_h", h).join(cut if g else F.broadcast(cut), same)
    at_cut = F.lit(False)
    for c in cuts:
        at_cut = at_cut | (F.col("_h") == F.col(f"_{c}"))
    tied = Window.partitionBy(*g, "_h").orderBy(hash_hex(seed, *key), *[F.col(k) for k in key])
    place = F.lit(None).cast("string")
    for c in reversed(cuts):
        inside = (F.col("_h") < F.col(f"_{c}")) | ((F.col("_h") == F.col(f"_{c}")) & (F.col("_tie") <= F.col(f"_{c}_at")))
        place = F.when(F.col(f"_{c}_some") & inside, c).otherwise(place)
    near = out.where(at_cut).withColumn("_tie", F.row_number().over(tied))
    both = out.where(~at_cut).withColumn("_tie", F.lit(0)).unionByName(near)
    return both.withColumn("_place", place).select(*df.columns, "_place")


def stratified_split(df: DataFrame, strata: str, frac: float = 0.1, seed: int = 42,
                     key: tuple[str, ...] = ("user_id", "item_id")) -> DataFrame:
    """Per stratum, ``ceil(frac * n_stratum)`` rows in md5 order -> test."""
    placed = _lowest(df, seed, key, {"test": F.ceil(F.lit(frac) * F.col("n"))}, [strata])
    return placed.withColumn("split", F.coalesce("_place", F.lit("train"))).drop("_place")


def exact_random_split(df: DataFrame, fractions: tuple[float, ...] = (0.8, 0.1),
                       names: tuple[str, ...] = ("train", "valid", "test"), seed: int = 42,
                       key: tuple[str, ...] = ("user_id", "item_id")) -> DataFrame:
    """Global split by exact counts: ``int(f * n)`` rows for each leading
    fraction, the remainder to the last name, in md5 order of ``key``."""
    if len(names) != len(fractions) + 1:
        raise ValueError("need one more name than fractions")
    cuts, bound = {}, F.lit(0).cast("bigint")
    for f, name in zip(fractions, names):
        bound = bound + F.floor(F.lit(f) * F.col("n")).cast("bigint")
        cuts[name] = bound
    placed = _lowest(df, seed, key, cuts)
    return placed.withColumn("split", F.coalesce("_place", F.lit(names[-1]))).drop("_place")


def approximate_random_split(df: DataFrame, weights: tuple[float, ...] = (0.8, 0.1, 0.1),
                             names: tuple[str, ...] = ("train", "valid", "test"), seed: int = 42) -> DataFrame:
    """J10 fast mode: Spark's ``randomSplit`` (Bernoulli per row, sizes only
    approximately proportional; depends on the partitioning)."""
    parts = df.randomSplit(list(weights), seed)
    out = None
    for part, name in zip(parts, names):
        p = part.withColumn("split", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


def approximate_stratified_split(df: DataFrame, frac: float = 0.1, seed: int = 42,
                                 key: tuple[str, ...] = ("user_id", "item_id")) -> DataFrame:
    """J11 fast mode: every row goes to test with probability ``frac`` by a
    seeded hash of its key -- each stratum gets about ``frac`` of its rows,
    with no per-stratum counting, nothing collected, and the same rows under
    any partitioning (``sampleBy`` would need the strata on the driver)."""
    draw = F.pmod(hash_int(f"{seed}|bernoulli", *key), F.lit(1_000_000)) < int(frac * 1_000_000)
    return df.withColumn("split", F.when(draw, "test").otherwise("train"))


def user_sample_split(df: DataFrame, max_users: int = 1000, item_frac: float = 0.2, seed: int = 42,
                      user: str = "user_id", item: str = "item_id") -> DataFrame:
    """The first ``max_users`` users in md5 order hold out
    ``ceil(item_frac * n)`` of their items; every other row is train."""
    users = dense_index(df.select(user).distinct().withColumn("_h", hash_hex(f"{seed}|user", user)),
                        ["_h", user], "_uidx")
    chosen = users.filter(F.col("_uidx") < max_users).select(user)
    picked = random_within_user(df.join(chosen, user, "left_semi"), item_frac, seed, user, item)
    others = df.join(chosen, user, "left_anti").withColumn("split", F.lit("train"))
    return picked.unionByName(others)
