"""Negative sampling without a cross join.

Every item of the pool gets a dense index ``0..pool-1`` in seeded md5 order.
``P`` is the smallest prime >= pool.  Each user gets a private permutation of
``[0, P)``: ``slot -> (a*slot + b) mod P`` with ``a in [1, P)`` and ``b`` drawn
from md5(seed, salt, user); slots landing at ``>= pool`` are skipped.  The
user's sample is the first ``n`` unseen items along the permutation, which is
a draw **without replacement**.  Walking ``n + seen + (P - pool)`` slots
(never more than ``P``, the whole permutation) is guaranteed to meet ``n``
unseen items when they exist, so no candidate cap is needed and the result
is exact.  The walk is done in two legs: the expected length first
(``1.25 n / share_unseen + 16``), then -- only for users still short of
``n`` -- the rest of the exact bound; so the cost is about
``users * n / share_unseen`` rows, not ``users * items`` nor ``|seen|``.

A user of up to ``LISTED`` seen items is one row: its slots, the test against
its seen items and the cut at ``n`` are arrays of that row, so no slot is
shuffled.  For the others seen items are bitmaps, slots are produced in chunks
spread by a (user, chunk) repartition, so a user holding a third of all rows
is walked by many tasks, and the final "first n per user" is a
``row_number() <= n`` that Spark plans as a partial ``WindowGroupLimit``
before the shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recengine.functions.hashing import hash_hex, hash_int
from recengine.operators.itemsets import item_sets, set_sizes, without
from recengine.operators.ordering import dense_index
from recengine.session import reuse, written

CHUNK = 4096
LISTED = 1024        # seen rows up to which a user is one row


def next_prime(n: int) -> int:
    """Smallest prime >= n (n >= 2); trial division, at most a few hundred tries."""
    p = max(2, n)
    while True:
        if p < 4 or (p % 2 and all(p % d for d in range(3, int(p ** 0.5) + 1, 2))):
            return p
        p += 1


def _permuted(big_p: int, slot):
    """``(a * slot + b) mod P``; in decimals where a product could pass 63 bits."""
    if big_p < 3_000_000_000:
        return F.pmod(F.col("_a") * slot + F.col("_b"), F.lit(big_p))
    wide = F.col("_a").cast("decimal(19,0)") * slot.cast("decimal(19,0)")
    return F.pmod((wide % F.lit(big_p).cast("decimal(19,0)")).cast("bigint") + F.col("_b"), F.lit(big_p))


def item_pool_index(items: DataFrame, seed: int, item: str = "item_id") -> DataFrame:
    """``(item, item_idx)``: pool items densely indexed in md5(seed, item) order.
    Materialised once: the sampler counts it and joins it twice."""
    pool = items.select(item).distinct().withColumn("_h", hash_hex(f"{seed}|pool", item))
    return written(dense_index(pool, ["_h", item], "item_idx").select(item, "item_idx"), "pool")


class Seen(NamedTuple):
    """The users' seen items by their indexes in a pool, for any number of draws: ``lists`` (user, _items) with a row per user
    of few rows; ``sets`` (bitmaps) and ``hot`` (user) of the other users, None where there are none."""
    lists: DataFrame
    sets: DataFrame | None
    hot: DataFrame | None


def seen_items(pairs: DataFrame, pool_index: DataFrame, user: str = "user_id", item: str = "item_id", listed: int = LISTED) -> Seen:
    """``Seen`` of (user, item) rows, duplicates allowed; users whose items are all outside the pool are there, too."""
    numbered = written(pairs.select(user, item).join(pool_index, item, "left").select(user, "item_idx"), "numbered")
    hot = written(numbered.groupBy(user).agg(F.count("item_idx").alias("_rows")).where(F.col("_rows") > listed).select(user), "hot")
    few, sets = numbered, None
    if hot.isEmpty():
        hot = None
    else:
        of = hot.select(F.col(user).alias("_hot"))
        same = F.col(user).eqNullSafe(F.col("_hot"))
        few = numbered.join(of, same, "left_anti")
        sets = written(item_sets(numbered.join(of, same, "left_semi"), user, "item_idx"), "seen")
    lists = few.groupBy(user).agg(F.collect_set("item_idx").alias("_items"))
    return Seen(written(lists, "lists"), sets, hot)


def sample_negatives(seen: DataFrame, n: int, seed: int = 42, salt: str = "neg",
                     pool: DataFrame | None = None, user: str = "user_id",
                     item: str = "item_id", pool_index: DataFrame | None = None,
                     first_leg_scale: float = 1.25, first_leg_margin: int = 16,
                     of_users: Seen | None = None, listed: int = LISTED) -> DataFrame:
    """For every user in ``seen``, ``n`` items of the pool it never saw.

    ``seen``: (user, item) rows (duplicates allowed; read twice).  ``pool``: items to draw
    from (default: the items of ``seen``).  Returns ``(user, item, neg_rank)``
    with ``neg_rank`` 1..n; a user with fewer than ``n`` unseen items gets all
    of them (see ``underfilled``).  ``of_users``: the users' seen items over
    ``pool_index`` (``seen_items``), to build them once for several draws.
    """
    idx = pool_index if pool_index is not None else item_pool_index(
        pool if pool is not None else seen, seed, item)
    pool_n = idx.count()                      # one scalar
    if pool_n == 0:
        raise ValueError("empty item pool")
    big_p = next_prime(pool_n)
    seen_of = of_users if of_users is not None else seen_items(seen, idx, user, item, listed)
    walk = F.least(F.lit(n) + F.col("_seen") + F.lit(big_p - pool_n), F.lit(big_p)).cast("bigint")
    # phase 1 walks the expected length (n / share of unseen slots, +25% and a
    # margin); phase 2 continues the same permutation, only for users still
    # short of n, up to the exact bound.  Same rows as one full walk.
    share = F.greatest((F.lit(pool_n) - F.col("_seen")) / F.lit(big_p), F.lit(1e-12))
    first_leg = F.least(F.ceil(F.lit(first_leg_scale * n) / share) + first_leg_margin,
                        F.col("_walk")).cast("bigint")
    # the user's permutation constants: hashed once per user, before the walk is exploded
    a = (F.lit(1) + F.pmod(hash_int(f"{seed}|{salt}|a", user), F.lit(big_p - 1))) if big_p > 2 else F.lit(1)
    b = F.pmod(hash_int(f"{seed}|{salt}|b", user), F.lit(big_p))

    def plan(users: DataFrame, *more: str) -> DataFrame:
        return (users.select(user, *more, "_seen", walk.alias("_walk"), a.cast("bigint").alias("_a"), b.cast("bigint").alias("_b"))
                .withColumn("_leg1", first_leg))

    # a null user is one without seen items to the walk's length, and has one leg
    listed_users = plan(seen_of.lists.withColumn("_seen", F.when(F.col(user).isNull(), 0).otherwise(F.size("_items")).cast("bigint")), "_items")

    def unseen(stop: str):
        here = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col(stop) - 1), lambda slot: _permuted(big_p, slot))
        return F.slice(F.filter(here, lambda i: (i < pool_n) & ~F.array_contains("_items", i)), 1, n)

    drawn = listed_users.withColumn("_drawn", unseen("_leg1"))
    short = F.col(user).isNotNull() & (F.size("_drawn") < n) & (F.col("_leg1") < F.col("_walk"))
    drawn = drawn.select(user, F.when(short, unseen("_walk")).otherwise(F.col("_drawn")).alias("_drawn"))
    # outer: the filter that Spark infers for an inner one would draw once more
    firsts = drawn.select(user, F.posexplode_outer("_drawn").alias("_at", "item_idx")).where("item_idx is not null").select(
        user, "item_idx", (F.col("_at") + 1).cast("bigint").alias("neg_rank"))
    if seen_of.sets is not None:
        # users present in `seen` but whose items are all outside the pool are listed
        per_user = (seen_of.hot.join(set_sizes(seen_of.sets, user, "_seen"), user, "left").fillna(0, subset=["_seen"]))
        firsts = firsts.unionByName(_walked(plan(per_user), seen_of.sets, n, big_p, pool_n, user).select(*firsts.columns))
    return firsts.join(idx, "item_idx").select(user, item, "neg_rank")


def _walked(plan: DataFrame, sets: DataFrame, n: int, big_p: int, pool_n: int, user: str) -> DataFrame:
    """``(user, slot, item_idx, neg_rank)``: the draws of users with many seen items, in two legs over rows."""
    w = Window.partitionBy(user).orderBy("slot")

    def walk_range(users: DataFrame, start: str, stop: str) -> DataFrame:
        chunks = (users.withColumn("_chunk", F.explode(F.sequence(
                      F.floor(F.col(start) / CHUNK).cast("bigint"), F.floor((F.col(stop) - 1) / CHUNK).cast("bigint"))))
                  .repartition(user, "_chunk"))      # a hot user's walk is spread over tasks
        slots = (chunks
                 .withColumn("slot", F.explode(F.sequence(
                     F.greatest(F.col("_chunk") * CHUNK, F.col(start)),
                     F.least((F.col("_chunk") + 1) * CHUNK, F.col(stop)) - 1)))
                 .withColumn("item_idx", _permuted(big_p, F.col("slot")))
                 .filter(F.col("item_idx") < pool_n)
                 .select(user, "slot", "item_idx"))
        unseen = without(slots, sets, user, "item_idx")
        return unseen.withColumn("neg_rank", F.row_number().over(w)).filter(F.col("neg_rank") <= n)

    # the first leg (about users * n rows) feeds both the per-user counts and
    # the result: keep it (``reuse``) instead of walking it twice
    leg1 = reuse(walk_range(plan.withColumn("_zero", F.lit(0).cast("bigint")), "_zero", "_leg1"))
    found = leg1.groupBy(user).agg(F.count(F.lit(1)).alias("_found"))
    rest = (plan.join(found, user, "left").fillna(0, subset=["_found"])
            .filter((F.col("_found") < n) & (F.col("_leg1") < F.col("_walk"))))
    leg2 = (walk_range(rest, "_leg1", "_walk").join(rest.select(user, "_found"), user)
            .withColumn("neg_rank", F.col("neg_rank") + F.col("_found"))
            .filter(F.col("neg_rank") <= n).drop("_found"))
    return leg1.unionByName(leg2).withColumn("neg_rank", F.col("neg_rank").cast("bigint"))


def train_test_negatives(seen: DataFrame, n_train: int = 4, n_test: int = 50, seed: int = 42,
                         user: str = "user_id", item: str = "item_id", disjoint: bool = False) -> DataFrame:
    """``(user, item, split, neg_rank)``.

    ``disjoint=False``: independent draws for train and test (J13).
    ``disjoint=True``: one draw of ``n_train + n_test``; the first
    ``n_train`` go to train and the rest to test (J14), so the sets never
    overlap.
    """
    # the pool and the seen items read the pairs: written once
    pairs = written(seen.select(user, item), "pairs")
    idx = item_pool_index(pairs, seed, item)
    of = seen_items(pairs, idx, user, item)
    if disjoint:
        d = sample_negatives(pairs, n_train + n_test, seed, "draw", user=user, item=item, pool_index=idx, of_users=of)
        return d.select(user, item,
                        F.when(F.col("neg_rank") <= n_train, "train").otherwise("test").alias("split"),
                        F.when(F.col("neg_rank") <= n_train, F.col("neg_rank"))
                        .otherwise(F.col("neg_rank") - n_train).alias("neg_rank"))
    tr = sample_negatives(pairs, n_train, seed, "train", user=user, item=item, pool_index=idx, of_users=of)
    te = sample_negatives(pairs, n_test, seed, "test", user=user, item=item, pool_index=idx, of_users=of)
    return (tr.withColumn("split", F.lit("train"))
            .unionByName(te.withColumn("split", F.lit("test")))
            .select(user, item, "split", "neg_rank"))


def underfilled(negatives: DataFrame, users: DataFrame, n: int, user: str = "user_id") -> DataFrame:
    """Users that received fewer than ``n`` negatives, with the count."""
    got = negatives.groupBy(user).agg(F.count(F.lit(1)).alias("n_drawn"))
    return (users.select(user).distinct().join(got, user, "left").fillna(0, subset=["n_drawn"])
            .filter(F.col("n_drawn") < n).withColumn("n_wanted", F.lit(n).cast("bigint")))


def labelled_lists(positives: DataFrame, negatives: DataFrame, user: str = "user_id",
                   item: str = "item_id") -> DataFrame:
    """Each positive followed by its user's negatives.

    Output ``(user, list_item, item, label, pos_in_list)``: the list is keyed
    by (user, positive item); ``pos_in_list`` 0 is the positive (label 1),
    1..n the negatives (label 0) in draw order.  This is the E1 join on user:
    a hot user is split by AQE's skew join (negatives per user are only n).
    """
    pos = positives.select(user, item).distinct()
    first = pos.select(user, F.col(item).alias("list_item"), F.col(item),
                       F.lit(1.0).alias("label"), F.lit(0).cast("bigint").alias("pos_in_list"))
    negs = (pos.select(user, F.col(item).alias("list_item"))
            .join(negatives.select(user, item, "neg_rank"), user)
            .select(user, "list_item", item, F.lit(0.0).alias("label"),
                    F.col("neg_rank").cast("bigint").alias("pos_in_list")))
    return first.unionByName(negs)
