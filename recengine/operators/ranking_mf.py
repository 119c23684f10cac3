"""Ranking factorisation by stratified block SGD.

Pairwise ranking loss: for a user ``u``, an item ``i`` the user has and an item ``j`` the user has not, the loss is
``-log sigmoid(u . (i - j) + b_i - b_j)`` with an L2 penalty.  Users and items are dealt into ``P`` blocks each.  In
stratum ``s`` task ``p`` holds user block ``p`` and item block ``(p + s) mod P``, so no two tasks of a stratum share a
factor and each runs plain SGD on its own; ``P`` strata make an epoch.  ``j`` is drawn from the items that the task
holds and is redrawn while it is among the user's items there.

An id with more than ``1 / (4 P)`` of the interactions (at most ``4 P`` of each kind) is hot: every task of a stratum
gets a copy of its factors, its interactions are dealt evenly over tasks and strata, and the copies are averaged by
the updates they have had.  (Of a hot user's items a task then knows a part, so ``j`` can be one of the others.)
``P`` grows until a block has at most ``BLOCK_IDS`` ids and a cell about ``CELL_ROWS`` interactions, which bounds a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recengine.functions.arrow import list_array, list_matrix
from recengine.functions.hashing import hashed_normals
from recengine.session import discard, written

BLOCK_IDS, CELL_ROWS, LEAST_BLOCKS, BATCH = 200_000, 5_000_000, 4, 256
USER, ITEM, PAIR = 0, 1, 2


def blocks_for(n_users: int, n_items: int, n_rows: int) -> int:
    return max(LEAST_BLOCKS, math.ceil(max(n_users, n_items) / BLOCK_IDS), math.ceil(math.sqrt(n_rows / CELL_ROWS)))


@dataclass
class RankingModel:
    """users and items: (id, vec); an item's last number is its bias, a user's is 1."""
    users: DataFrame
    items: DataFrame
    losses: list[float]

    def score(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with ``score`` (0 for an unknown user or item)."""
        u = self.users.select(F.col("id").alias("__u"), F.col("vec").alias("__uv"))
        i = self.items.select(F.col("id").alias("__i"), F.col("vec").alias("__iv"))
        dot = F.aggregate(F.zip_with("__uv", "__iv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return (pairs.join(u, F.col("user_id") == F.col("__u"), "left").join(i, F.col("item_id") == F.col("__i"), "left")
                .withColumn("score", F.coalesce(dot, F.lit(0.0))).drop("__u", "__i", "__uv", "__iv"))


def sgd(users: np.ndarray, items: np.ndarray, u: np.ndarray, i: np.ndarray, rng: np.random.Generator, rate: float, reg: float) -> float:
    """One pass over the pairs (positions u, i) in random order, by small batches; factors change in place.  The loss' sum."""
    if len(items) < 2 or not len(u):
        return 0.0
    held = np.unique(u * np.int64(len(items)) + i)
    order, loss = rng.permutation(len(u)), 0.0
    for a in range(0, len(order), BATCH):
        at = order[a:a + BATCH]
        uu, ii = u[at], i[at]
        jj = rng.integers(0, len(items), len(at))
        for _ in range(8):
            code = uu * np.int64(len(items)) + jj
            own = held[np.minimum(np.searchsorted(held, code), len(held) - 1)] == code
            if not own.any():
                break
            jj[own] = rng.integers(0, len(items), int(own.sum()))
        else:
            uu, ii, jj = uu[~own], ii[~own], jj[~own]
        vu, vi, vj = users[uu], items[ii], items[jj]
        x = np.clip((vu * (vi - vj)).sum(1), -30, 30)
        g = (1 / (1 + np.exp(x)))[:, None]
        loss += float(np.log1p(np.exp(-x)).sum())
        step = rate * (g * (vi - vj) - reg * vu)
        step[:, -1] = 0             # a user's last number stays 1
        np.add.at(users, uu, step)
        np.add.at(items, ii, rate * (g * vu - reg * vi))
        np.add.at(items, jj, rate * (-g * vu - reg * vj))
    return loss


_CELL = "task int, kind int, id long, other long, vec array<double>, hot boolean"
_OUT = "kind int, id long, vec array<double>, hot boolean, n double, loss double"


def _cell(width: int, seed: int, rate: float, reg: float) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        rng = np.random.default_rng([seed, key[0].as_py()])
        ids, vecs, hots = {}, {}, {}
        for k in (USER, ITEM):
            own = table.take(pa.array(np.flatnonzero(kind == k))).sort_by("id").combine_chunks()
            ids[k], hots[k] = own.column("id").to_numpy(), own.column("hot")
            vecs[k] = np.vstack([list_matrix(c, width) for c in own.column("vec").chunks] or [np.empty((0, width))])
        pairs = table.take(pa.array(np.flatnonzero(kind == PAIR))).sort_by([("id", "ascending"), ("other", "ascending")])
        u, i = (np.searchsorted(ids[k], pairs.column(c).to_numpy()) for k, c in ((USER, "id"), (ITEM, "other")))
        loss = sgd(vecs[USER], vecs[ITEM], u, i, rng, rate, reg)
        n = {USER: np.bincount(u, minlength=len(ids[USER])), ITEM: np.bincount(i, minlength=len(ids[ITEM]))}
        out = []
        for k in (USER, ITEM):
            lost = np.zeros(len(ids[k]))
            if k == ITEM and len(lost):
                lost[0] = loss
            out.append(pa.table({"kind": pa.array(np.full(len(ids[k]), k, np.int32)), "id": ids[k], "vec": list_array(vecs[k]), "hot": hots[k],
                                 "n": n[k].astype(float), "loss": lost}))
        return pa.concat_tables(out)
    return run


def fit_ranking(interactions: DataFrame, rank: int = 16, epochs: int = 5, rate: float = 0.1, reg: float = 0.01, seed: int = 42,
                blocks: int | None = None, hot_share: float | None = None) -> RankingModel:
    """Fit on the distinct (user_id, item_id) of ``interactions``; rows without one of them are left out."""
    pairs = written(interactions.select(F.col("user_id").cast("bigint").alias("u"), F.col("item_id").cast("bigint").alias("i"))
                    .where("u is not null and i is not null").distinct(), "pairs")
    counts = written(pairs.select(F.explode(F.array(F.struct(F.lit(USER).alias("kind"), F.col("u").alias("id")),
                                                    F.struct(F.lit(ITEM).alias("kind"), F.col("i").alias("id")))).alias("x"))
                     .groupBy("x.kind", "x.id").agg(F.count(F.lit(1)).alias("n")), "counts")
    sizes = {r.kind: (r.ids, r.n) for r in counts.groupBy("kind").agg(F.count(F.lit(1)).alias("ids"), F.sum("n").alias("n")).collect()}
    n_rows = sizes.get(USER, (0, 0))[1]
    p = blocks or blocks_for(sizes.get(USER, (0, 0))[0], sizes.get(ITEM, (0, 0))[0], n_rows)
    bar = n_rows * (hot_share if hot_share is not None else 1 / (4 * p))
    width = rank + 1
    start = F.concat(hashed_normals(seed, rank, F.col("kind"), F.col("id"), spread=0.1), F.array((F.col("kind") == USER).cast("double")))
    # from the id alone, so that a stratum's factors need not meet the table before
    block = F.pmod(F.xxhash64(F.lit(seed), "kind", "id"), F.lit(p)).cast("int")
    table = kept = written(counts.select("kind", "id", (F.col("n") > bar).alias("hot"), block.alias("block"), start.alias("vec")), "factors")
    side = {k: table.where(F.col("kind") == k).select(F.col("id").alias(c), F.col("block").alias(f"{c}_block"), F.col("hot").alias(f"{c}_hot"))
            for k, c in ((USER, "u"), (ITEM, "i"))}

    def drawn(salt: int):
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "u", "i"), F.lit(p)).cast("int")

    def mod(x):
        return F.pmod(x, F.lit(p))

    stratum = F.when(F.col("u_hot") | F.col("i_hot"), drawn(1)).otherwise(mod(F.col("i_block") - F.col("u_block")))
    task = F.when(F.col("u_hot") & F.col("i_hot"), drawn(2)).when(F.col("u_hot"), mod(F.col("i_block") - F.col("stratum"))).otherwise(F.col("u_block"))
    dealt = written(pairs.join(side[USER], "u").join(side[ITEM], "i").withColumn("stratum", stratum).withColumn("task", task)
                    .select("u", "i", "task", "stratum"), "dealt", partition_by="stratum")
    discard(pairs)
    discard(counts)
    # a cell is one partition (by hash several would meet in one, one after the other), and a pair has an empty list: Spark's Arrow writer
    # goes over a run of null ones again with every row
    empty = F.array().cast("array<double>")
    losses = []
    for epoch in range(epochs):
        lost = 0.0
        for s in range(p):
            # another order of the strata every epoch
            s = (s * (1 if epoch % 2 == 0 else p - 1) + epoch) % p
            home = F.when(F.col("kind") == USER, F.col("block")).otherwise(mod(F.col("block") - s))
            tasks = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(p - 1))).otherwise(F.array(home))
            factors = table.select(F.explode(tasks).alias("task"), "kind", "id", F.lit(None).cast("bigint").alias("other"), "vec", "hot")
            rows = dealt.where(F.col("stratum") == s).select("task", F.lit(PAIR).alias("kind"), F.col("u").alias("id"), F.col("i").alias("other"),
                                                             empty.alias("vec"), F.lit(False).alias("hot"))
            out = written(factors.unionByName(rows).repartitionById(p, F.col("task")).groupBy("task").applyInArrow(_cell(width, seed + 1000 * epoch + s, rate, reg), _OUT), "cells")
            lost += out.agg(F.sum("loss")).first()[0] or 0.0
            discard(kept)
            # the averages are taken where the next stratum reads them
            table, kept = _averaged(out).withColumn("block", block), out
        losses.append(lost / n_rows if n_rows else 0.0)
    discard(dealt)
    if epochs:
        table = written(table, "factors")
        discard(kept)
    return RankingModel(*(table.where(F.col("kind") == k).select("id", "vec") for k in (USER, ITEM)), losses)


def _averaged(cells: DataFrame) -> DataFrame:
    """kind, id, vec, hot: copies of hot factors averaged by their updates."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    hot = (cells.where("hot").groupBy("kind", "id").agg(Summarizer.mean(array_to_vector("vec"), F.col("n") + 1e-9).alias("m"))
           .select("kind", "id", vector_to_array("m").alias("vec"), F.lit(True).alias("hot")))
    return cells.where("not hot").select("kind", "id", "vec", "hot").unionByName(hot)


def pairwise_auc(scored: DataFrame, lists: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """One row: ``auc``, the share of (relevant, other) pairs of each list that the score puts in order (ties half), averaged over
    the lists with both; by the ranks' sum within the list."""
    one = scored.select(*lists, F.col(label).cast("double").alias("y"), F.col(score).alias("s"))
    per = one.groupBy(*lists, "s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    from pyspark.sql import Window
    below = Window.partitionBy(*lists).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    right = per.withColumn("right", F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0.0)) + F.col("neg") / 2))
    return (right.groupBy(*lists).agg(F.sum("right").alias("r"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).where("p > 0 and n > 0")
            .agg(F.avg(F.col("r") / (F.col("p") * F.col("n"))).alias("auc")))
