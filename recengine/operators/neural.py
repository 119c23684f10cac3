"""Neural pair scorers trained by Spark.

A scorer joins two branches and optional side vectors in one logistic output::

    gmf = u_gmf * i_gmf                      (factor_num wide)
    mlp = ReLU layers over [u_mlp, i_mlp]    (layers[0] / 2 wide each)
    p   = sigmoid(w . [mlp, gmf, side] + b)

The embeddings are one row per id in a Parquet table, the tower is a small flat array on the driver.  One step is one
mini-batch over the whole cluster: the batch's samples meet their two embeddings in equi-joins, every task runs
the forward and backward pass in numpy, adds up the gradients of its ids and of the tower, and hands on one row for
every id it has met in about ``HELD`` samples and one for the tower.  One shuffle brings them to the states of their ids,
where they are added up; only ids that a batch met are updated (Adam with a step count per id).  The tower's gradients
come to the driver in at most ``TOWER_PARTS`` rows.

Equal samples (a user's negatives stand in each of the user's lists) are one row with a weight, which multiplies the
gradient.  Side vectors are kept by id (``id_sides``) and meet the samples where the embeddings do.  Embeddings and
gradients are stored in single precision, in which the reference trains, and computed with in double.

No embedding table is ever held in one task or on the driver, and a hot id costs a task one row per ``HELD`` samples.
Each step's tables are written to the shared folder, so lost executors cost the current step at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recengine.functions.arrow import list_array, list_matrix
from recengine.functions.hashing import hashed_normals
from recengine.session import discard, written

TOWER_PARTS = 64
HELD = 100_000          # samples whose gradients a task adds up before it hands them on
LAYERS = (32, 16, 8)
FACTORS = 8

# model name -> (GMF branch, MLP branch, side parts)
SCORERS: dict[str, tuple[bool, bool, tuple[str, ...]]] = {
    "gmf": (True, False, ()),
    "mlp": (False, True, ()),
    "neumf": (True, True, ()),
    "bertmf": (True, True, ("text",)),
    "graphmf": (True, True, ("graph",)),
    "multimf": (True, True, ("text", "graph")),
}


@dataclass(frozen=True)
class Shape:
    """Widths of a scorer.  ``layers[0]`` is twice the width of an MLP embedding; empty layers switch the branch off, as does
    ``factors=0`` for GMF."""
    factors: int = FACTORS
    layers: tuple[int, ...] = LAYERS
    side: int = 0

    @property
    def embedding(self) -> int:
        return self.factors + (self.layers[0] // 2 if self.layers else 0)

    @property
    def tower(self) -> list[tuple[int, int]]:
        """(in, out) of the fully connected layers, the logistic output last."""
        last = self.layers[-1] if self.layers else 0
        return [*zip(self.layers, self.layers[1:]), (last + self.factors + self.side, 1)]

    @property
    def n_tower(self) -> int:
        return sum((a + 1) * b for a, b in self.tower)


def shape_of(model: str, factors: int = FACTORS, layers: Sequence[int] = LAYERS, text: int = 0, graph: int = 0,
             use_item_embedding: bool = True) -> Shape:
    """The widths behind a model name.  ``graph`` is the width of one node's vector: the user's alone, or user and item."""
    gmf, mlp, parts = SCORERS[model]
    side = ("text" in parts) * text + ("graph" in parts) * graph * (2 if use_item_embedding else 1)
    return Shape(factors if gmf else 0, tuple(layers) if mlp else (), side)


class Tower:
    """The fully connected layers and the logistic output over one flat array."""

    def __init__(self, shape: Shape, flat: np.ndarray) -> None:
        self.shape, self.flat, self.grad = shape, flat, np.zeros_like(flat)
        self.weights, self.d_weights, at = [], [], 0
        for a, b in shape.tower:
            for of, out in ((flat, self.weights), (self.grad, self.d_weights)):
                out.append((of[at:at + a * b].reshape(a, b), of[at + a * b:at + (a + 1) * b]))
            at += (a + 1) * b

    @staticmethod
    def start(shape: Shape, seed: int) -> np.ndarray:
        """Xavier-uniform weights, zero biases."""
        rng, parts = np.random.default_rng(seed), []
        for a, b in shape.tower:
            bound = np.sqrt(6 / (a + b))
            parts += [rng.uniform(-bound, bound, a * b), np.zeros(b)]
        return np.concatenate(parts)

    def run(self, u: np.ndarray, i: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Probabilities, and the inputs of every layer."""
        f = self.shape.factors
        x, inputs = np.concatenate([u[:, f:], i[:, f:]], 1), []
        for w, b in self.weights[:-1]:
            inputs.append(x)
            x = np.maximum(x @ w + b, 0)
        x = np.concatenate([x, u[:, :f] * i[:, :f], side], 1)
        inputs.append(x)
        w, b = self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)[:, 0])), inputs

    def back(self, u: np.ndarray, i: np.ndarray, side: np.ndarray, label: np.ndarray,
             weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
        """Adds to ``grad``; returns the gradients by u and i and the sum of the cross-entropies, each sample counted ``weight`` times."""
        weight = np.ones(len(label)) if weight is None else weight
        f = self.shape.factors
        p, inputs = self.run(u, i, side)
        near = np.clip(p, 1e-7, 1 - 1e-7)
        loss = -(weight * (label * np.log(near) + (1 - label) * np.log(1 - near))).sum()
        d = (weight * (p - label))[:, None]
        d_u, d_i = np.empty_like(u), np.empty_like(i)
        for k in range(len(self.weights) - 1, -1, -1):
            (w, _), (dw, db) = self.weights[k], self.d_weights[k]
            dw += inputs[k].T @ d
            db += d.sum(0)
            d = d @ w.T
            if k == len(self.weights) - 1:
                last = self.shape.layers[-1] if self.shape.layers else 0
                mixed = d[:, last:last + f]
                d_u[:, :f], d_i[:, :f] = mixed * i[:, :f], mixed * u[:, :f]
                d = d[:, :last] * (inputs[k][:, :last] > 0) if k else d[:, :last]
            elif k:
                d = d * (inputs[k] > 0)
        half = self.shape.embedding - f
        d_u[:, f:], d_i[:, f:] = d[:, :half], d[:, half:]
        return d_u, d_i, float(loss)


def start_embeddings(samples: DataFrame, shape: Shape, seed: int = 42, spread: float = 0.1) -> DataFrame:
    """kind ('u' or 'i'), id, vec, m, v, steps: one row per user and item of the samples."""
    ids = [samples.select(F.lit(k).alias("kind"), F.col(c).cast("bigint").alias("id")).distinct() for k, c in (("u", "user_id"), ("i", "item_id"))]
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.lit(shape.embedding))
    start = hashed_normals(seed, shape.embedding, F.col("kind"), F.col("id"), spread=spread).cast("array<float>")
    return (ids[0].unionByName(ids[1]).where("id is not null")
            .select("kind", "id", start.alias("vec"), zeros.alias("m"),
                    zeros.alias("v"), F.lit(0).cast("bigint").alias("steps")))


@dataclass(frozen=True)
class Sides:
    """What ids bring to a sample's side vector: rows (kind, id, first, rest) and the widths of both arrays by (kind, part).  A
    sample's side is its user's and item's ``first``, then their ``rest``; a missing array is zeros."""
    rows: DataFrame
    widths: dict[tuple[str, str], int]


def weighted(samples: DataFrame) -> DataFrame:
    """The distinct rows of ``samples`` (user_id, item_id, label and, if there, side) with ``weight``, how often each stands there."""
    return (samples.groupBy("user_id", "item_id", "label", *[c for c in samples.columns if c == "side"])
            .agg(F.count(F.lit(1)).alias("weight")))


def _with_embeddings(samples: DataFrame, table: DataFrame, how: str = "inner", sides: Sides | None = None) -> DataFrame:
    """``samples`` with ``__u`` and ``__i`` and, given ``sides`` (``id_sides``), ``side``: embeddings and sides of an id are met in one
    place, so the samples travel once to their users and once to their items, and only the users' sides travel with them."""
    out = samples
    for k, c in (("u", "user_id"), ("i", "item_id")):
        own = table.where(F.col("kind") == k).select(F.col("id").alias(f"__{k}_id"), F.col("vec").alias(f"__{k}"))
        out = out.join(own, F.col(c) == F.col(f"__{k}_id"), how)
        if sides is not None:
            out = _side_of(out, sides, k, c)
    return _as_side(out, sides).drop("__u_id", "__i_id")


def _side_of(samples: DataFrame, sides: Sides, kind: str, key: str) -> DataFrame:
    """``samples`` with the side arrays of their ids.  Never a broadcast: vectors of a few values are many times larger in memory than the
    Parquet files by which Spark would choose one, and the driver would hold them all."""
    own = sides.rows.where(F.col("kind") == kind).select(F.col("id").alias(f"__{kind}_sid"), F.col("first").alias(f"__{kind}_first"), F.col("rest").alias(f"__{kind}_rest"))
    return samples.join(own.hint("merge"), F.col(key) == F.col(f"__{kind}_sid"), "left").drop(f"__{kind}_sid")


def _as_side(met: DataFrame, sides: Sides | None) -> DataFrame:
    if sides is None:
        return met
    parts = [F.coalesce(f"__{k}_{part}", _zeros(sides.widths[k, part])) for part in ("first", "rest") for k in ("u", "i") if sides.widths[k, part]]
    return (met.withColumn("side", F.concat(*parts) if parts else F.array().cast("array<double>"))
            .drop(*[f"__{k}_{part}" for part in ("first", "rest") for k in ("u", "i")]))


def _zeros(width: int) -> Column:
    return F.array_repeat(F.lit(0.0), F.lit(width))


# rows of a step: an id's state (vec, m, v, steps), a part of its gradient (grad, n), or of the tower's (kind 'w': tower, n, loss)
_ROWS = ("kind string, id long, vec array<float>, m array<float>, v array<float>, steps long, grad array<float>, n long, "
         "tower array<double>, loss double")
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
_STATE = ["kind", "id", "vec", "m", "v", "steps"]


def _floats(matrix: np.ndarray) -> pa.Array:
    return list_array(matrix.astype(np.float32))


def _rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
    """``size`` rows with the given columns, the others null."""
    kinds = {"kind": pa.string(), "id": pa.int64(), "steps": pa.int64(), "n": pa.int64(), "tower": pa.list_(pa.float64()), "loss": pa.float64()}
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, kinds.get(c, pa.list_(pa.float32())))) for c in _NAMES], _NAMES)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def _gradients(samples: DataFrame, table: DataFrame, shape: Shape, flat: np.ndarray, sides: Sides | None = None) -> DataFrame:
    """The gradients of one batch in parts: a row for every id that a task has met in about ``HELD`` samples, and a row a task for
    the tower."""
    def added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], kind: str) -> pa.RecordBatch:
        ids, grads, weight = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(ids, kind="stable")
        starts = _runs(ids[order])
        return _rows(len(starts), kind=pa.array([kind] * len(starts)), id=pa.array(ids[order[starts]]), grad=_floats(np.add.reduceat(grads[order], starts)),
                     n=pa.array(np.add.reduceat(weight[order], starts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tower, rows, loss, held, held_rows = Tower(shape, flat), 0, 0.0, {"u": [], "i": []}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            users, items, label, weight = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            u, i, side = list_matrix(batch.column(4), shape.embedding), list_matrix(batch.column(5), shape.embedding), list_matrix(batch.column(6), shape.side)
            d_u, d_i, lost = tower.back(u, i, side, label, weight)
            rows, loss, held_rows = rows + int(weight.sum()), loss + lost, held_rows + len(label)
            held["u"].append((users, d_u, weight))
            held["i"].append((items, d_i, weight))
            if held_rows >= HELD:
                for kind, parts in held.items():
                    yield added(parts, kind)
                held, held_rows = {"u": [], "i": []}, 0
        if held_rows:
            for kind, parts in held.items():
                yield added(parts, kind)
        if rows:
            part = TaskContext.get().partitionId() % TOWER_PARTS
            yield _rows(1, kind=pa.array(["w"]), id=pa.array([part], pa.int64()), tower=list_array(tower.grad[None]), n=pa.array([rows], pa.int64()),
                        loss=pa.array([loss], pa.float64()))

    return _with_embeddings(samples, table, sides=sides).select("user_id", "item_id", "label", "weight", "__u", "__i", "side").mapInArrow(run, _ROWS)


def _adam(vec: np.ndarray, m: np.ndarray, v: np.ndarray, steps: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """In place; ``steps`` is the count of updates including this one (a column)."""
    m += 0.1 * (grad - m)
    v += 0.001 * (grad * grad - v)
    vec -= rate * (m / (1 - 0.9 ** steps)) / (np.sqrt(v / (1 - 0.999 ** steps)) + 1e-8)


def _updated(table: DataFrame, grads: DataFrame, width: int, rate: float) -> DataFrame:
    """The embeddings after a step, and the tower's gradient by parts (kind 'w').  States and parts of gradients come together in one
    shuffle, an id's state first; ids that the batch didn't meet stay as they are."""
    def summed(batch: pa.RecordBatch) -> pa.RecordBatch:
        """One row an id: its state with the sum of its gradients; n is null without any."""
        starts = _runs(batch.column(1).to_numpy())
        n, has = batch.column(7), pc.list_value_length(batch.column(6)).fill_null(0).to_numpy() > 0
        grad = np.zeros((batch.num_rows, width))
        grad[has] = list_matrix(batch.column(6).filter(pa.array(has)), width)
        n = np.add.reduceat(n.fill_null(0).to_numpy(), starts)
        first = batch.take(pa.array(starts))
        return _rows(len(starts), **{c: first.column(k) for k, c in enumerate(_STATE)}, grad=_floats(np.add.reduceat(grad, starts)),
                     n=pa.array(n, pa.int64(), mask=n == 0))

    def stepped(batch: pa.RecordBatch) -> pa.RecordBatch:
        vec, m, v = (list_matrix(batch.column(k), width) for k in (2, 3, 4))
        steps, n = batch.column(5).to_numpy().copy(), batch.column(7).fill_null(0).to_numpy()
        met = np.flatnonzero(n)
        if len(met):
            steps[met] += 1
            own = vec[met], m[met], v[met]
            _adam(*own, steps[met, None], list_matrix(batch.column(6), width)[met] / n[met, None], rate)
            vec[met], m[met], v[met] = own
        return _rows(len(n), kind=batch.column(0), id=batch.column(1), vec=_floats(vec), m=_floats(m), v=_floats(v), steps=pa.array(steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows: the last id of a kind in a batch waits for the next one."""
        held, towers = None, {}
        for batch in batches:
            kinds = batch.column(0).to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(kinds == "w"):
                part, grad, n, loss = (batch.column(c)[int(k)].as_py() for c in (1, 8, 7, 9))
                was = towers.get(part, (0.0, 0, 0.0))
                towers[part] = was[0] + np.array(grad), was[1] + n, was[2] + loss
            for kind in ("i", "u"):
                own = batch.take(pa.array(np.flatnonzero(kinds == kind)))
                if not own.num_rows:
                    continue
                if held is not None and held.column(0)[0].as_py() == kind:
                    own = pa.Table.from_batches([held, own.select(_NAMES)]).combine_chunks().to_batches()[0]
                elif held is not None:
                    yield stepped(held)
                done = summed(own)
                held = done.slice(done.num_rows - 1)
                if done.num_rows > 1:
                    yield stepped(done.slice(0, done.num_rows - 1))
        if held is not None:
            yield stepped(held)
        for part, (grad, n, loss) in towers.items():
            yield _rows(1, kind=pa.array(["w"]), id=pa.array([part], pa.int64()), tower=list_array(grad[None]), n=pa.array([n], pa.int64()),
                        loss=pa.array([loss], pa.float64()))

    # empty lists for missing ones: Spark's Arrow writer goes over a run of null lists again with every row
    both = table.where("kind <> 'w'").unionByName(grads)
    lists = {c: F.when(F.col(c).isNull(), F.array().cast(kind)).otherwise(F.col(c)) for c, kind in both.dtypes if kind.startswith("array")}
    return (both.repartition("kind", "id").sortWithinPartitions("kind", "id", F.col("steps").desc_nulls_last())
            .withColumns(lists).mapInArrow(run, _ROWS))


@dataclass
class Scorer:
    """A fitted scorer: its widths, embeddings (kind, id, vec), tower, and the mean loss of every epoch."""
    shape: Shape
    embeddings: DataFrame
    tower: np.ndarray
    losses: list[float]
    sides: Sides | None = None

    def score(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (user_id, item_id, further columns and, if the scorer has one and was not fitted with ``sides``, ``side``) with
        ``score``; an id without an embedding counts as a zero vector."""
        shape, flat = self.shape, self.tower

        def run(u: pa.Array, i: pa.Array, side: pa.Array) -> pa.Array:
            u, i, side = list_matrix(u, shape.embedding), list_matrix(i, shape.embedding), list_matrix(side, shape.side)
            return pa.array(Tower(shape, flat).run(u, i, side)[0])

        from pyspark.sql.functions import arrow_udf
        zeros = _zeros(shape.embedding).cast("array<float>")
        if "side" not in pairs.columns and self.sides is None:
            pairs = pairs.withColumn("side", F.array().cast("array<double>"))
        met = _with_embeddings(pairs, self.embeddings, "left", self.sides)
        p = arrow_udf(run, "double")(F.coalesce("__u", zeros), F.coalesce("__i", zeros), F.col("side").cast("array<double>"))
        return met.withColumn("score", p).drop("__u", "__i", "side")


def id_sides(parts: Sequence[str], text: DataFrame | None = None, graph: DataFrame | None = None, offset: int = 0,
             widths: tuple[int, int] = (0, 0), use_item_embedding: bool = True) -> Sides | None:
    """The item's text vector first, then the graph vectors; None without parts.  Arguments as in ``with_side``."""
    if not parts:
        return None

    def own(rows: DataFrame | None, kind: str, key: Column, value: str, name: str) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), key.cast("bigint").alias("id"), F.col(value).cast("array<double>").alias(name))

    none = F.lit(None).cast("array<double>")
    items = own(text, "i", F.col("item_id"), "text", "first") if "text" in parts else None
    if "graph" in parts and use_item_embedding:
        nodes = own(graph, "i", F.col("node") - offset, "vec", "rest")
        items = items.join(nodes, ["kind", "id"], "full") if items is not None else nodes.withColumn("first", none)
    elif items is not None:
        items = items.withColumn("rest", none)
    out = [] if items is None else [items.select("kind", "id", "first", "rest")]
    if "graph" in parts:
        out.append(own(graph, "u", F.col("node"), "vec", "rest").select("kind", "id", none.alias("first"), "rest"))
    return Sides(out[0] if len(out) == 1 else out[0].unionByName(out[1]), {
        ("u", "first"): 0, ("i", "first"): ("text" in parts) * widths[0], ("u", "rest"): ("graph" in parts) * widths[1],
        ("i", "rest"): ("graph" in parts and use_item_embedding) * widths[1]})


def with_side(samples: DataFrame, parts: Sequence[str], text: DataFrame | None = None, graph: DataFrame | None = None,
              offset: int = 0, widths: tuple[int, int] = (0, 0), use_item_embedding: bool = True) -> DataFrame:
    """``side``: the item's text vector (item_id, text), then the user's graph vector, then (``use_item_embedding``) the item's.
    ``graph`` (node, vec) numbers items from ``offset`` on; a missing vector is zeros of the given ``widths`` (text, graph)."""
    sides, out = id_sides(parts, text, graph, offset, widths, use_item_embedding), samples
    if sides is None:
        return samples.select(*[F.col(c) for c in samples.columns], F.array().cast("array<double>").alias("side"))
    for kind, key in (("u", "user_id"), ("i", "item_id")):
        out = _side_of(out, sides, kind, key)
    return _as_side(out, sides).select(*samples.columns, "side")


def fit(samples: DataFrame, shape: Shape, epochs: int = 3, batches: int = 4, rate: float = 0.02, seed: int = 42,
        sides: Sides | None = None) -> Scorer:
    """Fit on labelled pairs (user_id, item_id, label and, if ``shape.side``, side, or ``sides`` by id) by binary cross-entropy.
    ``samples`` may have been made distinct with a ``weight`` (``weighted``); else that is done here."""
    if not shape.embedding:
        raise ValueError("a scorer needs a GMF or an MLP branch")
    if "weight" not in samples.columns:
        samples = weighted(samples)
    if sides is not None:
        sides = Sides(written(sides.rows, "sides"), sides.widths)
        side = []
    else:
        side = [(F.col("side") if "side" in samples.columns else F.array()).cast("array<double>").alias("side")]
    dealt = written(samples.select(F.col("user_id").cast("bigint").alias("user_id"), F.col("item_id").cast("bigint").alias("item_id"),
                                   F.col("label").cast("double").alias("label"), "weight", *side,
                                   F.pmod(F.xxhash64(F.lit(seed), "user_id", "item_id", "label"), F.lit(batches)).cast("int").alias("batch"))
                    .where("user_id is not null and item_id is not null and label is not null"), "samples", partition_by="batch")
    nulls = [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in _ROWS.split(", ")[len(_STATE):]]
    table = written(start_embeddings(dealt, shape, seed).select(*_STATE, *nulls), "embeddings")
    flat, losses = Tower.start(shape, seed), []
    m, v, step = np.zeros_like(flat), np.zeros_like(flat), 0
    for _ in range(epochs):
        lost, seen = 0.0, 0
        for batch in range(batches):
            grads = _gradients(dealt.where(F.col("batch") == batch), table, shape, flat, sides)
            after = written(_updated(table, grads, shape.embedding, rate), "embeddings")
            discard(table)
            table = after
            tower = table.where("kind = 'w'").select("tower", "n", "loss").collect()
            n = sum(r.n for r in tower)
            if n:
                step += 1
                _adam(flat, m, v, np.array(step), sum(np.array(r.tower) for r in tower) / n, rate)
                seen, lost = seen + n, lost + sum(r.loss for r in tower)
        losses.append(lost / seen if seen else 0.0)
    discard(dealt)
    return Scorer(shape, table.where("kind <> 'w'").select("kind", "id", "vec"), flat, losses, sides)
