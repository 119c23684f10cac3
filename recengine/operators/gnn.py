"""Graph attention and graph convolution with given weights.

Features are whole arrays, one row per node; arcs ``(src, dst)`` carry messages from src to dst.  An attention layer
reads the arcs once: each task folds the messages it meets into one state per target and head -- the running maximum
of the scores, the sum of ``exp(score - maximum)`` and the vectors weighted by it -- and states are merged the same
way, so a target with a third of all arcs is a few states per task, never a group.  A softmax over the arcs, its
denominators and the weighted sum need no second pass.

Numpy runs inside tasks; weights are small arrays that travel with the plan.  An absent feature vector is an error of the
caller (``graph.node_features`` fills zeros in).  Nodes without incoming arcs get the skip term and the bias alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recengine.functions.arrow import list_array, list_matrix
from recengine.operators.spectral import cell_sums, grid
from recengine.session import written

# arcs of one cell of a convolution, about
CELL_ARCS = 1 << 22


@dataclass(frozen=True)
class Attention:
    """Weights of a layer: ``w`` (in, heads * out), ``a_src`` and ``a_dst`` (heads, out), ``skip`` (in, heads * out), 'identity'
    (in = out) or None, ``bias``; heads are concatenated or averaged."""
    w: np.ndarray
    a_src: np.ndarray
    a_dst: np.ndarray
    skip: np.ndarray | str | None = None
    bias: np.ndarray | None = None
    concat: bool = True
    activation: str | None = "elu"
    slope: float = 0.2

    @property
    def heads(self) -> int:
        return self.a_src.shape[0]

    @property
    def out(self) -> int:
        return self.a_src.shape[1]


def _projected(features: DataFrame, layer: Attention) -> DataFrame:
    """node, h (heads * out), s_src, s_dst (one number a head)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h = list_matrix(batch.column(1)) @ layer.w
                by_head = h.reshape(len(h), layer.heads, layer.out)
                yield pa.RecordBatch.from_arrays([batch.column(0), list_array(h), list_array((by_head * layer.a_src).sum(2)),
                                                  list_array((by_head * layer.a_dst).sum(2))], ["node", "h", "s_src", "s_dst"])

    kind = dict(features.dtypes)["node"]
    return features.select("node", "vec").mapInArrow(run, f"node {kind}, h array<double>, s_src array<double>, s_dst array<double>")


def leaky(x: np.ndarray, slope: float) -> np.ndarray:
    return np.where(x > 0, x, slope * x)


def fold(top: np.ndarray, total: np.ndarray, mixed: np.ndarray | None, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Merge runs of states: maxima (rows, heads), sums (rows, heads), weighted vectors (rows, heads, out); a run begins at each start."""
    high = np.maximum.reduceat(top, starts)
    scale = np.exp(top - np.repeat(high, np.diff(np.append(starts, len(top))), axis=0))
    return (high, np.add.reduceat(total * scale, starts), None if mixed is None else np.add.reduceat(mixed * scale[:, :, None], starts))


def _runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts equal nodes together, and where each begins."""
    codes = column.dictionary_encode().indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    return order, np.flatnonzero(np.diff(codes[order], prepend=-1))


def attention_states(arcs: DataFrame, projected: DataFrame, layer: Attention, vectors: bool = True) -> DataFrame:
    """node, top, total (one number a head) and, with ``vectors``, mixed (heads * out) of every target."""
    heads, out = layer.heads, layer.out

    def states(node: pa.Array, top, total, mixed) -> pa.RecordBatch:
        flat = np.zeros((len(top), 0)) if mixed is None else mixed.reshape(len(top), heads * out)
        return pa.RecordBatch.from_arrays([node, list_array(top), list_array(total), list_array(flat)], ["node", "top", "total", "mixed"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order, starts = _runs(batch.column(0))
                e = leaky(list_matrix(batch.column(1)) + list_matrix(batch.column(2)), layer.slope)[order]
                mixed = list_matrix(batch.column(3)).reshape(len(e), heads, out)[order] if vectors else None
                yield states(batch.column(0).take(pa.array(order[starts])), *fold(e, np.ones_like(e), mixed, starts))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted states: what a batch ends with waits for the next one."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            node = batch.column(0)
            starts = np.flatnonzero(np.concatenate([[True], node.slice(1).to_numpy(zero_copy_only=False) != node.slice(0, len(node) - 1).to_numpy(zero_copy_only=False)]))
            mixed = list_matrix(batch.column(3), heads * out).reshape(len(node), heads, out) if vectors else None
            done = states(node.take(pa.array(starts)), *fold(list_matrix(batch.column(1)), list_matrix(batch.column(2)), mixed, starts))
            held = done.slice(len(starts) - 1)
            yield done.slice(0, len(starts) - 1)
        if held is not None:
            yield held

    kind = dict(projected.dtypes)["node"]
    schema = f"node {kind}, top array<double>, total array<double>, mixed array<double>"
    met = (arcs.join(projected.select(F.col("node").alias("src"), "s_src", "h"), "src")
           .join(projected.select(F.col("node").alias("dst"), "s_dst"), "dst").select("dst", "s_src", "s_dst", "h"))
    return met.mapInArrow(first, schema).repartition("node").sortWithinPartitions("node").mapInArrow(merged, schema)


def attention_coefficients(arcs: DataFrame, features: DataFrame, layer: Attention) -> DataFrame:
    """M7: (src, dst, alpha): a number a head, the softmax over the arcs into dst."""
    projected = _projected(features, layer)
    states = attention_states(arcs, projected, layer, vectors=False)
    met = (arcs.join(projected.select(F.col("node").alias("src"), "s_src"), "src").join(projected.select(F.col("node").alias("dst"), "s_dst"), "dst")
           .join(states.select(F.col("node").alias("dst"), "top", "total"), "dst"))
    e = F.zip_with("s_src", "s_dst", lambda a, b: F.when(a + b > 0, a + b).otherwise((a + b) * layer.slope))
    shifted = F.transform(F.zip_with(e, "top", lambda x, t: x - t), F.exp)
    return met.select("src", "dst", F.zip_with(shifted, "total", lambda x, t: x / t).alias("alpha"))


def attention_layer(arcs: DataFrame, features: DataFrame, layer: Attention) -> DataFrame:
    """M8: (node, vec): heads' weighted neighbour sums plus skip, concatenated or averaged, plus bias, then ELU."""
    heads, out = layer.heads, layer.out

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = list_matrix(batch.column(1))
            total, mixed = list_matrix(batch.column(2), heads), list_matrix(batch.column(3), heads * out).reshape(-1, heads, out)
            y = np.divide(mixed, total[:, :, None], out=np.zeros_like(mixed), where=total[:, :, None] > 0)
            if isinstance(layer.skip, str):
                y = y + x[:, None, :]
            elif layer.skip is not None:
                y = y + (x @ layer.skip).reshape(y.shape)
            y = y.reshape(len(y), heads * out) if layer.concat else y.mean(1)
            if layer.bias is not None:
                y = y + layer.bias
            if layer.activation == "elu":
                y = np.where(y > 0, y, np.expm1(np.minimum(y, 0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(y)], ["node", "vec"])

    def zeros(n: int) -> Column:
        return F.array_repeat(F.lit(0.0), F.lit(n))

    states = attention_states(arcs, _projected(features, layer), layer)
    both = features.select("node", F.col("vec").cast("array<double>").alias("vec")).join(states, "node", "left").select(
        "node", "vec", F.coalesce("total", zeros(heads)).alias("total"), F.coalesce("mixed", zeros(heads * out)).alias("mixed"))
    return both.mapInArrow(finish, f"node {dict(features.dtypes)['node']}, vec array<double>")


def convolution_layer(arcs: DataFrame, features: DataFrame, w: np.ndarray | None = None, bias: np.ndarray | None = None,
                      activation: str | None = "relu") -> DataFrame:
    """M9: (node, vec): ``D~^-1/2 (A + I) D~^-1/2 X W + b``, then ReLU, log-softmax or nothing.  ``arcs`` (node, nbr) hold both
    directions; ``X W`` is taken first where it is the narrower side's."""
    kind = dict(features.dtypes)["node"]

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), list_array(list_matrix(batch.column(1)) @ w)], ["node", "vec"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = list_matrix(batch.column(1))
            if bias is not None:
                y = y + bias
            if activation == "relu":
                y = np.maximum(y, 0)
            elif activation == "log_softmax":
                y = y - y.max(1, keepdims=True)
                y = y - np.log(np.exp(y).sum(1, keepdims=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(y)], ["node", "vec"])

    x = features.select("node", F.col("vec").cast("array<double>").alias("vec"))
    if w is not None:
        x = x.mapInArrow(times, f"node {kind}, vec array<double>")
    degree = arcs.groupBy("node").agg((F.count(F.lit(1)) + 1).alias("d"))
    scaled = written(x.join(degree, "node", "left").withColumn("scale", 1 / F.sqrt(F.coalesce("d", F.lit(1))))
                     .select("node", "scale", F.transform("vec", lambda v: v * F.col("scale")).alias("vec"), (F.coalesce("d", F.lit(1)) - 1).alias("d")), "scaled")
    n, width, n_arcs = scaled.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.sum("d")).first()
    # arcs are added up in cells of sources and targets: no vector is sent for an arc
    sources, targets = grid(n, width or 1)
    near = cell_sums(arcs, scaled.select("node", "vec"), width or 1, (sources, max(targets, -(-(n_arcs or 0) // (sources * CELL_ARCS)))), "near")
    whole = F.coalesce(F.zip_with("vec", "near", lambda a, b: a + b), F.col("vec"))
    out = scaled.join(near, "node", "left").select("node", F.transform(whole, lambda v: v * F.col("scale")).alias("vec"))
    return out if bias is None and activation is None else out.mapInArrow(finish, f"node {kind}, vec array<double>")
