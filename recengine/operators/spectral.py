"""Spectral node embedding by thick-restart block Lanczos.

The leading eigenpairs of the normalised Laplacian ``L = I - D^-1/2 A D^-1/2`` (an isolated node's row is 0).  A node
is one row: its part of the orthonormal basis is one array.  A step multiplies the newest block by ``L`` (arcs and
vectors meet in the cells of a grid, see ``cell_sums``), orthogonalises it twice against the basis and
appends it; the Gram blocks are summed per task, then in ``GRAM_PARTS`` tasks, and reach the driver as small
matrices (basis width x block width, bounded by the parameters).  Rayleigh-Ritz on the basis gives the eigenpairs and,
from the block that was orthogonalised away, their residuals ``||L q - lambda q||``; the iteration stops when the
``k`` leading ones are below ``tol``.  A basis of ``max_basis`` columns is compressed to its leading Ritz vectors.

Every step's table is written to the shared folder and the one before is deleted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recengine.functions.arrow import binary_array, binary_matrix, list_array, list_matrix
from recengine.functions.hashing import hashed_normals
from recengine.operators.graph import both_directions, degrees, undirected
from recengine.session import discard, written

GRAM_PARTS = 16
CELL_NUMBERS, CELLS, OUT_NUMBERS = 1 << 25, 16, 1 << 20


def neighbour_sum(arcs: DataFrame, vectors: DataFrame, name: str = "sum") -> DataFrame:
    """(node, ``name``): sum of the arrays ``vec`` of a node's neighbours; ``arcs`` (node, nbr), one row an arc."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = vectors.select(F.col("node").alias("nbr"), array_to_vector("vec").alias("__x"))
    return arcs.join(v, "nbr").groupBy("node").agg(Summarizer.sum(F.col("__x")).alias("__s")).select("node", vector_to_array("__s").alias(name))


def grid(n_nodes: int, width: int) -> tuple[int, int]:
    """Blocks of sources and of targets: a block of sources has about ``CELL_NUMBERS`` numbers at most, and there are ``CELLS`` cells or more."""
    sources = max(math.isqrt(CELLS), math.ceil(n_nodes * width / CELL_NUMBERS))
    return sources, math.ceil(CELLS / sources)


def cell_sums(arcs: DataFrame, vectors: DataFrame, width: int, cells: tuple[int, int], name: str = "sum") -> DataFrame:
    """(node, ``name``): as ``neighbour_sum`` for arrays of one width.  Arcs are dealt by both ends into a grid of ``cells`` (sources x targets) and a
    source's vector goes to the cells of its row, so a cell adds up its arcs before anything is sent on: a node gets one row a block of sources, not
    one an arc.  A hub's arcs lie in a whole row or column of cells."""
    sources, targets = cells
    kind = dict(arcs.dtypes)["node"]
    row = (F.pmod(F.xxhash64("nbr"), F.lit(sources)) * targets).cast("int")
    to = row + F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(targets)).cast("int")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), binary_array(list_matrix(batch.column(1), width))], ["nbr", "vec"])

    own = arcs.where("nbr is not null").select(to.alias("cell"), "nbr", "node", F.lit(None).cast("binary").alias("vec"))
    held = vectors.where("node is not null").select("node", "vec").mapInArrow(packed, f"nbr {kind}, vec binary").select(
        F.explode(F.sequence(row, row + targets - 1)).alias("cell"), "nbr", F.lit(None).cast(kind).alias("node"), "vec")
    # a cell is one partition: by hash several would meet in one, one after the other
    dealt = own.unionByName(held).repartitionById(sources * targets, F.col("cell"))
    parts = dealt.groupBy("cell").applyInArrow(_cell_sum(width, max(1, OUT_NUMBERS // width)), f"node {kind}, vec binary")
    # a group has a row a node and block of sources at most, in all as many numbers as a cell
    groups = F.pmod(F.xxhash64(F.lit(2), "node"), F.lit(sources * sources * targets))
    return parts.groupBy(groups.alias("group")).applyInArrow(_added(width, name), f"node {kind}, `{name}` array<double>")


def _added(width: int, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, vecs = [], []
        for batch in batches:
            nodes.append(batch.column(batch.schema.get_field_index("node")))
            vecs.append(binary_matrix(batch.column(batch.schema.get_field_index("vec")), width))
        coded = pa.chunked_array(nodes).combine_chunks().dictionary_encode("encode")
        at = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(at, kind="stable")
        total = np.add.reduceat(np.concatenate(vecs)[order], np.flatnonzero(np.diff(at[order], prepend=-1)), axis=0)
        step = max(1, OUT_NUMBERS // width)
        for a in range(0, len(total), step):
            yield pa.RecordBatch.from_arrays([coded.dictionary.slice(a, step), list_array(total[a:a + step])], ["node", name])
    return run


def _cell_sum(width: int, step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arcs, ids, vecs = [], [], []
        for batch in batches:
            vec = batch.column(batch.schema.get_field_index("vec"))
            b = batch.select(["nbr", "node"])
            arcs.append(b.filter(vec.is_null()))
            if vec.null_count < len(vec):
                ids.append(b.column(0).filter(vec.is_valid()))
                vecs.append(binary_matrix(vec, width))
        arcs = pa.Table.from_batches(arcs)
        if not vecs or not arcs.num_rows:
            return
        known = pa.chunked_array(ids).combine_chunks()
        own = known.unique()
        x = np.concatenate(vecs)
        vecs.clear()
        if len(own) < len(known):                       # an id with several vectors: their sum
            several, x = x, np.zeros((len(own), width))
            np.add.at(x, pc.index_in(known, own).to_numpy(), several)
        at = pc.index_in(arcs.column("nbr"), own)
        arcs = arcs.filter(at.is_valid())
        if not arcs.num_rows:
            return
        at = at.drop_null().to_numpy()
        coded = arcs.column("node").combine_chunks().dictionary_encode("encode")
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        at, code = at[order], code[order]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        for a in range(0, len(at), step):
            first, last = np.searchsorted(starts, [a, a + step])
            cuts = starts[first:last] - a
            inside = np.r_[0, cuts] if not len(cuts) or cuts[0] else cuts       # a node's arcs may lie in several steps
            nodes = code[inside + a]
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(nodes)), binary_array(np.add.reduceat(x[at[a:a + step]], inside, axis=0))], ["node", "vec"])
    return run


def _scales(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, scale: D^-1/2, 0 for a node without edges."""
    root = F.when(F.col("degree") > 0, 1 / F.sqrt("degree")).otherwise(0.0)
    return degrees(nodes.select("node").distinct(), edges).select("node", root.alias("scale"))


def laplacian_times(graph: DataFrame, arcs: DataFrame, x: Column, width: int, cells: tuple[int, int]) -> DataFrame:
    """``graph`` (node, scale = D^-1/2 or 0, ...) with ``lx``: ``L x`` for the arrays ``x``, an expression of its columns."""
    scaled = graph.where("scale > 0").select("node", F.transform(x, lambda v: v * F.col("scale")).alias("vec"))
    sums = cell_sums(arcs, scaled, width, cells, "__near")
    lx = F.zip_with(x, "__near", lambda v, s: v - s * F.col("scale"))
    # a node without arcs has a row of zeros; a null one has no row
    return graph.where("node is not null").join(sums, "node", "left").withColumn("lx", F.coalesce(lx, F.transform(x, lambda v: F.lit(0.0)))).drop("__near")


def summed_matrices(df: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum of a small matrix (its shape the same for all) over the Arrow batches: per task, in ``GRAM_PARTS`` tasks, on the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([list(total.shape)], pa.list_(pa.int32()))], ["m", "shape"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shape = None, None
        for batch in batches:
            for m, shape in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total = np.frombuffer(m) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([shape], pa.list_(pa.int32()))], ["m", "shape"])

    rows = df.mapInArrow(run, "m binary, shape array<int>").repartition(GRAM_PARTS).mapInArrow(added, "m binary, shape array<int>").collect()
    return sum(np.frombuffer(r.m).reshape(r.shape) for r in rows) if rows else None


@dataclass
class Spectrum:
    """vectors (node, vec: the unit eigenvectors' entries), eigenvalues (descending), the residual of each, and the steps taken."""
    vectors: DataFrame
    values: np.ndarray
    residuals: np.ndarray
    steps: int


def leading_eigenpairs(nodes: DataFrame, edges: DataFrame, k: int, tol: float = 1e-3, block: int | None = None,
                       max_basis: int | None = None, max_steps: int = 60, seed: int = 42) -> Spectrum:
    """The ``k`` largest eigenvalues of the normalised Laplacian and their vectors.  Stops at ``tol``, when the basis cannot grow
    (then exact), or after ``max_steps`` blocks; the residuals tell which."""
    block = block or k + max(8, k // 4)
    max_basis = max(max_basis or 8 * block, k + 2 * block)
    edges = undirected(edges)
    arcs = written(both_directions(edges), "arcs")
    scale = _scales(nodes, edges)
    n_nodes = scale.count()
    table = written(scale.withColumn("basis", hashed_normals(seed, block, F.col("node"))), "lanczos")

    def basis(batch: pa.RecordBatch) -> np.ndarray:
        return list_matrix(batch.column(0))

    gram = summed_matrices(table.select("basis"), lambda b: basis(b).T @ basis(b))
    if gram is None:
        return Spectrum(table.select("node", F.col("basis").alias("vec")), np.zeros(0), np.zeros(0), 0)
    first = _inverse_root(gram)
    table = _rewritten(table, table.select("node", "scale", "basis"), lambda q, w: q @ first)
    width = new = first.shape[1]
    h = np.zeros((0, 0))
    for step in range(1, max_steps + 1):
        newest = F.slice("basis", width - new + 1, new)
        wide = written(laplacian_times(table, arcs, newest, new, grid(n_nodes, new)).select("node", "scale", "basis", "lx"), "laplacian")
        first_pass = summed_matrices(wide.select("basis", "lx"), lambda b: basis(b).T @ list_matrix(b.column(1)))

        def again(b: pa.RecordBatch, g: np.ndarray = first_pass) -> np.ndarray:
            q = basis(b)
            left = list_matrix(b.column(1)) - q @ g
            return np.concatenate([q, left], 1).T @ left

        both = summed_matrices(wide.select("basis", "lx"), again)
        second, rest = both[:width], both[width:] - both[:width].T @ both[:width]
        column = first_pass + second
        grown = np.zeros((width, width))
        grown[:len(h), :len(h)] = h
        grown[:, width - new:] = column
        grown[width - new:, :width - new] = column[:width - new].T
        h = (grown + grown.T) / 2
        values, s = np.linalg.eigh(h)
        values, s = values[::-1], s[:, ::-1]
        some = min(k, width)
        # L y - value y = (the block left over) times the last rows of s
        tail = s[width - new:, :some]
        residuals = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", tail, rest, tail), 0))
        root = _inverse_root(rest, 1e-10)
        enough = width >= k and residuals.max() <= tol
        if enough or not root.shape[1] or step == max_steps:
            y = s[:, :some]
            out = _rewritten(table, wide.select("node", "scale", "basis"), lambda q, w: q @ y)
            discard(wide)
            discard(arcs)
            return Spectrum(out.select("node", F.col("basis").alias("vec")), values[:some], residuals, step)
        new = root.shape[1]
        keep = s[:, :k + block] if width + new > max_basis else None
        if keep is not None:
            h = np.diag(values[:keep.shape[1]])

        def appended(q: np.ndarray, w: np.ndarray, g: np.ndarray = column, keep: np.ndarray | None = keep, root: np.ndarray = root) -> np.ndarray:
            return np.concatenate([q if keep is None else q @ keep, (w - q @ g) @ root], 1)

        table = _rewritten(table, wide.select("node", "scale", "basis", "lx"), appended)
        discard(wide)
        width = (width if keep is None else keep.shape[1]) + new
    raise AssertionError("unreachable")


def _inverse_root(gram: np.ndarray, least: float = 1e-12) -> np.ndarray:
    """Columns that make a block with this Gram matrix orthonormal; directions of (nearly) no length go."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    kept = values > least * max(1.0, values.max(initial=0.0))
    return vectors[:, kept] / np.sqrt(values[kept])


def _rewritten(old: DataFrame, rows: DataFrame, of: Callable[[np.ndarray, np.ndarray | None], np.ndarray]) -> DataFrame:
    """The step's table with its basis replaced by ``of(basis, lx)``; the table before is deleted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = list_matrix(batch.column(3)) if batch.num_columns > 3 else None
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), list_array(of(list_matrix(batch.column(2)), w))], ["node", "scale", "basis"])

    kind = dict(rows.dtypes)["node"]
    out = written(rows.mapInArrow(run, f"node {kind}, scale double, basis array<double>"), "lanczos")
    discard(old)
    return out


def scaled(found: Spectrum) -> DataFrame:
    """(node, vec): the eigenvectors' entries, each times the root of its eigenvalue."""
    root = F.array(*[F.lit(float(v)) for v in np.sqrt(np.maximum(found.values, 0))])
    return found.vectors.select("node", F.zip_with("vec", root, lambda x, r: x * r).alias("vec"))


def spectral_embedding(nodes: DataFrame, edges: DataFrame, k: int, **options) -> DataFrame:
    """M5: (node, vec): ``k`` leading eigenvectors of the Laplacian, scaled."""
    return scaled(leading_eigenpairs(nodes, edges, k, **options))


def largest_residual(found: Spectrum, nodes: DataFrame, edges: DataFrame) -> tuple[float, float]:
    """Computed anew from the vectors: the largest ``||L q - lambda q||`` and the largest error of ``Q^T Q``."""
    edges = undirected(edges)
    graph = _scales(nodes, edges).join(found.vectors, "node")
    values = found.values
    lx = laplacian_times(graph, both_directions(edges), F.col("vec"), len(values), grid(found.vectors.count(), len(values)))

    def of(batch: pa.RecordBatch) -> np.ndarray:
        q, w = list_matrix(batch.column(0)), list_matrix(batch.column(1))
        return np.concatenate([((w - q * values) ** 2).sum(0)[None], q.T @ q])

    both = summed_matrices(lx.select("vec", "lx"), of)
    return float(np.sqrt(both[0].max())), float(np.abs(both[1:] - np.eye(len(values))).max())
