"""JSON arrays in files of any size, read in byte-range splits.

A file holds one array, formatted in any way.  The text scan cuts it at every comma, so Spark's own splits apply, and an
element is a run of consecutive pieces that ends where the depth is 1 outside strings.  What a piece does to that state
is known without what stands before it: the parity of its quotes, and its change of depth for either way it can begin
(in a string or not).  So there are two scans:

1. every split is summed up in one row, and a running sum over a file's splits (one row a split) gives the state at
   the start of each;
2. every split gives its elements; what stands before its first and after its last boundary are fragments, at most two a
   split, which are joined with their neighbours'.

Elements are parsed by ``from_json`` in the JVM.  Strings may hold anything, brackets, commas and escapes included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE, SLASH, COMMA, OPEN, CLOSE = 34, 92, 44, b"[{", b"]}"
WHOLE, HEAD, TAIL, THROUGH = 0, 1, 2, 3


def _effects(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For every byte the quotes so far (inclusive) and the change of depth, whatever the start."""
    b = np.frombuffer(raw, np.uint8)
    slash = b == SLASH
    # a quote after an odd number of backslashes is a character of the string
    at = np.arange(len(b))
    run_start = np.maximum.accumulate(np.where(slash, -1, at)) if len(b) else at
    escaped = np.zeros(len(b), bool)
    escaped[1:] = ((at - run_start)[:-1] % 2 == 1) & slash[:-1]
    quotes = np.cumsum((b == QUOTE) & ~escaped)
    depth = np.isin(b, np.frombuffer(OPEN, np.uint8)).astype(np.int64) - np.isin(b, np.frombuffer(CLOSE, np.uint8))
    return quotes, depth


def _joined(values: pa.Array) -> bytes:
    return b",".join(values.cast(pa.binary()).to_pylist()) + b","


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, start, pieces) for each run of one split's pieces."""
    files, starts = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
    change = (np.diff(starts) != 0) | (np.diff(files.indices.to_numpy()) != 0)
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield files[a].as_py(), int(starts[a]), batch.column(0).slice(a, b - a)


_SUMS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("quotes", pa.int64()), ("outside", pa.int64()), ("inside", pa.int64())])


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run of a batch: quotes, and the change of depth where their parity, counted from the split's start, is even and odd."""
    file, start, parity = None, None, 0
    for batch in batches:
        rows = []
        for f, s, pieces in _runs(batch):
            if (f, s) != (file, start):
                file, start, parity = f, s, 0
            quotes, depth = _effects(_joined(pieces))
            odd = (quotes + parity) % 2 == 1
            n = int(quotes[-1])
            rows.append((f, s, n, int(depth[~odd].sum()), int(depth[odd].sum())))
            parity = (parity + n) % 2
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows), _SUMS)], schema=_SUMS)


_PARTS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("k", pa.int64()), ("kind", pa.int32()), ("element", pa.string())])


class _Splitter:
    """Cuts one split's pieces into elements, batch by batch; what is left open waits for the next batch."""

    def __init__(self, file: str, start: int, in_string: bool, depth: int) -> None:
        self.file, self.start, self.parity, self.depth = file, start, int(in_string), depth
        self.first = start == 0
        # after a comma at depth 1 a new element begins
        self.k, self.open, self.begun = 0, b"", start == 0 or (depth == 1 and not in_string)
        self.rows: list[tuple] = []

    def add(self, pieces: pa.Array) -> None:
        raw = _joined(pieces)
        if self.first:
            body = raw.removeprefix(b"\xef\xbb\xbf").lstrip()
            if not body.startswith(b"["):
                raise ValueError(f"{self.file} does not hold a JSON array")
            raw, self.first, self.depth = body[1:], False, 1
        b = np.frombuffer(raw, np.uint8)
        quotes, depth = _effects(raw)
        outside = (quotes + self.parity) % 2 == 0
        level = self.depth + np.cumsum(depth * outside)
        ends = np.flatnonzero((b == COMMA) & outside & (level == 1))
        at = 0
        for end in ends.tolist():
            self._emit(self.open + raw[at:end], WHOLE if self.begun else HEAD)
            self.open, self.begun, at = b"", True, end + 1
        self.open += raw[at:]
        if len(b):
            self.parity, self.depth = (self.parity + int(quotes[-1])) % 2, int(level[-1])

    def _emit(self, text: bytes, kind: int) -> None:
        self.rows.append((self.file, self.start, self.k, kind, text.decode()))
        self.k += 1

    def close(self) -> None:
        """What follows the last boundary: the last element (the array has closed) or a fragment."""
        if self.depth == 0:
            text = self.open.rstrip(b",").rstrip()[:-1]
            if text.strip() or not self.begun:
                self._emit(text, WHOLE if self.begun else HEAD)
        elif self.open:
            # the comma that ends the split's last piece is put back where fragments are joined
            self._emit(self.open[:-1], TAIL if self.begun else THROUGH)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows), _PARTS)], schema=_PARTS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for batch in batches:
        at = 0
        for file, start, pieces in _runs(batch):
            if now is None or (file, start) != (now.file, now.start):
                if now is not None:
                    now.close()
                    if now.rows:
                        yield now.taken()
                now = _Splitter(file, start, bool(batch.column(3)[at].as_py()), batch.column(4)[at].as_py())
            now.add(pieces)
            at += len(pieces)
            if now.rows:
                yield now.taken()
    if now is not None:
        now.close()
        if now.rows:
            yield now.taken()


def element_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, start, k (their order is that of the elements) and element, the text of each."""
    pieces = (spark.read.option("lineSep", ",").text(path)
              .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")))
    sums = (pieces.mapInArrow(_sum_up, "file string, start long, quotes long, outside long, inside long")
            # a split's parts keep counting from its start, so they add up
            .groupBy("file", "start").agg(*[F.sum(c).alias(c) for c in ("quotes", "outside", "inside")]))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    in_string = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    states = (sums.withColumn("in_string", in_string)
              .withColumn("depth", F.coalesce(F.sum(F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))).over(before), F.lit(0)))
              .select("file", "start", "in_string", "depth"))
    # one row a split: the bytes of the files over the split size; a broadcast keeps the order of the pieces
    parts = (pieces.join(F.broadcast(states), ["file", "start"]).select("value", "file", "start", "in_string", "depth")
             .mapInArrow(_cut, "file string, start long, k long, kind int, element string"))
    order = Window.partitionBy("file").orderBy("start", "k")
    fragments = parts.where(F.col("kind") != WHOLE).withColumn("group", F.sum((F.col("kind") == TAIL).cast("long")).over(order))
    stitched = (fragments.groupBy("file", "group").agg(F.sort_array(F.collect_list(F.struct("start", "k", "element"))).alias("f"))
                .select("file", F.col("f")[0]["start"].alias("start"), F.col("f")[0]["k"].alias("k"), F.array_join("f.element", ",").alias("element")))
    return parts.where(F.col("kind") == WHOLE).select("file", "start", "k", "element").unionByName(stitched).where(F.trim("element") != "")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str, pos: str | None = None) -> DataFrame:
    """The elements of the arrays in the files at ``path``, in ``schema``; ``pos`` names a column for their place (file, start, k).
    A malformed element gives nulls, as in Spark's permissive mode."""
    out = element_texts(spark, path).select(F.from_json("element", schema if isinstance(schema, str) else schema.simpleString()).alias("__e"),
                                            F.struct("file", "start", "k").alias("__pos"))
    return out.select("__e.*", *([F.col("__pos").alias(pos)] if pos else []))


def _array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = True
    for batch in batches:
        if batch.num_rows:
            lines = pc.binary_join_element_wise(pa.scalar(","), batch.column(0), pa.scalar(""))
            if first:
                lines = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar("["), batch.column(0).slice(0, 1), pa.scalar("")), lines.slice(1)])
                first = False
            yield pa.RecordBatch.from_arrays([lines], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], ["value"])


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON array per partition (each task writes its own, so no task holds the table)."""
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    lines.mapInArrow(_array_lines, "value string").write.mode(mode).text(path)
