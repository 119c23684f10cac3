"""Concatenate and cut.

Pass 1 tokenises every document where it lies and writes its ids with its running start inside
the input partition.  The token totals of the partitions (one row each) are summed to global
offsets; pass 2 cuts each document's ids at the multiples of the sequence length, which gives a
record for every piece of a document in a window.  No text or id is shuffled; only the last sequence can be
short.

Defined cases: a null or empty text is its end token alone; a very long text spans as many
sequences as it needs; repeated rows are packed once each; an empty table gives no rows; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recengine.llm.common import release_cache, slices, texts, worker_cache
from recengine.session import written

CHUNK_CACHE, CHUNK_CHARS = 600_000, 64
PUNCTUATION = ".,;:!?*%$#&|()-"


class _Chunks(dict):
    """Ids (little-endian uint32) of a piece of text between blanks, remembered for the frequent short
    ones.  Exact for tokenizers that drop white space and never join across it."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, chunk: str) -> bytes:
        core = chunk.rstrip(PUNCTUATION)
        if core != chunk and core and core[-1].isalpha() and "<|" not in chunk:
            # the tokenizer cuts between a letter and punctuation anyway
            return self[core] + self[chunk[len(core):]]
        if chunk.isascii() and not chunk.islower() and chunk.isalpha():
            return self[chunk.lower()]
        ids = np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= CHUNK_CHARS:
            if len(self) >= CHUNK_CACHE:
                self.clear()
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def _chunks(path: str) -> _Chunks:
    from tokenizers import Tokenizer
    return worker_cache(f"chunks {path}", lambda: _Chunks(Tokenizer.from_file(path)))


_TOKENS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()),
                     ("n_tokens", pa.int64()), ("ids", pa.binary())])


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, part (input partition), start (tokens before it there), n_tokens, ids (binary, little-endian uint32)."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, start = _chunks(tokenizer_path).ids, TaskContext.get().partitionId(), 0
        for batch in slices(batches, 8 << 20):
            ids = [ids_of(t) + end for t in batch.column(1).to_pylist()]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            ends = start + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(np.full(len(n), part, np.int32)),
                 pa.array(ends - n), pa.array(n), pa.array(ids, pa.binary())], schema=_TOKENS)
            start = int(ends[-1])

    return texts(docs).mapInArrow(run, "doc_id long, part int, start long, n_tokens long, ids binary")


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                     ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                     ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, end_id: int = 2,
         with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (if asked for), ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = written(tokenised(docs, tokenizer_path, end_id), "tokens")
    # one row per input partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    firsts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_cache()     # pass 1 is over
        for batch in slices(batches, 16 << 20):
            rows: list[tuple] = []
            for doc_id, at, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                held = memoryview(ids)
                edges = [0, *range(max_tokens - at % max_tokens, n, max_tokens), n]
                for a, b in zip(edges, edges[1:]):
                    piece = held[4 * a:4 * b]
                    rows.append((doc_id, a, b - a, bytes(piece) if with_ids else None, zlib.crc32(piece), n,
                                 (at + a) // max_tokens, (at + a) % max_tokens))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    # broadcast: one row of 12 bytes per input partition
    placed = tokens.join(F.broadcast(firsts), "part").select("doc_id", (F.col("first") + F.col("start")).alias("at"), "n_tokens", "ids")
    out = placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, ids_crc32 long,"
                                 " doc_tokens long, sequence_id long, offset long")
    return out if with_ids else out.drop("ids")
