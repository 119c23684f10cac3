"""Sharded minimal perfect hash over distinct line hashes.

Keys (stripped, A-Z lower-cased lines of at least ``min_chars`` code points) are hashed to 64 bits and
counted with partial aggregation.  The distinct hashes are dealt to shards; each shard builds a
levelled minimal perfect hash whose index addresses arrays of fingerprints, counts and last holders.
Documents send their hashes to the shards, sorted behind the shard's index row, and probe the arrays
as they stream by; no line is joined.  Keys held by more than 1/``HOT_SHARE`` of all line places are few
by that bound; their answers are broadcast, so no hot line reaches a shard.

Defined cases: a null or empty text is one empty line; a line repeated inside a document counts once for it but
loses all its places; repeated rows of a doc_id count as one document; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recengine.llm.common import mix, slices, texts
from recengine.session import written

STRIP = b" \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 200_000
HOT_SHARE = 10_000


def line_keys(text: str, min_chars: int) -> tuple[list[bytes], list[int | None]]:
    """The lines, and the signed 64-bit hash of each line's key (None: too short)."""
    lines = text.encode().split(b"\n")
    out: list[int | None] = []
    for line in lines:
        key = line.strip(STRIP).lower()
        long = len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)
        out.append(xxhash.xxh3_64_intdigest(key) - (1 << 63) if long else None)
    return lines, out


def _hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            ids, hs = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = {h for h in line_keys(text, min_chars)[1] if h is not None}
                ids += [doc_id] * len(held)
                hs += held
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.int64())], ["doc_id", "h"])
    return texts(docs).mapInArrow(run, "doc_id long, h long")


class PerfectHash:
    """Levels of bitmaps: a key takes the first level where it alone holds its bit; its index is that bit's rank."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks, at = [], 0
        for bits in levels:
            self.ranks.append(at + np.cumsum(bits, dtype=np.int64) - bits)
            at += int(bits.sum())

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(level * 0x632BE59BD9B4E019 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = 2 * len(keys)
            at = cls._at(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            keys = keys[~alone[at]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 for some keys that were never built in (others are caught by fingerprints)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            at = self._at(keys[left], level, len(bits))
            hit = bits[at] == 1
            out[left[hit]] = self.ranks[level][at[hit]]
            left = left[~hit]
        return out


def _probe(min_docs: int):
    """Rows (shard, h, doc_id, n): in each shard first the index (n not null), then the requests (n null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, built, keys, vals = None, None, [], []
        for batch in batches:
            s, h, d, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            for at in np.split(np.arange(len(s)), np.flatnonzero(np.diff(s)) + 1):
                if s[at[0]] != shard:
                    shard, built, keys, vals = s[at[0]], None, [], []
                index = n[at] > 0
                if index.any():
                    keys.append(h[at[index]].view(np.uint64))
                    vals.append((n[at[index]], d[at[index]]))
                at = at[~index]
                if not len(at):
                    continue
                if built is None:
                    k = np.concatenate(keys)
                    mph = PerfectHash.build(k)
                    where = mph.index(k)
                    prints, counts, last = np.empty(len(k), np.uint32), np.empty(len(k), np.int64), np.empty(len(k), np.int64)
                    prints[where] = (k >> np.uint64(32)).astype(np.uint32)
                    counts[where] = np.concatenate([v[0] for v in vals])
                    last[where] = np.concatenate([v[1] for v in vals])
                    built, keys, vals = (mph, prints, counts, last), [], []
                mph, prints, counts, last = built
                req = h[at].view(np.uint64)
                where = mph.index(req)
                drop = (where >= 0) & (prints[where] == (req >> np.uint64(32)).astype(np.uint32)) & (counts[where] >= min_docs) & (last[where] != d[at])
                yield pa.RecordBatch.from_arrays([pa.array(d[at][drop]), pa.array(h[at][drop])], ["doc_id", "h"])
    return run


def drop_lists(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id and the hashes of the keys whose lines that document loses."""
    docs = docs.where("doc_id is not null")
    places = _hashes(docs, min_chars)
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        # rows of one doc_id are one document: each of its keys counts once
        places = places.distinct()
    counted = written(places.groupBy("h").agg(F.count(F.lit(1)).alias("n"),
                                              F.max("doc_id").alias("last")), "line_counts")
    total = counted.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("places")).first()
    shards = max(1, -(-total["keys"] // KEYS_PER_SHARD))
    hot_from = max(min_docs, (total["places"] or 0) // HOT_SHARE + 1)
    # broadcast: at most HOT_SHARE keys, since each holds over 1/HOT_SHARE of all places
    hot = F.broadcast(counted.where(F.col("n") >= hot_from).select("h", F.col("last").alias("hot_last")))
    asked = places.join(hot, "h", "left")
    shard = F.pmod(F.col("h"), F.lit(shards))
    index = counted.where(F.col("n") < hot_from).select(shard.alias("shard"), "h", F.col("last").alias("doc_id"), "n")
    cold = asked.where("hot_last is null").select(shard.alias("shard"), "h", "doc_id", F.lit(0).cast("bigint").alias("n"))
    both = index.unionByName(cold).repartition(shards, "shard").sortWithinPartitions("shard", F.expr("n = 0"))
    dropped = both.mapInArrow(_probe(min_docs), "doc_id long, h long")
    dropped = dropped.unionByName(asked.where("hot_last != doc_id").select("doc_id", "h"))
    return dropped.groupBy("doc_id").agg(F.collect_set("h").alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text without dropped lines), kept_sha256, and the other columns of ``docs``."""
    lists = drop_lists(docs, min_chars, min_docs)

    def clean(text, drop):
        import pandas as pd
        rows = []
        for t, d in zip(text, drop):
            gone = set() if d is None else set(d)
            lines, keys = line_keys(t or "", min_chars)
            kept = [x for x, k in zip(lines, keys) if k is None or k not in gone]
            out = b"\n".join(kept)
            rows.append((len(lines), len(lines) - len(kept), out.decode(), hashlib.sha256(out).hexdigest()))
        return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept", "kept_sha256"])

    import pandas as pd
    clean.__annotations__ = {"text": pd.Series, "drop": pd.Series, "return": pd.DataFrame}
    apply = F.pandas_udf(clean, "n_lines long, n_dropped long, kept string, kept_sha256 string")
    return (docs.join(lists, "doc_id", "left").withColumn("__c", apply("text", "drop"))
            .drop("drop").select("*", "__c.*").drop("__c"))
