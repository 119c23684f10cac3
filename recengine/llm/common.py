"""Helpers that several operators share."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# words kept per Python worker; the cache is emptied beyond that, so its memory is bounded
WORD_CACHE = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty), and the named further columns; all others are pruned."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to ``WORD_CACHE`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_HELD: dict[str, Any] = {}


def worker_cache(name: str, make: Callable[[], Any]) -> Any:
    """The cache ``name`` of this Python worker.  Workers outlive the stages, so a worker holds one cache at a time: asking for
    another one drops it."""
    if name not in _HELD:
        release_cache()
        _HELD[name] = make()
    return _HELD[name]


def release_cache() -> None:
    """Drop what the stages before have left in this Python worker."""
    if _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()


def word_hashes() -> WordHashes:
    """The cache of this Python worker."""
    return worker_cache("words", WordHashes)


# one random number per byte (A-Z as a-z), the base of the word polynomials, and the bytes cut at a time
_BYTES = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] = _LOWER[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SPACE, _CUT = re.compile(rb"[\t-\r ]"), 1 << 18


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2^bits powers of the base and of its inverse (mod 2^64)."""
    up, down = (np.full(1 << bits, b % (1 << 64), np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words."""
    buf = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_BLANK[buf]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(max(_CUT.bit_length(), len(raw).bit_length()))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[buf] * up[:len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends


def _pieces(raw: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(raw):
        blank = _SPACE.search(raw, at + _CUT)
        end = blank.start() if blank else len(raw)
        yield raw[at:end]
        at = end


def word_codes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text (cut at ASCII white space, A-Z as a-z): polynomials of their
    bytes, all words at once.  Long texts go by pieces that end at white space."""
    out = [_words(piece)[0] for piece in _pieces(raw)]
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def word_codes_and_endings(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of ``word_codes`` and a 16-bit hash of each word's last two bytes."""
    codes, endings = [np.empty(0, np.uint64)], [np.empty(0, np.int32)]
    for piece in _pieces(raw):
        code, starts, ends = _words(piece)
        low = _LOWER[np.frombuffer(piece, np.uint8)]
        two = np.where(ends - starts > 1, low[np.maximum(ends, 2) - 2], 0) * np.uint64(256) + low[ends - 1]
        codes.append(code)
        endings.append((mix(two + np.uint64(1)) >> np.uint64(48)).astype(np.int32))
    return np.concatenate(codes), np.concatenate(endings)


def mix(h: np.ndarray, odd: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Finaliser of a multiply-xorshift hash on uint64."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(odd)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def slices(batches: Iterator[pa.RecordBatch], size: int = 64 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about ``size`` bytes of input at most (one row at least),
    so that what an operator builds from a batch stays small."""
    for batch in batches:
        step = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
