"""Spelling variants by reduced-alphabet generation.

Every letter is hashed to one of a few symbols.  The distinct words stand in a table under the hash of their
reduced form; each word generates the full one-edit neighbourhood of its reduced form (itself, every deletion,
replacement and insertion over the symbols) and looks it up there.  Words one edit apart have reduced forms at
most one edit apart, so no near pair is missed; the pairs that meet are verified on the original strings inside
the join, so only near pairs leave it.  Reduced forms are told apart by 64-bit polynomials, whose collisions
cost a comparison and never change the result.  A bit array of the reduced vocabulary (``FILTER_BITS`` bits,
whatever the input) drops the neighbours that nothing can meet before they are shuffled; it goes by shuffle to every
``CHUNK_WORDS`` words and never to the driver.

Defined cases: a null or empty text has no words; a null doc_id counts as the empty string; a document row that
stands twice counts twice; ties of the largest count go to the first word in code-point order; an empty table
gives no rows; other columns are ignored.  A word of any length has its whole neighbourhood generated, by parts.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recengine.llm.common import slices, texts
from recengine.session import written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT, RATIO, NOISE = 6, 5, 5, 199
SYMBOLS = 8
FILTER_BITS = 27
# 64-bit words of the bit array in one row, and vocabulary words that share a copy of it
BLOCK_BITS, CHUNK_WORDS = 12, 50_000
# distinct words a task holds before it hands their counts on
HELD_WORDS = 400_000


def _emit(total: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """word, n: the words of all texts, after one code point of every ``noise``-th (document, word) is deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc32, total = zlib.crc32, {}
        for batch in slices(batches):
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                # bytes.lower() changes A-Z only
                start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(RUN.findall(raw.lower().decode())).items():
                    if len(word) < min_length:
                        continue
                    h = crc32(word.encode(), start)
                    if not h % noise:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < min_length:
                            continue
                    total[word] = total.get(word, 0) + n
                if len(total) >= HELD_WORDS:
                    yield _emit(total)
                    total = {}
        yield _emit(total)

    return (texts(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


@functools.cache
def _letters(symbols: int) -> np.ndarray:
    """Symbol (1..symbols) of every code point of the words."""
    return (np.random.default_rng(13).permutation(256) % symbols + 1).astype(np.uint64)


_BASE = 0x9E3779B97F4A7C15


@functools.cache
def _powers(bits: int) -> np.ndarray:
    up = np.full(1 << bits, _BASE, np.uint64)
    up[0] = 1
    return np.cumprod(up)


def _symbols(word: str, symbols: int) -> np.ndarray:
    return _letters(symbols)[np.frombuffer(word.encode("latin-1"), np.uint8)]


def reduced_key(word: str, symbols: int = SYMBOLS) -> int:
    """Polynomial of the reduced form, as a signed 64-bit integer."""
    s = _symbols(word, symbols)
    return int((s * _powers(len(s).bit_length())[:len(s)]).sum(dtype=np.uint64).astype(np.int64))


def neighbour_keys(word: str, symbols: int = SYMBOLS, part: int = 4096) -> Iterator[np.ndarray]:
    """Keys of the reduced form and of all reduced words one edit away, in parts of ``part`` positions."""
    s = _symbols(word, symbols)
    m = len(s)
    up = _powers((m + 2).bit_length())
    here = s * up[:m]
    before = np.zeros(m + 1, np.uint64)
    np.cumsum(here, out=before[1:])
    whole = before[m]
    # the sum of what stands from i on, moved one place to the right or to the left
    right = np.zeros(m + 1, np.uint64)
    right[:m] = np.cumsum((s * up[1:m + 1])[::-1])[::-1]
    left = np.zeros(m + 1, np.uint64)
    left[1:m] = np.cumsum((s[1:] * up[:m - 1])[::-1])[::-1] if m > 1 else 0
    every = np.arange(1, symbols + 1, dtype=np.uint64)
    yield whole.reshape(1)
    for a in range(0, m + 1, part):
        b = min(a + part, m + 1)
        inserted = (before[a:b] + right[a:b])[:, None] + every * up[a:b, None]
        c = min(b, m)
        deleted = before[a:c] + left[a + 1:c + 1]
        replaced = (whole - here[a:c])[:, None] + every * up[a:c, None]
        yield np.concatenate([inserted.ravel(), deleted, replaced.ravel()])


def _with_keys(words: DataFrame, symbols: int) -> DataFrame:
    """word, n, key of the reduced form."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [reduced_key(w, symbols) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["word", "n", "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, key long")


def _filter(keyed: DataFrame, bits: int) -> DataFrame:
    """held: the bit array of the keys, 2^bits bits, OR-ed by Spark in words of 64 bits; a row has the words (at, bits) of one
    block, at most 2^BLOCK_BITS, and there are at most 2^(bits - 6 - BLOCK_BITS) rows."""
    place = f"shiftrightunsigned(key, {64 - bits})"
    words = (keyed.selectExpr(f"shiftright({place}, 6) as at", f"shiftleft(1L, cast({place} % 64 as int)) as bit")
             .groupBy("at").agg(F.bit_or("bit").alias("bits")))
    return (words.groupBy(F.shiftright("at", BLOCK_BITS).alias("block")).agg(F.collect_list(F.struct("at", "bits")).alias("held"))
            .select("held"))


def _neighbourhoods(keyed: DataFrame, symbols: int, bits: int, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """a, a_n, key: every neighbour of every word's reduced form that the bit array holds.

    The words are dealt into chunks and every chunk is sent a copy of the bit array, before its words."""
    chunks = math.ceil(keyed.count() / chunk_words) or 1
    held = written(_filter(keyed, bits), "held")
    kind = dict(held.dtypes)["held"]
    copies = held.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(None).cast("string").alias("word"),
                         F.lit(None).cast("long").alias("n"), "held")
    own = keyed.select(F.pmod(F.xxhash64("word"), F.lit(chunks)).cast("int").alias("chunk"), "word", "n", F.lit(None).cast(kind).alias("held"))
    # twice as many partitions as chunks: fewer of them share one
    dealt = copies.unionByName(own).repartition(2 * chunks, "chunk").sortWithinPartitions("chunk", F.col("held").isNull())
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array, last = None, None
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.diff(chunk, prepend=-1))
            for a, b in zip(starts, [*starts[1:], len(chunk)]):
                part = batch.slice(a, b - a)
                if chunk[a] != last:
                    last, array = chunk[a], np.zeros(1 << (bits - 6), np.uint64)
                words = part.column(3).drop_null().flatten()
                if len(words):
                    at, bit = words.flatten()
                    array[at.to_numpy()] = bit.to_numpy().view(np.uint64)
                part = part.filter(part.column(1).is_valid())
                yield from _met(part.column(1), part.column(2), array, symbols, shift)

    return dealt.mapInArrow(run, "a string, a_n long, key long")


def _met(words: pa.Array, ns: pa.Array, array: np.ndarray, symbols: int, shift: np.uint64) -> Iterator[pa.RecordBatch]:
    rows, keys, size = [], [], 0
    for k, word in enumerate(words.to_pylist()):
        for part in neighbour_keys(word, symbols):
            at = part >> shift
            part = np.unique(part[(array[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)])
            rows.append(np.full(len(part), k))
            keys.append(part)
            size += len(part)
        if size > 1 << 18:
            yield _pairs(words, ns, rows, keys)
            rows, keys, size = [], [], 0
    if size:
        yield _pairs(words, ns, rows, keys)


def _pairs(words: pa.Array, ns: pa.Array, rows: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
    at = pa.array(np.concatenate(rows))
    return pa.RecordBatch.from_arrays([words.take(at), ns.take(at), pa.array(np.concatenate(keys).view(np.int64))], ["a", "a_n", "key"])


def near_pairs(words: DataFrame, symbols: int = SYMBOLS, bits: int = FILTER_BITS) -> DataFrame:
    """a, a_n, b, b_n: all ordered pairs of words that differ by exactly one inserted, deleted or replaced code point."""
    keyed = written(_with_keys(words, symbols), "reduced")
    table = keyed.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("key").alias("b_key"))
    met = (F.col("key") == F.col("b_key")) & (F.levenshtein("a", "b", 1) == 1)
    # a pair can meet at a key once per part of a very long word
    pairs = _neighbourhoods(keyed, symbols, bits).join(table, met).select("a", "a_n", "b", "b_n")
    return pairs.groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))


def _hops(largest: int, ratio: int) -> int:
    """Doublings that any chain of forms needs: n grows by ``ratio`` at least with every form."""
    return max(1, math.ceil(math.log2(math.log(max(largest, 2), ratio) + 1)))


def variants(words: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS, bits: int = FILTER_BITS) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table (word, n) of distinct words."""
    best = F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b")))
    near = (near_pairs(words, symbols, bits).groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
            .select("a", "n_near", F.col("best.b").alias("b"), (-F.col("best.less")).alias("b_n")))
    counts = words.select(F.col("word"), F.col("n"))
    big: Column = F.col("b_n") >= ratio * F.col("n")
    forms = written(counts.join(near, F.col("word") == F.col("a"), "left")
                    .select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                            F.when(big, F.col("b")).alias("form"), F.when(big, F.col("b_n")).alias("form_n")), "forms")
    largest = forms.agg(F.max("n")).first()[0]
    # only words with a form move: to the form of the form, and so on by doubling
    to = forms.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(_hops(largest or 1, ratio)):
        step = to.select(F.col("word").alias("mid"), F.col("root").alias("last"))
        to = written(to.join(step, F.col("root") == F.col("mid"), "left")
                     .select("word", F.coalesce("last", "root").alias("root")), "roots")
    return (forms.join(to, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling(docs: DataFrame) -> DataFrame:
    """The words of whole texts, their forms and roots."""
    return variants(written(vocabulary(docs), "vocabulary"))
