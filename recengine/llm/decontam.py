"""Spaced-seed decontamination.

A mask selects some positions of a window of words; the hash of the selected words ignores the others,
so a substituted word leaves most windows around it intact.  Seeds of documents are filtered by a
bit array of the benchmark's seeds (``FILTER_BITS`` bits, whatever the benchmark's size), joined with them, and
gathered by (document, item, diagonal).

``leaks`` counts the words that the hits of a diagonal cover.  ``verified`` takes each hit diagonal as a
candidate only, fetches the words of the item and of the document there (64-bit hashes) and counts all equal
places of the overlap.  Either way an overlap counts from ``min_words`` equal words, or ``share`` of a short item.
``verified`` also has the mask ``THIRDS``, which every third word replaced leaves intact, and gives items that are shorter
than a mask their own masks, chosen so that any overlap of enough equal words has a hit.

Defined cases: null and empty texts have no seeds, nor for ``leaks`` texts shorter than a mask; a one-word item is in every
document with its word; repeated rows count as one document; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recengine.llm.common import mix, slices, texts, word_hashes
from recengine.session import written

# The masks.
MASKS = ("110101101", "101110011", "111001011")
THIRDS = "11011011"
FILTER_BITS = 1 << 24
# ASCII letters lower-cased, other ASCII that is no digit: blank
FOLD = bytes(ord(c.lower()) if (c := chr(b)).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))


@functools.cache
def short_masks(n: int, need: int) -> tuple[str, ...]:
    """Masks of up to three words, one of which fits within any ``need`` of ``n`` places (greedy cover)."""
    def shape(places: tuple[int, ...]) -> str:
        return "".join("01"[p in places] for p in range(places[0], places[-1] + 1))

    left = [{shape(c) for c in itertools.combinations(x, min(need, 3))} for x in itertools.combinations(range(n), need)]
    out = []
    while left:
        out.append(max(sorted(set().union(*left)), key=lambda m: sum(m in x for x in left)))
        left = [x for x in left if out[-1] not in x]
    return tuple(out)


def _needed(n: int, min_words: int, share: float) -> int:
    return max(1, math.ceil(min(min_words, n * share)))


def seeds(words: np.ndarray, masks: tuple[str, ...] = MASKS) -> list[tuple[int, np.ndarray]]:
    """(mask number, hash at each start)."""
    out = []
    for k, mask in enumerate(masks):
        n = len(words) - len(mask) + 1
        if n > 0 and mask:
            h = np.full(n, k + 1, np.uint64)
            for at in (i for i, c in enumerate(mask) if c == "1"):
                h = (h + words[at:at + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
            out.append((k, mix(h)))
    return out


def _seeded(df: DataFrame, bits=None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        held = None if bits is None else bits.value
        for batch in slices(batches, 8 << 20):
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = hashes.of(text.encode().translate(FOLD).split())
                for k, h in seeds(words):
                    at = np.arange(len(h)) if held is None else np.flatnonzero(held[(h % np.uint64(FILTER_BITS)).astype(np.int64)])
                    for c, v in zip(cols, (np.full(len(at), i), np.full(len(at), k), h[at].view(np.int64), at, np.full(len(at), len(words)))):
                        c.append(v.astype(np.int64))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["id", "mask", "h", "pos", "n_words"])
    return df.mapInArrow(run, "id long, mask long, h long, pos long, n_words long")


def leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = 10, share: float = 0.6) -> DataFrame:
    """doc_id, item_id, start_word, matched (verified equal words), item_words: one row per leaked item."""
    spark = docs.sparkSession
    items = _seeded(benchmark.where("text is not null and item_id is not null").select("item_id", "text"))
    slots = items.select(F.pmod(F.conv(F.hex("h"), 16, 10).cast("decimal(20,0)"), F.lit(FILTER_BITS)).cast("int").alias("b")).distinct()
    bits = np.zeros(FILTER_BITS, bool)
    for row in slots.toLocalIterator():  # at most FILTER_BITS rows, one partition at a time
        bits[row.b] = True
    found = _seeded(texts(docs).where("doc_id is not null"), spark.sparkContext.broadcast(bits))
    hit = (found.select(F.col("id").alias("doc_id"), "mask", "h", "pos")
           .join(items.select(F.col("id").alias("item_id"), "mask", "h", F.col("pos").alias("item_pos"), F.col("n_words").alias("item_words")), ["mask", "h"]))
    offsets = F.array(*[F.array(*[F.lit(i) for i, c in enumerate(m) if c == "1"]) for m in MASKS])
    covered = (hit.select("doc_id", "item_id", "item_words", (F.col("pos") - F.col("item_pos")).alias("diagonal"),
                          F.explode(F.transform(F.get(offsets, F.col("mask").cast("int")), lambda o: o + F.col("item_pos"))).alias("word"))
               .groupBy("doc_id", "item_id", "item_words", "diagonal").agg(F.countDistinct("word").alias("matched"), F.min("word").alias("first")))
    enough = F.least(F.lit(float(min_words)), F.col("item_words") * share)
    best = F.max(F.struct("matched", (F.col("diagonal") + F.col("first")).alias("start_word"), "item_words")).alias("m")
    return (covered.where(F.col("matched") >= enough).groupBy("doc_id", "item_id").agg(best)
            .select("doc_id", "item_id", "m.start_word", "m.matched", "m.item_words"))


def _item_seeds(benchmark: DataFrame, masks: tuple[str, ...], min_words: int, share: float) -> DataFrame:
    """item_id, words and the seeds (mask, h, pos): an item has the long masks, or those of its length if they don't fit."""
    long = {*MASKS, THIRDS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in slices(batches, 1 << 20):
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = hashes.of(text.encode().translate(FOLD).split())
                n = len(words)
                own = long if n >= len(MASKS[0]) else set(short_masks(n, _needed(n, min_words, share))) if n else set()
                found = [(k, h) for k, h in seeds(words, masks) if masks[k] in own]
                rows.append((i, words.view(np.int64), [k for k, h in found for _ in h], [x for _, h in found for x in h.view(np.int64).tolist()],
                             [p for _, h in found for p in range(len(h))]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ITEM)], ["item_id", "words", "mask", "h", "pos"])

    return (benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), "text")
            .mapInArrow(run, "item_id long, words array<long>, mask array<int>, h array<long>, pos array<int>"))


_ITEM = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
_PART = (pa.int64(), pa.int32(), *_ITEM[1:])


def _parts(docs: DataFrame, bits, reach: int, masks: tuple[str, ...]) -> DataFrame:
    """Parts of the documents around seeds of the filter, at least ``reach`` words to both sides: doc_id, start, words and the seeds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = word_hashes(), bits.value
        for batch in slices(batches, 8 << 20):
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = hashes.of(text.encode().translate(FOLD).split())
                found = [(k, at, h[at]) for k, h in seeds(words, masks) if len(at := np.flatnonzero(held[h & np.uint64(FILTER_BITS - 1)]))]
                if not found:
                    continue
                pos = np.concatenate([at for _, at, _ in found])
                order = np.argsort(pos, kind="stable")
                mask = np.repeat([k for k, _, _ in found], [len(at) for _, at, _ in found])[order]
                h, pos = np.concatenate([x for _, _, x in found])[order].view(np.int64), pos[order]
                for one in np.split(np.arange(len(pos)), np.flatnonzero(np.diff(pos) > 2 * reach) + 1):
                    start = max(0, int(pos[one[0]]) - reach)
                    rows.append((i, start, words[start:int(pos[one[-1]]) + reach].view(np.int64), mask[one], h[one], pos[one]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PART)], ["doc_id", "start", "words", "mask", "h", "pos"])

    return (texts(docs).where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(run, "doc_id long, start int, words array<long>, mask array<int>, h array<long>, pos array<int>"))


def verified(docs: DataFrame, benchmark: DataFrame, min_words: int = 10, share: float = 0.6) -> DataFrame:
    """doc_id, item_id, start_word, matched (all equal words on the diagonal), item_words: one row per leaked item."""
    spark = docs.sparkSession
    short = {m for n in range(1, len(MASKS[0])) for m in short_masks(n, _needed(n, min_words, share))}
    masks = (*MASKS, THIRDS, *sorted(short - {*MASKS, THIRDS}))
    items = written(_item_seeds(benchmark, masks, min_words, share), "items")
    reach = items.agg(F.max(F.size("words"))).first()[0] or 0
    item_seeds = items.select("item_id", F.explode(F.arrays_zip("mask", "h", "pos")).alias("s")).select("item_id", "s.mask", "s.h", F.col("s.pos").alias("item_pos"))
    slots = item_seeds.select("mask", F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)).cast("int").alias("b")).distinct()
    bits, used = np.zeros(FILTER_BITS, bool), set()
    for row in slots.toLocalIterator():  # at most FILTER_BITS rows of a mask, one partition at a time
        bits[row.b] = True
        used.add(row.mask)
    # a mask of no item is left out, its number stays
    parts = written(_parts(docs, spark.sparkContext.broadcast(bits), reach, tuple(m if k in used else "" for k, m in enumerate(masks))), "parts")
    hit = parts.select("doc_id", "start", F.explode(F.arrays_zip("mask", "h", "pos")).alias("s")).select("doc_id", "start", "s.mask", "s.h", "s.pos")
    candidates = (hit.join(item_seeds, ["mask", "h"])
                  .select("doc_id", "start", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct())
    both = (candidates.join(parts.select("doc_id", "start", "words"), ["doc_id", "start"])
            .join(items.select("item_id", F.col("words").alias("item")), "item_id"))
    equal = F.filter(F.sequence(F.lit(0), F.size("item") - 1),
                     lambda p: F.get("item", p) == F.get("words", F.col("diagonal") + p - F.col("start")))
    counted = (both.select("doc_id", "item_id", "diagonal", F.size("item").cast("long").alias("item_words"), equal.alias("equal"))
               .select("doc_id", "item_id", "item_words", F.size("equal").cast("long").alias("matched"),
                       (F.col("diagonal") + F.get("equal", F.lit(0))).cast("long").alias("start_word")))
    best = F.max(F.struct("matched", "start_word", "item_words")).alias("m")
    enough = F.least(F.lit(float(min_words)), F.col("item_words") * share)
    return (counted.where(F.col("matched") >= enough).groupBy("doc_id", "item_id").agg(best)
            .select("doc_id", "item_id", "m.start_word", "m.matched", "m.item_words"))
