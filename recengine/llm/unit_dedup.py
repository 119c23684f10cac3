"""Line or paragraph hashing.

Every text is cut into units (lines, or the sentences of lines), units are normalised (white space
folded, lower case) and hashed to 128 bits (96 in ``repeated_runs``: at 10^12 units, one pair in some 100,000 corpora collides).  Digests are grouped globally with partial aggregation;
the earliest occurrence by (doc_id, offset) stays and every other one is returned as a span of the original text.

``repeated_units`` looks at units of ``min_words`` words or more, one by one.  ``repeated_runs`` looks at every unit:
one of ``min_words`` words or ``MIN_CHARS`` code points of words stands alone; a shorter one goes when a run of consecutive
units around it, just long enough to reach one of the two, has an earlier place.  A run starts or ends at each short unit,
so that a repeated passage of short units goes whole once it reaches the length.

Defined cases: a null or empty text has no units; units of white space are none; a run's units within its own earliest place stay;
repeated rows count as one document (same doc_id and offset: the same place); an empty table gives
no rows; columns other than doc_id and text are ignored; rows without doc_id are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recengine.llm.common import slices, texts

PATTERNS = {"line": re.compile(r"[^\n]+"), "paragraph": re.compile(r"[^\n]+(?:\n[^\n]+)*"),
            "sentence": re.compile(r"[^\n.!?]+[.!?]*"), "any_sentence": re.compile(r"[^\n.!?\u3002\uff01\uff1f]+[.!?\u3002\uff01\uff1f]*")}
MIN_CHARS = 30
_UNITS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int32()),
                    ("hi", pa.int64()), ("lo", pa.int64())])


def units(docs: DataFrame, unit: str = "sentence", min_words: int = 6) -> DataFrame:
    """doc_id, start, end (code points of the original text), n_words and digest (hi, lo) of every unit."""
    pattern = PATTERNS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for m in pattern.finditer(text):
                    words = m.group().lower().split()
                    if len(words) >= min_words:
                        d = xxhash.xxh3_128_digest(" ".join(words))
                        rows.append((doc_id, m.start(), m.end(), len(words), int.from_bytes(d[:8], "little", signed=True),
                                     int.from_bytes(d[8:], "little", signed=True)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _UNITS)], schema=_UNITS)

    return (texts(docs).where("doc_id is not null")
            .mapInArrow(run, "doc_id long, start int, end int, n_words int, hi long, lo long"))


def repeated_units(docs: DataFrame, unit: str = "sentence", min_words: int = 6) -> DataFrame:
    """One row per removed span: doc_id, start, end, n_words, kept_doc_id, kept_start, n_places."""
    found = units(docs, unit, min_words)
    place = F.struct("doc_id", "start")
    kept = (found.groupBy("hi", "lo").agg(F.min(place).alias("kept"), F.max(place).alias("last"),
                                          F.count(F.lit(1)).alias("n_places"))
            .where("kept != last").drop("last"))
    return (found.join(kept, ["hi", "lo"]).where(place != F.col("kept"))
            .select("doc_id", "start", "end", "n_words", F.col("kept.doc_id").alias("kept_doc_id"),
                    F.col("kept.start").alias("kept_start"), "n_places"))


_RUNS = pa.schema([("doc_id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int32()), ("parts", pa.list_(pa.int32()))])


def _runs_of(text: str, pattern: re.Pattern, min_words: int, min_chars: int) -> Iterator[tuple[list[tuple[int, int, int, str, bool]], str]]:
    """The long units, and the shortest long runs that start or end at a short unit: (its units (start, end, n_words, normalised text, long), text)."""
    found = []
    for m in pattern.finditer(text):
        words = m.group().lower().split()
        if words:
            n = sum(map(len, words))
            found.append((m.start(), m.end(), len(words), " ".join(words), n, len(words) >= min_words or n >= min_chars))
    spans = set()
    for k, u in enumerate(found):
        if u[5]:
            yield [u], u[3]
            continue
        for step in (1, -1):
            words = chars = 0
            at = k
            while 0 <= at < len(found):
                words, chars = words + found[at][2], chars + found[at][4]
                if words >= min_words or chars >= min_chars:
                    spans.add((min(k, at), max(k, at) + 1))
                    break
                at += step
    for a, b in spans:
        yield found[a:b], "\n".join(u[3] for u in found[a:b])


def runs(docs: DataFrame, unit: str = "any_sentence", min_words: int = 6, min_chars: int = MIN_CHARS) -> DataFrame:
    """Long units and long runs with their digests of 96 bits; ``parts`` holds start, length and size (in words) of each unit, one after
    the other.  A long unit in a run has size 0 there, since it has a row of its own."""
    pattern = PATTERNS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for part, norm in _runs_of(text, pattern, min_words, min_chars):
                    d = xxhash.xxh3_128_digest(norm)
                    lone = len(part) == 1
                    rows.append((doc_id, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:12], "little", signed=True),
                                 [x for u in part for x in (u[0], u[1] - u[0], u[2] if lone or not u[5] else 0)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RUNS)], schema=_RUNS)

    return (texts(docs).where("doc_id is not null")
            .mapInArrow(run, "doc_id long, hi long, lo int, parts array<int>"))


def repeated_runs(docs: DataFrame, unit: str = "any_sentence", min_words: int = 6, min_chars: int = MIN_CHARS) -> DataFrame:
    """The columns of ``repeated_units``: one row per removed unit; ``n_places`` counts those of the unit or of the run around it."""
    found = runs(docs, unit, min_words, min_chars)
    start, end = F.col("parts")[0], F.expr("parts[size(parts) - 3] + parts[size(parts) - 2]")
    # where a unit alone begins says its row already
    inner = F.when(F.size("parts") > 3, F.expr("transform(sequence(0, size(parts) - 1, 3), k -> parts[k])"))
    kept = (found.groupBy("hi", "lo")
            .agg(F.min(F.struct("doc_id", start.alias("start"), end.alias("end"), inner.alias("starts"))).alias("kept"), F.count(F.lit(1)).alias("n_places"))
            .where("n_places > 1"))
    again = found.join(kept, ["hi", "lo"]).where("(doc_id, parts[0]) != (kept.doc_id, kept.start)")
    each = F.expr("""transform(sequence(0, size(parts) - 1, 3), k -> struct(parts[k] as start, parts[k + 1] as length, parts[k + 2] as n_words,
                               coalesce(kept.starts[k div 3], kept.start) as kept_start))""")
    # no unit goes that stands in the run's earliest place; one unit may stand in several runs
    return (again.select("doc_id", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.end").alias("kept_end"), "n_places", F.explode(each).alias("u"))
            .where("u.n_words > 0 and not (doc_id = kept_doc_id and u.start < kept_end)")
            .groupBy("doc_id", F.col("u.start").alias("start"))
            .agg(F.min(F.struct("kept_doc_id", F.col("u.kept_start").alias("s"), "n_places", F.col("u.length").alias("l"), F.col("u.n_words").alias("w"))).alias("k"))
            .select("doc_id", "start", (F.col("start") + F.col("k.l")).alias("end"), F.col("k.w").alias("n_words"),
                    "k.kept_doc_id", F.col("k.s").alias("kept_start"), "k.n_places"))
