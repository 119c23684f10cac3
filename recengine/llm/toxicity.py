"""Weighted finite-state pattern grammar over clauses.

Words are read as terminals: insult, threat, target, negation, reporting verb.  A clause transducer
walks its words once and composes the weights: an insult or threat scores, a target raises it, negation
and reported speech before it lower it; the document's score is 1 - product(1 - clause weight).
Insult terminals are word beginnings (4 to 6 letters) learned from all labelled rows whose
crc32(doc_id) mod 4 is not 2: at least ``MIN_TOXIC`` toxic documents, purity ``PURITY``, at most ``TERMINALS`` of them.

Defined cases: a null or empty text scores 0; without labels only the fixed lexicon counts; repeated rows are
scored each; an empty table gives no rows; labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recengine.llm.common import slices, texts

MIN_TOXIC, PURITY, TERMINALS = 5, 0.97, 2000
# The lexicon.
INSULT = {"idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown"}
THREAT = {"kill", "hurt", "destroy", "punish"}
TARGET = {"you", "your", "they", "he", "she", "ihr", "vous", "tu"}
NEGATION = {"not", "never", "no", "nicht", "pas"}
REPORT = {"said", "says", "called", "quoted", "wrote"}
_CLAUSE = re.compile(r"[.,;:!?\n]+")
_WORD = re.compile(r"\w+")


def held_out() -> Column:
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def rated_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """y, words: of each labelled document that is not held out, the distinct first six letters of its words of four letters or
    more, joined by blanks.  They are what a beginning can be made of, and all of a text that is sent to its label; a broadcast
    would grow with the labels."""
    rated = labels.where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("y")).where("y in (0, 1)")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: F.char_length(w) >= 4)
    short = F.array_join(F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 6))), " ")
    return texts(docs).select("doc_id", short.alias("words")).join(rated.hint("merge"), "doc_id").select("y", "words")


def terminals(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    """Learned word beginnings and their weights (at most ``TERMINALS``)."""
    begins = F.array_distinct(F.flatten(F.transform(F.split("words", " "), lambda w: F.array(*[F.substring(w, 1, n) for n in (4, 5, 6)]))))
    seen = (rated_words(docs, labels).select("y", F.explode(begins).alias("b")).where(F.char_length("b") >= 4)
            .groupBy("b").agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n"))
            .where((F.col("t") >= MIN_TOXIC) & (F.col("t") >= PURITY * F.col("n")))
            .orderBy(F.desc("t"), "b").limit(TERMINALS))
    return {r.b: r.t / (r.n + 1) for r in seen.collect()}


def clause_weight(words: list[str], learned: dict[str, float]) -> float:
    best, raised, lowered = 0.0, 1.0, 1.0
    for w in words:
        if w in TARGET:
            raised = 1.2
        elif w in NEGATION:
            lowered *= 0.4
        elif w in REPORT:
            lowered *= 0.5
        else:
            x = 0.9 if w in INSULT else 0.5 if w in THREAT else max((learned.get(w[:n], 0.0) for n in (4, 5, 6)), default=0.0)
            best = max(best, x * lowered)
    return min(0.99, 0.8 * best * raised)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    learned = docs.sparkSession.sparkContext.broadcast(terminals(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = learned.value
        for batch in slices(batches, 8 << 20):
            out = []
            for text in batch.column(1).to_pylist():
                left = 1.0
                for clause in _CLAUSE.split(text.lower()):
                    if clause:
                        left *= 1 - clause_weight(_WORD.findall(clause), known)
                out.append(1 - left)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    out = texts(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
