"""Positional rare-token index of licence texts; DataFrame functions only.

The index maps each licence word to its postings (template, position).  Document frequencies of
the licence words over the whole table give their IDF.  A file looks up its ``TOP`` words of highest IDF first;
each posting proposes the template's start (word place minus template position), and starts that several
words share mark the template.  A marked template gives its label when its mandatory phrase stands in the file.
A template whose phrase stands in the file but that the rarest words don't mark is looked up with all licence words.

Defined cases: a null or empty text has no words; repeated rows are scored each; an empty table gives
no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recengine.llm.common import texts

# Phrases and labels of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Own templates: label -> (text, mandatory phrase).
TEMPLATES = {
    "apache": ("licensed under the apache license version", "apache license"),
    "cc-by": ("licensed under cc by", "cc by"),
    "cc-by-nc": ("licensed under cc by nc", "cc by nc"),
    "gpl": ("this work is licensed under the gnu general public license version", "general public license"),
    "mit": ("released under the mit license", "mit license"),
    "mpl": ("subject to the terms of the mozilla public license", "mozilla public license"),
    "reserved": ("all rights reserved", "all rights reserved"),
}
PHRASES = list(dict.fromkeys([*BASE, *(p for _, p in TEMPLATES.values())]))
WORDS = sorted({w for t, p in TEMPLATES.values() for w in (t + " " + p).split()} | {w for p in BASE for w in p.split()})
FIRST = sorted({p.split()[0] for p in PHRASES})
TOP, MIN_VOTES = 6, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# runs of what is no word once A-Z is lower-cased
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def hits(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and the places (i, w) of licence words."""
    cut = docs.select("doc_id", F.split("text", _BREAK).alias("words"))
    lead = (F.element_at("words", 1) == "").cast("int")
    tail = ((F.element_at("words", -1) == "") & (F.size("words") > 1)).cast("int")
    found = F.filter(F.transform("words", lambda w, i: F.when(F.lower(w).isin(WORDS), F.struct(
        (i - lead).alias("i"), F.translate(w, _UPPER, _LOWER).alias("w")))), lambda x: x.isNotNull() & x["w"].isin(WORDS))
    return cut.select("doc_id", (F.size("words") - lead - tail).cast("bigint").alias("n_words"), found.alias("hits"))


def _runs() -> Column:
    """(i, two, three): each place where a phrase's first word and another licence word stand together, with the
    two and three words from there."""
    def here(h: Column, j: Column) -> Column:
        b, c = F.get("hits", j + 1), F.get("hits", j + 2)
        two = F.concat_ws(" ", h["w"], b["w"])
        return F.when(h["w"].isin(FIRST) & (b["i"] == h["i"] + 1), F.struct(
            h["i"].alias("i"), two.alias("two"),
            F.when(c["i"] == h["i"] + 2, F.concat_ws(" ", two, c["w"])).alias("three")))

    return F.filter(F.transform("hits", here), lambda x: x.isNotNull())


def _places(phrase: str) -> Column:
    """The word numbers where the phrase's words (two or three) stand consecutively."""
    words = {2: "two", 3: "three"}[len(phrase.split())]
    return F.transform(F.filter("runs", lambda r: r[words] == phrase), lambda r: r["i"])


def document_frequencies(found: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows, and rows with each licence word (at most ``len(WORDS)`` numbers reach the driver)."""
    held = F.transform("hits", lambda h: h["w"])
    row = found.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.array_contains(held, w).cast("long")).alias(w) for w in WORDS]).first()
    return row["n"], {w: row[w] or 0 for w in WORDS}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = hits(texts(docs))
    n, df = document_frequencies(found)
    idf = {w: math.log((n + 1) / (df[w] + 1)) + 1e-9 for w in WORDS}
    idf_map = F.create_map(*[F.lit(x) for w in WORDS for x in (w, idf[w])])
    own = F.array_distinct(F.transform("hits", lambda h: h["w"]))
    rare = F.transform(F.slice(F.sort_array(F.transform(own, lambda w: F.struct((-idf_map[w]).alias("k"), w.alias("w")))), 1, TOP), lambda s: s["w"])
    out = found.select("doc_id", "n_words", "hits", rare.alias("rare"), _runs().alias("runs"))
    out = out.select("doc_id", "n_words", "hits", "rare", *[_places(p).alias(f"p{k}") for k, p in enumerate(PHRASES)])
    place = {p: F.col(f"p{k}") for k, p in enumerate(PHRASES)}
    looked = F.filter("hits", lambda h: F.array_contains("rare", h["w"]))
    out = out.withColumn("looked", looked)
    labels, shares = [], []
    for label, (text, phrase) in TEMPLATES.items():
        posts: dict[str, list[int]] = {}
        for p, w in enumerate(text.split()):
            posts.setdefault(w, []).append(p)
        present = F.size(place[phrase]) > 0
        out = out.withColumn("votes", F.when(present, _votes("looked", posts)).otherwise(0))
        out = out.withColumn(f"v_{label}", F.when(present & (F.col("votes") < MIN_VOTES), _votes("hits", posts)).otherwise(F.col("votes")))
        run = F.col(f"v_{label}")
        labels.append(F.when(run >= MIN_VOTES, F.lit(label)))
        shares.append(F.when(run >= MIN_VOTES, F.least(F.lit(1.0), run / F.lit(float(min(TOP, len(text.split()))))))
                      .otherwise(0.0))
    base = F.concat(*[place[p] for p in BASE])
    base_labels = F.array_compact(F.array(*[F.when(F.size(place[p]) > 0, F.lit(x)) for p, x in BASE.items()]))
    every = F.array_sort(F.array_distinct(F.concat(base_labels, F.array_compact(F.array(*labels)))))
    return out.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(base).cast("bigint").alias("first_word"), F.array_max(base).cast("bigint").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(base_labels))).alias("base_labels"),
        F.concat_ws(",", every).alias("labels"),
        F.greatest(F.when(F.size(base) > 0, F.lit(0.75)).otherwise(0.0), *shares).alias("score"))


def _starts(posts: dict[str, list[int]]):
    """Word place minus template position, for each posting of a looked-up word."""
    def of(h: Column) -> Column:
        out = F.array().cast("array<int>")
        for w, at in posts.items():
            out = F.when(h["w"] == w, F.array(*[h["i"] - p for p in at])).otherwise(out)
        return out
    return of


def _votes(looked: str, posts: dict[str, list[int]]) -> Column:
    """The most words that share a start: a start's votes are its run length once the proposed starts are sorted."""
    starts = F.flatten(F.transform(looked, _starts(posts)))
    return F.aggregate(F.sort_array(starts), F.struct(F.lit(-1 << 30).alias("s"), F.lit(0).alias("n"), F.lit(0).alias("best")),
                       lambda a, s: F.struct(s.alias("s"), F.when(s == a["s"], a["n"] + 1).otherwise(1).alias("n"),
                                             F.greatest(a["best"], F.when(s == a["s"], a["n"] + 1).otherwise(1)).alias("best")))["best"]
