"""op13 against plain Python."""

import re
import zlib
from collections import Counter

import pytest
from conftest import SF001

from recengine.llm import spelling
from recengine.llm.common import table
from tests.llm.conftest import ODD


def words_of(rows):
    total = Counter()
    for doc_id, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def edits(word, letters):
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return ({a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters}
            | {a + c + b for a, b in cut for c in letters}) - {word}


def brute(words):
    letters, out = sorted({c for w in words for c in w}), {}
    for w, n in words.items():
        near = [x for x in edits(w, letters) if x in words]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 5 * n else None
        out[w] = [form, n, len(near), words[form] if form else None]
    def root(w):
        return w if out[w][0] is None else root(out[w][0])
    return sorted((w, f, root(w), n, k, fn) for w, (f, n, k, fn) in out.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_whole_table(spark):
    docs = table(spark, SF001, "documents")
    want = brute(words_of([(r.doc_id, r.text) for r in docs.collect()]))
    assert want and rows_of(spelling.spelling(docs)) == want


PLANTED = ["Zebralike " * 700 + "zebralikes " * 130 + "zebralikesx " * 25 + "zebraliksx " * 5 + "zebralikés " * 6,
           "aaaaaa " * 5 + "aaaaaaa " * 5 + "aaaaab " * 9 + "abaaaa " * 9 + "short " * 50, "Étoiles étoiles " * 5 + "x" * 30_000 + " " + "ÿþýüûú " * 5]


def test_chains_ties_odd_rows(spark, frame):
    rows = [*ODD, *[(100 + k, t) for k, t in enumerate(PLANTED)], (100, PLANTED[0]), *[(200 + k, ("y" * 9000 + " ") * 5 + "y" * 9001) for k in range(5)]]
    got = rows_of(spelling.spelling(frame(rows)))
    assert got == brute_long(rows)
    by = {r[0]: r for r in got}
    assert by["zebraliksx"][2] == "zebralike" and by["zebraliksx"][1] == "zebralikesx"  # a chain of three forms


def brute_long(rows):
    """As brute, with the two very long words compared as they are."""
    words = words_of(rows)
    long = {w: n for w, n in words.items() if len(w) > 1000}
    out = brute({w: n for w, n in words.items() if w not in long})
    a, b = sorted(long, key=len)
    assert b == a + "y"
    form = a if long[a] >= 5 * long[b] else None
    out += [(a, None, a, long[a], 1, None), (b, form, form or b, long[b], 1, long[form] if form else None)]
    return sorted(out)


@pytest.mark.parametrize("symbols", [1, 2, 8, 64])
def test_any_alphabet(spark, symbols):
    words = words_of([(1, " ".join(PLANTED))])
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.variants(df, symbols=symbols, bits=10)) == brute(words)


def test_neighbourhood_is_full():
    import numpy as np
    word = "abcÿefg"
    letters = [next(chr(c) for c in range(256) if spelling._letters(8)[c] == s) for s in range(1, 9)]
    want = {spelling.reduced_key(w) for w in edits(word, letters) | {word}}
    assert set(np.concatenate(list(spelling.neighbour_keys(word, part=3))).view(np.int64).tolist()) == want


def test_empty_and_clashing(spark, frame):
    assert spelling.spelling(frame([])).count() == 0
    from pyspark.sql import functions as F
    docs = frame([(1, "planet " * 30 + "planets " * 5)])
    for c in ("word", "n", "key", "form", "root", "a", "b"):
        docs = docs.withColumn(c, F.lit(1))
    assert rows_of(spelling.spelling(docs)) == brute(words_of([(1, "planet " * 30 + "planets " * 5)]))


def test_bit_array_reaches_every_chunk(spark):
    """Chunks of two words each: the same neighbours as from one chunk, and nothing but the words' count on the driver."""
    words = spark.createDataFrame([(f"abc{a}ef{b}", 5) for a in "ghij" for b in "klmno"], "word string, n long")
    keyed = spelling._with_keys(words, 4)
    one, many = (sorted(map(tuple, spelling._neighbourhoods(keyed, 4, 10, chunk_words=k).collect())) for k in (1000, 2))
    assert len(one) > 100 and one == many
