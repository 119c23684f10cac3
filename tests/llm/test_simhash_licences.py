import hashlib
import re

from conftest import SF001
from llm.conftest import ODD
from recengine.llm import licences, simhash


def _check_simhash(rows, docs):
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    by = {}
    for k, (i, t) in enumerate(docs):
        t, nxt = t or "", docs[(k + 1) % len(docs)][1] or ""
        n = len(t) // 4
        e = t[:len(t) - n] + nxt[:n]
        by[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), t, e)
    prints = {}
    for r in rows:
        n, sha, t, e = by[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint and prints.setdefault(e, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(rows) == len(docs)


def test_simhash_matches_plain_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "DOCS_PER_RANGE", 30)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = simhash.simhash(docs, query_every=10).collect()
    _check_simhash(rows, [(r.doc_id, r.text) for r in docs.collect()])
    fps = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    for r in rows:
        if r.doc_id % 10 == 0:
            assert r.n_near == sum((fps[r.doc_id] ^ x).bit_count() <= 3 for x in fps.values()) - 1
    mean = lambda c: sum(r[c] for r in rows) / len(rows)
    assert mean("near_edited") > mean("near_next") + 0.4


def test_permuted_tables_find_every_close_fingerprint(spark):
    import itertools
    import random
    rnd = random.Random(3)
    base = [rnd.getrandbits(63) for _ in range(20)]
    fps = base + [b ^ sum(1 << k for k in rnd.sample(range(63), d)) for b, d in itertools.product(base, (1, 2, 3, 4))]
    got = simhash.within_radius(spark.createDataFrame([(x,) for x in base], "qfp long"), spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    want = {(a, b) for a in base for b in fps if (a ^ b).bit_count() <= 3}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_simhash_odd_rows(frame):
    rows = simhash.simhash(frame(ODD)).collect()
    _check_simhash(rows, ODD)
    assert simhash.simhash(frame([])).collect() == []


def _brute_licences(i, t):
    t = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    found = [(k, label) for p, label in licences.BASE.items() for k in range(len(words)) if words[k:k + len(p.split())] == p.split()]
    at = [k for k, _ in found]
    return (i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})))


def test_licences_match_brute_force(spark, frame):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    more = [*ODD, (50, "CC-BY cc by, cc\nBY 4.0. ALL  RIGHTS reserved"), (51, "Released under the MIT License."),
            (52, "Licensed under the Apache License, Version 2.0"), (53, "mit der License"), (54, "all rights all rights reserved")]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for table, plain in ((docs, rows), (frame(more), more)):
        got = licences.scan(table).collect()
        assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((_brute_licences(*x) for x in plain), key=str)
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    labels = {r.doc_id: r.labels for r in got}
    assert labels[51] == "mit" and labels[52] == "apache" and labels[53] == ""
    assert licences.scan(frame([])).collect() == []


def test_licences_of_joined_notices_are_all_found(spark, frame):
    import itertools
    names = sorted(licences.TEMPLATES)
    joined = [c for n in (1, 2, 3, 4, 7) for c in itertools.combinations(names, n)]
    rows = [(k, ". ".join(licences.TEMPLATES[x][0] for x in c)) for k, c in enumerate(joined)]
    more = [(1000 + k, t) for k, t in enumerate(["the mit license", "licensed under the license", "to the public"] * 30)]
    labels = {r.doc_id: r.labels.split(",") for r in licences.scan(frame(rows + more)).collect()}
    for k, c in enumerate(joined):
        want = set(c) | ({"cc-by"} if "cc-by-nc" in c else set())
        assert set(labels[k]) == want, (c, labels[k])
