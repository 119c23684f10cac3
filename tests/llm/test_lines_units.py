import hashlib
import re
from collections import defaultdict

import numpy as np

from conftest import SF001
from llm.conftest import ODD
from recengine.llm import line_dedup, unit_dedup


def _brute_lines(rows):
    holders = defaultdict(set)
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20 and i is not None:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (i is not None and len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def _lines(docs):
    return sorted((tuple(r) for r in line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)


def test_line_dedup_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 500)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = _lines(docs)
    assert got == _brute_lines(rows)


def test_line_dedup_cold_path_and_odd_rows(spark, frame, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 1)
    common = "  This Line is shared by ALL of them\t"
    rows = [*ODD, (10, common + "\nx"), (11, common.lower()), (12, common.upper() + "\n" + common), (13, "é" * 20), (14, "é" * 20), (15, "é" * 20)]
    assert _lines(frame(rows)) == _brute_lines(rows)
    assert _lines(frame([])) == []


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 50_000).astype(np.uint64))
    mph = line_dedup.PerfectHash.build(keys)
    assert np.array_equal(np.sort(mph.index(keys)), np.arange(len(keys)))


def test_repeated_units_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    seen, want = {}, set()
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        for m in re.finditer(r"[^\n.!?]+[.!?]*", r.text):
            words = tuple(m.group().lower().split())
            if len(words) >= 6:
                first = seen.setdefault(words, (r.doc_id, m.start()))
                if first != (r.doc_id, m.start()):
                    want.add((r.doc_id, m.start(), m.end(), *first))
    got = unit_dedup.repeated_units(docs).select("doc_id", "start", "end", "kept_doc_id", "kept_start").collect()
    assert want and {tuple(r) for r in got} == want and len(got) == len(want)


def test_repeated_units_odd_rows(frame):
    rows = [*ODD, (20, "a b c d e f g.\nother"), (21, "x A b  c d e F g. y")]
    got = unit_dedup.repeated_units(frame(rows), "line").collect()
    assert got == []
    got = unit_dedup.repeated_units(frame(rows[:-1] + [(21, "q\nA b  c d e F g.")]), "line").collect()
    assert [(r.doc_id, r.start, r.end, r.kept_doc_id) for r in got] == [(21, 2, 17, 20)]
    assert unit_dedup.repeated_units(frame([])).collect() == []


def _gone(rows, got):
    """doc_id -> its text without the removed spans."""
    spans = defaultdict(list)
    for r in got:
        spans[r.doc_id].append((r.start, r.end))
    out = {}
    for i, t in rows:
        held = np.ones(len(t), bool)
        for a, b in spans[i]:
            assert held[a:b].all()
            held[a:b] = False
        out[i] = "".join(c for c, h in zip(t, held) if h)
    return out


def test_repeated_runs_take_planted_passages_whole(frame):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    short = " ".join(" ".join(word() for _ in range(2)) + "." for _ in range(25))
    menu = "\n".join(word() for _ in range(50))
    mixed = " ".join(" ".join(word() for _ in range(n)) + "." for n in (1, 9, 2, 3, 1, 12, 4, 3, 2, 13))
    blankless = "。".join("".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 2000, 12)) for _ in range(8)) + "。"
    passages = [short, menu, mixed, blankless]
    rows = []
    for d in range(24):
        p = passages[d % 4]
        rows.append((d, "\n".join([" ".join(word() for _ in range(8)) + ".", p, " ".join(word() for _ in range(8)) + ". " + word() + "."])))
    got = unit_dedup.repeated_runs(frame(rows)).collect()
    left = _gone(rows, got)
    for i, t in rows:
        head, tail = t.split("\n")[0], t.split("\n")[-1]
        assert left[i] == t if i < 4 else left[i].split() == (head + " " + tail).split()
    assert all(r.kept_doc_id == r.doc_id % 4 for r in got)
    old = unit_dedup.repeated_units(frame(rows)).collect()
    assert len(old) < 0.2 * len(got)


def test_repeated_runs_hold_what_repeated_units_finds(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    key = lambda r: (r.doc_id, r.start, r.end, r.n_words, r.kept_doc_id, r.kept_start)
    got = [key(r) for r in unit_dedup.repeated_runs(docs).collect()]
    old = {key(r) for r in unit_dedup.repeated_units(docs).collect()}
    assert old < set(got) and len(got) == len(set(got))
    text = {r.doc_id: r.text for r in docs.collect()}
    norm = lambda i, a, n: " ".join(text[i][a:].lower().split()[:n]).rstrip(".!?")
    gone = {(i, a) for i, a, *_ in got}
    for i, a, _, n, j, b in got:
        assert (j, b) < (i, a) and norm(i, a, n) == norm(j, b, n)
        while (j, b) in gone:
            j, b = next((y, z) for x, s, _, _, y, z in got if (x, s) == (j, b))
        assert norm(i, a, n) == norm(j, b, n)


def test_repeated_runs_odd_rows(frame):
    rows = [*ODD[:-1], (20, "no"), (21, "no\nno"), (22, "a\nb\nc\nd\ne\nf\ng\nh"), (23, "x\n a\nB\nc\nd\ne\nf\n\ng\ny"), (24, "t\n" * 9), (25, "yes\nno\nyes")]
    got = unit_dedup.repeated_runs(frame(rows)).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.kept_doc_id) for r in got] == [(23, 22)] * 7 + [(24, 24)] * 3
    assert [rows[-3][1][r.start:r.end].strip().lower() for r in got[:7]] == list("abcdefg")
    assert unit_dedup.repeated_runs(frame([])).collect() == []


def test_rows_of_one_document_count_once(frame):
    line = "a line that is long enough to count"
    rows = [(1, line), (1, line), (2, line)]
    assert all(r.n_dropped == 0 for r in line_dedup.dedup_lines(frame(rows)).collect())
    got = sorted((r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(frame([*rows, (3, line)])).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 0)]
