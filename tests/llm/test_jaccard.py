import re

from conftest import SF001
from llm.conftest import ODD
from recengine.llm import jaccard


def _brute(rows):
    sets = {}
    for i, t in rows:
        t = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def test_components_match_brute_force(spark, frame):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    want = _brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(tuple(r) for r in jaccard.join(docs).collect()) == want
    assert any(i != c for i, _, c in want)


def test_odd_rows(frame):
    assert sorted(tuple(r) for r in jaccard.join(frame(ODD)).collect()) == _brute(ODD[:-1])
    assert jaccard.join(frame([])).collect() == []


def test_salted_regions_and_small_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SALT_LEVEL", 0)
    monkeypatch.setattr(jaccard, "GROUP", 2)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert sorted(tuple(r) for r in jaccard.join(docs).collect()) == _brute([(r.doc_id, r.text) for r in docs.collect()])


def test_texts_near_the_threshold(frame):
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        words = list(base)
        for k in range(i % 9 + 1):  # one to nine changed words: on both sides of the threshold
            words[(17 * i + 23 * k) % 150] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    assert sorted(tuple(r) for r in jaccard.join(frame(rows)).collect()) == _brute(rows)
