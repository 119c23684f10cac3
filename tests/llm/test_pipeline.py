"""The pipeline, stage by stage, against plain Python over the rows that each stage was given."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from conftest import SF001
from llm.test_jaccard import _brute
from recengine.llm import decontam, ordinal
from recengine.llm.common import table
from recengine.session import written

SPACE = " \t\n\x0b\x0c\r"


def _lines(rows):
    """Texts without the lines of at least 20 characters that 3 documents hold, but for the last holder."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(SPACE).translate(low)
            if len(key) >= 20:
                held.setdefault(key, set()).add(i)
    out = {}
    for i, t in rows:
        keep = []
        for line in (t or "").split("\n"):
            who = held.get(line.strip(SPACE).translate(low), set())
            if len(who) < 3 or max(who) == i:
                keep.append(line)
        out[i] = "\n".join(keep)
    return out


def test_stages(spark):
    docs = table(spark, SF001, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_duplicates", "decontaminate", "pack"]
    given, out = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        given[name] = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
        out = written(stage(spark, out, SF001), name)
        if name == "quality":
            keep = {r.doc_id for r in ordinal.classify(docs, table(spark, SF001, "labels")).where("keep").collect()}
            assert {r.doc_id for r in out.collect()} == keep and 0 < len(keep) < len(given[name])
        elif name == "lines":
            assert {r.doc_id: r.text for r in out.collect()} == _lines(list(given[name].items()))
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "near_duplicates":
            want = {i for i, _, c in _brute(list(given[name].items())) if i == c}
            assert {r.doc_id for r in out.collect()} == want
        elif name == "decontaminate":
            bench = [(r.item_id, set(re.findall(rb"\S+", r.text.encode().translate(decontam.FOLD)))) for r in table(spark, SF001, "benchmark").collect() if r.text]
            gone = set(given[name]) - {r.doc_id for r in out.collect()}
            for i in gone:  # a leaked document has at least the words of an overlap
                words = set(given[name][i].encode().translate(decontam.FOLD).split())
                assert any(len(words & b) >= min(6, 0.5 * len(b)) for _, b in bench)
        if name != "pack":
            assert out.columns == docs.columns
    rows = out.collect()
    assert {r.doc_id for r in rows} == set(given["pack"])
    tokens = {r.doc_id: r.doc_tokens for r in rows}
    assert sum(r.length for r in rows) == sum(tokens.values())
    spans = sorted((r.sequence_id * 4096 + r.offset, r.length) for r in rows)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_empty_and_odd_documents(spark):
    docs = table(spark, SF001, "documents")
    odd = spark.createDataFrame([(1, None, "en", "s", None), (2, "", None, "s", 0), (None, "x", "en", "s", 1)], docs.schema)
    for rows in (docs.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = written(stage(spark, rows, SF001), name)
            assert rows.columns == docs.columns
        assert corpus_pipeline.pack(spark, rows, SF001).count() == rows.count()


def test_lines_stage_with_clashing_columns(spark, frame):
    line = "a line that is long enough to count"
    docs = frame([(k, f"{line}\nown {k}") for k in range(3)])
    for c in ("n_lines", "n_dropped", "kept", "kept_sha256", "drop", "h", "__c"):
        docs = docs.withColumn(c, F.lit("x"))
    got = corpus_pipeline.lines(spark, docs, SF001)
    assert got.columns == docs.columns and got.where("kept = 'x' and n_lines = 'x'").count() == 3
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {0: ("own 0", 5), 1: ("own 1", 5), 2: (f"{line}\nown 2", len(line) + 6)}
