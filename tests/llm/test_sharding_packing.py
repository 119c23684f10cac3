import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest import SF001
from llm.conftest import ODD
from recengine.llm import packing, queries, sharding


def test_rows_move_only_into_the_new_shard(spark):
    rows = queries.op4_shard_tree(spark, SF001).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs)
    assert all(r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    moved = sum(r.grown_shard == 8 for r in rows)
    assert 0.4 / 9 < moved / len(rows) < 2 / 9
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_draws_follow_the_weights(spark):
    tree = [sharding.Shard(0, 0, 0, 1.0), sharding.Shard(0, 1, 1, 2.0), sharding.Shard(1, 2, 2, 5.0)]
    docs = spark.range(20000).selectExpr("id doc_id", "'x' text")
    n = Counter(r.shard for r in sharding.assign(docs, tree).collect())
    assert [n[k] / 20000 for k in range(3)] == pytest.approx([1 / 8, 2 / 8, 5 / 8], abs=0.02)


def test_confined_movement_when_a_weight_grows(spark):
    tree = sharding.layout(8)
    more = [s._replace(weight=3.0) if s.shard == 6 else s for s in tree]
    docs = spark.range(5000).selectExpr("id doc_id", "'x' text")
    region = {s.shard: s.region for s in tree}
    for r in sharding.assign(docs, tree, more).collect():
        # a row leaves its region only for the region whose weight grew
        assert region[r.grown_shard] == region[r.shard] or region[r.grown_shard] == 1


def test_sharding_odd_rows(frame):
    rows = sharding.assign(frame(ODD + ODD[:1]), sharding.layout(8)).collect()
    assert len(rows) == len(ODD) + 1
    assert [(r.size, r.text_crc32) for r in rows if r.doc_id == 1] == [(1, 0)] * 2
    assert sharding.assign(frame([]), sharding.layout(8)).collect() == []


def _encode():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.tokenizer_path())


def _check_pack(rows, expected, size):
    """rows: pieces with ids; expected: doc_id -> ids."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(expected)
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        got = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist()
        assert got == expected[i]
        assert all(r.doc_tokens == len(got) and r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids) for r in pieces)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, pieces in by_seq.items():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == size or s == len(by_seq) - 1 and at <= size


@pytest.mark.parametrize("size", [64, 4096])
def test_packing_holds_every_id_once(spark, size):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").repartition(5, "doc_id")
    t = _encode()
    expected = {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 2] for r in docs.collect()}
    _check_pack(packing.pack(docs, queries.tokenizer_path(), size).collect(), expected, size)


def test_packing_odd_rows(frame):
    odd = [*ODD[:-1], (8, "it's <|endoftext|>x\x1cy\x85z é\ńa ΟΔΟΣ don't 123")]
    t = _encode()
    expected = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in odd}
    _check_pack(packing.pack(frame(odd), queries.tokenizer_path(), 16).collect(), expected, 16)
    assert packing.pack(frame([]), queries.tokenizer_path()).collect() == []
    assert packing.pack(frame([(1, "a"), (1, "a")]), queries.tokenizer_path()).count() == 2


def test_a_worker_holds_one_cache():
    """Python workers outlive the stages: what one has left is dropped when the next begins."""
    from recengine.llm import common
    common.release_cache()
    words = common.word_hashes()
    assert common.word_hashes() is words
    assert common.worker_cache("other", dict) == {} and list(common._HELD) == ["other"]
    assert common.word_hashes() is not words
    common.release_cache()
    assert not common._HELD
