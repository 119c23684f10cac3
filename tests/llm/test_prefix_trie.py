"""op12 against plain Python and its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from conftest import SF001, SF01

from recengine.llm import prefix_trie as T
from recengine.llm import prefix_trie_sql
from recengine.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5((hashlib.md5(role.encode()).hexdigest() + text).encode()).digest()
            turns[c].append((turn is not None, turn or 0, digest, (role, text)))
    turns = {c: [x[3] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - c % 5, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(k)).encode()).hexdigest()) for k, m in members.items()))


def rows_of(df):
    assert set(COLS) <= set(df.columns)
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*COLS).collect())


def test_whole_table(spark):
    conv = table(spark, SF001, "conversations")
    assert rows_of(T.prefix_nodes(conv)) == brute([tuple(r) for r in conv.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_sql(spark, sf):
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    got = db.sql(f"select {', '.join(COLS)} from ({prefix_trie_sql.SQL})").fetchall()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == rows_of(T.prefix_nodes(table(spark, sf, "conversations")))


def random_rows(seed):
    rng, rows = random.Random(seed), []
    for c in range(260):
        # a hot first turn, copies, chains where each goes one turn further, and long ones
        n = rng.choice([0, 1, 2, 3, 5, 8, 13]) if c % 7 else 20 + c
        for t in range(n):
            word = "hot" if t == 0 and rng.random() < 0.6 else "spine" if c % 7 == 0 or rng.random() < 0.7 else rng.choice("abcdé")
            rows.append((c, t, rng.choice(["user", None]) if t == 3 else "user", word))
    return rows


@pytest.mark.parametrize("batches", [(1, 8, 64), (64,), (4, 16, 32, 64)])
def test_deep_and_hot(spark, batches):
    rows = random_rows(len(batches))
    assert rows_of(T.prefix_nodes(spark.createDataFrame(rows, SCHEMA), batches)) == brute(rows)


ODD = [(None, 0, "user", "no id"), (0, None, None, None), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, 2, "x", ""), (1, 5, "user", "y" * 50_000),
       (7, None, "user", "only"), (8, 0, "user", "p"), (8, 0, "user", "q"), (8, 0, "bot", "p"), (10, 0, "user", ""), (11, 0, "user", None), (4, 0, "a", "bc"), (3, 0, "ab", "c")]


def test_odd_rows(spark):
    assert rows_of(T.prefix_nodes(spark.createDataFrame(ODD, SCHEMA))) == brute(ODD)


def test_turnless_only(spark):
    # conversations whose base is absent and whose turns all go
    ids = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0]
    rows = [(c, 0, "user", "t") for c in ids]
    got = rows_of(T.prefix_nodes(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and len(got) == 1 and got[0][3] == len(ids)


def test_empty_and_clashing(spark):
    assert T.prefix_nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    from pyspark.sql import functions as F
    df = spark.createDataFrame(ODD, SCHEMA)
    for c in ("n", "path", "tip", "lo", "hi", "exit", "chain", "leader", "at", "first", "h", "base", "key"):
        df = df.withColumn(c, F.lit(1))
    assert rows_of(T.prefix_nodes(df)) == brute(ODD)


def test_many_pieces_of_ends(spark):
    ids = [5 * c for c in range(0, 4000)]
    df = spark.createDataFrame([(b"x" * 16, c) for c in ids], "tip binary, conv_id long")
    assert T.end_hashes(df).collect()[0][1] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_fattest(spark):
    from pyspark.sql import functions as F
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 70)] + [(2**29 - 1, 2**29), (0, 2**30 - 1)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", T.fattest(F.col("a"), F.col("b")).alias("f")).collect()
    for a, b, f in got:
        step = f & -f
        assert a < f <= b and not any(x % (2 * step) == 0 for x in range(a + 1, b + 1) if b < 1000)
