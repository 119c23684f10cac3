import duckdb

import __spark_entry__ as entry
from recengine.sources.tables import TABLES, path

from conftest import SF001


def test_entry_runs_with_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["k", "metric", "value"]
    rows = df.collect()
    assert len(rows) == 20
    hr = {r.k: r.value for r in rows if r.metric == "HR"}
    assert hr[1] <= hr[3] <= hr[5] <= hr[10]


def test_every_oracle_has_a_query():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 100


def _compare(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path(SF001, t)}')")
    s = entry.queries()[name](spark, SF001)
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(s.columns) == sorted(cols)
    order = sorted(cols)
    a = sorted(tuple(r[c] for c in order) for r in s.collect())
    b = sorted(tuple(dict(zip(cols, r))[c] for c in order) for r in res.fetchall())
    assert a == b


def test_flagship_matches_oracle(spark):
    _compare(spark, "L6_evaluate_popularity")


def test_negatives_match_oracle(spark):
    _compare(spark, "J13_negative_sampling")


def test_range_path_matches_oracle(spark):
    _compare(spark, "J6_tail_split_range_path")
