import random

import pytest
from pyspark.sql import functions as F

from recengine.operators import stats
from recengine.operators.selection import order_statistics


def test_summary_exact_median_and_smallest_mode(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 5.0), ("b", 3.0), ("b", 1.0), ("b", 1.0), ("b", 3.0), ("b", 9.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    per = {r.g: r for r in stats.summary(df, "x", ["g"]).collect()}
    assert per["a"].median == 2.0 and per["a"].mode == 2.0 and per["a"].min == 1.0 and per["a"].max == 5.0
    assert per["b"].median == 3.0 and per["b"].mode == 1.0          # tie 1/3 -> smaller
    whole = stats.summary(df, "x").first()
    assert whole.median == 2.0 and whole.mode == 1.0 and whole.mean == round(27 / 9, 6)


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (4.0,)], "x double")
    h = {r.bin: r["count"] for r in stats.histogram(df, "x", 4).collect()}
    assert h == {0: 1, 1: 1, 2: 1, 3: 1}


def test_null_group_and_null_values(spark):
    rows = [(None, 1.0), (None, 4.0), ("a", None), ("a", 2.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    per = {r.g: (r.median, r.mode) for r in stats.summary(df, "x", ["g"]).collect()}
    assert per == {None: (2.5, 1.0), "a": (2.0, 2.0), "b": (None, None)}
    assert [tuple(r) for r in stats.value_counts(df, "g").collect()] == [("a", 2), ("b", 1)]
    assert stats.summary(df.where("x > 99"), "x").first().median is None


def selected(spark, values, kind, ranks, group=None):
    df = spark.createDataFrame([(g, v) for g, v in values], f"g string, x {kind}").repartition(5)
    out = order_statistics(df, "x", {f"k{j}": F.lit(r) if isinstance(r, int) else r for j, r in enumerate(ranks)}, ["g"] if group else [])
    return out.collect()


@pytest.mark.parametrize("kind, draw", [("bigint", lambda r: r.randrange(-(2**60), 2**60)), ("bigint", lambda r: r.randrange(5)), ("int", lambda r: int(r.expovariate(1e-6))),
                                        ("double", lambda r: r.gauss(0, 1) * 10 ** r.randrange(-9, 9)), ("double", lambda r: 7.5)])
def test_order_statistics(spark, kind, draw):
    rng = random.Random(4)
    values = [(rng.choice(["a", "b", None]), draw(rng)) for _ in range(400)] + [("c", draw(rng)), ("a", None)]
    for r in selected(spark, values, kind, [1, F.floor(F.col("n") / 2), F.col("n"), 10**9], group=True):
        own = sorted(v for g, v in values if g == r.g and v is not None)
        for j, k in enumerate([1, len(own) // 2, len(own), len(own)]):
            k = max(k, 1)
            assert r[f"k{j}"] == own[k - 1] and r[f"k{j}_at"] == k - own.index(own[k - 1]) and r.n == len(own)
    whole = sorted(v for _, v in values if v is not None)
    got = selected(spark, values, kind, [17, 200])
    assert len(got) == 1 and (got[0].k0, got[0].k1) == (whole[16], whole[199])
    assert selected(spark, [("a", None)], kind, [1]) == []
