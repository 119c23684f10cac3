from pyspark.sql import Window
from pyspark.sql import functions as F

from recengine.operators.ordering import dense_index, ranked
from recengine.plans.fixtures import interactions

from conftest import SF001


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_agrees_with_a_window(spark):
    inter = interactions(spark, SF001)
    order = [F.col("ts").desc(), F.col("item_id").asc()]
    w = Window.partitionBy("user_id")
    a = inter.withColumn("r", F.row_number().over(w.orderBy(*order)).cast("bigint")).withColumn("n", F.count(F.lit(1)).over(w))
    b = ranked(inter, ["user_id"], order, "r", "n", num_partitions=5)
    assert _rows(a, ["user_id", "item_id", "r", "n"]) == _rows(b, ["user_id", "item_id", "r", "n"])
    assert dict(a.dtypes)["r"] == dict(b.dtypes)["r"] == "bigint"


def test_dense_index_is_contiguous(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("k"))
    idx = dense_index(df, ["k"], "i", num_partitions=7)
    assert [r.i for r in idx.orderBy("k").collect()] == list(range(5000))


def test_hot_group_spans_partitions_and_ranks_exactly(spark):
    # one user holds a third of all rows
    hot = spark.range(0, 3000).select(F.lit(1).alias("u"), F.col("id").alias("x"))
    cold = spark.range(0, 6000).select((F.col("id") % 600 + 2).alias("u"), F.col("id").alias("x"))
    df = hot.unionByName(cold)
    r = ranked(df, ["u"], [F.col("x").desc()], "r", "n", num_partitions=8)
    h = r.filter("u = 1").orderBy(F.col("x").desc()).collect()
    assert [row.r for row in h] == list(range(1, 3001))
    assert {row.n for row in h} == {3000}
    c = r.filter("u = 2").orderBy(F.col("x").desc()).collect()
    assert [row.r for row in c] == list(range(1, len(c) + 1))


def test_range_path_has_no_single_partition_window(spark):
    df = spark.range(0, 2000).select((F.col("id") % 10).alias("u"), F.col("id").alias("x"))
    plan = ranked(df, ["u"], ["x"], "r")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "SinglePartition" not in plan or "Window" not in plan.split("SinglePartition")[0][-200:]


def test_null_groups_keep_their_rows(spark):
    rows = [(1, 10), (1, 11), (None, 12), (None, 13)]
    df = spark.createDataFrame(rows, "g int, o int")
    want = [(1, 10, 1, 2), (1, 11, 2, 2), (None, 12, 1, 2), (None, 13, 2, 2)]
    got = ranked(df, ["g"], ["o"], size_col="n").select("g", "o", "rank", "n").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
