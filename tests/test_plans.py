from pyspark.sql import functions as F

from recengine.plans.flagship import evaluate_popularity
from recengine.sources.tables import load

from conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_has_no_cartesian(spark):
    p = _plan(evaluate_popularity(spark, SF001))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scan_prunes_columns_and_pushes_filters(spark):
    li = load(spark, SF001, "lineitem").filter(F.col("l_quantity") > 10).select("l_orderkey", "l_quantity")
    p = li._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p
