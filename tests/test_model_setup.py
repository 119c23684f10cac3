"""What the model queries share is built when asked for."""

import datetime

from recengine.operators import models as MD
from recengine.operators import splits as S
from recengine.plans import catalog_models as CM
from recengine.plans import fixtures

DAY = datetime.date(1995, 1, 1)


def tables(spark, folder):
    orders = [(o, o % 5, DAY + datetime.timedelta(o)) for o in range(40)]
    lines = [(o, (o * k) % 9, k, float(k + 1)) for o in range(40) for k in range(1, 4)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_lists_are_not_built_for_the_split(spark, tmp_path):
    sf = tables(spark, tmp_path)
    st = CM._Setup(spark, sf)
    train, test = st.train.count(), st.test.count()
    assert test == 5 and train + test == fixtures.interactions(spark, sf).count()
    assert "train_lists" not in vars(st) and "test_lists" not in vars(st)
    want = S.leave_one_out(st.inter).select("user_id", "item_id", "split")
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, st.train.unionByName(st.test).select("user_id", "item_id", "split").collect()))


def test_lists(spark, tmp_path):
    st = CM._Setup(spark, tables(spark, tmp_path))
    lists = st.test_lists
    assert "train_lists" not in vars(st) and lists.where("pos_in_list = 0").count() == st.test.count()
    assert lists.where("label = 0").join(st.inter, ["user_id", "item_id"]).count() == 0
    assert st.train_lists.where("label = 1").count() == st.train.count()


def test_both_scores_of_a_pair_stand_on_one_row(spark, tmp_path):
    out = CM.k4(spark, tables(spark, tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 4      # two of the model, two of the product
    assert tuple(out.first()) == (CM._setup(spark, str(tmp_path)).train.count(), True)


def test_als_blocks_grow_with_the_ratings(spark, monkeypatch):
    """A task of the fit holds a block of ratings, whatever their number; a fit of few has Spark's 10 blocks, as before."""
    data = spark.createDataFrame([(u, i, float((u * i) % 5)) for u in range(20) for i in range(10)], "user_id long, item_id long, rating double")
    assert MD.fit_als(data, rank=2, max_iter=1).userFactors.rdd.getNumPartitions() == 10
    monkeypatch.setattr(MD, "ALS_BLOCK_ROWS", 15, raising=False)
    model = MD.fit_als(data, rank=2, max_iter=3)
    assert model.userFactors.rdd.getNumPartitions() == 14 and model.itemFactors.rdd.getNumPartitions() == 14
    assert model.userFactors.count() == 20 and model.itemFactors.count() == 10
