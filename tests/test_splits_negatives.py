import datetime as dt

from pyspark.sql import functions as F

from recengine.operators import negatives as N
from recengine.operators import splits as S
from recengine.operators.interactions import completion_rating

COLS = "user_id long, item_id long, rating double, ts timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def _users(spark, sizes, same_ts=False):
    rows = []
    for u, n in enumerate(sizes):
        for i in range(n):
            rows.append((u, 100 * u + i, 1.0, T0 if same_ts else T0 + dt.timedelta(days=i)))
    return spark.createDataFrame(rows, COLS)


def test_leave_one_out_and_tail_split(spark):
    df = _users(spark, [1, 2, 3, 5, 10])
    loo = {(r.user_id, r.item_id): r.split for r in S.leave_one_out(df).collect()}
    for u, n in enumerate([1, 2, 3, 5, 10]):
        assert loo[(u, 100 * u + n - 1)] == "test"
        assert sum(1 for (uu, _), s in loo.items() if uu == u and s == "test") == 1
    tail = S.tail_split(df, 0.2).groupBy("user_id").agg(F.sum((F.col("split") == "test").cast("int")).alias("t"))
    assert {r.user_id: r.t for r in tail.collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2}


def test_equal_timestamps_break_by_item(spark):
    df = _users(spark, [3], same_ts=True)
    test = S.leave_one_out(df).filter("split = 'test'").collect()
    assert [r.item_id for r in test] == [0]
    second = S.leave_one_out(df, train="second").filter("split = 'train'").collect()
    assert [r.item_id for r in second] == [1]


def test_repeated_items_give_one_test_row(spark):
    rows = [(1, 7, T0), (1, 8, T0 + dt.timedelta(days=1)), (1, 7, T0 + dt.timedelta(days=2)), (2, 5, None), (2, 6, T0), (3, 5, None), (3, 4, None)]
    df = spark.createDataFrame([(u, i, 1.0, t) for u, i, t in rows], COLS)
    got = sorted((r.user_id, r.item_id, r.ts) for r in S.leave_one_out(df).filter("split = 'test'").collect() if r.ts)
    assert got == [(1, 7, T0 + dt.timedelta(days=2)), (2, 6, T0)]
    assert [r.item_id for r in S.leave_one_out(df).filter("split = 'test' and user_id = 3").collect()] == [4]
    second = S.leave_one_out(df, train="second").filter("split = 'train'").collect()
    assert sorted((r.user_id, r.item_id) for r in second) == [(1, 8), (2, 5), (3, 5)]


def test_position_breaks_ties_and_tells_equal_rows_apart(spark):
    rows = [("a", "x", 5, 2), ("a", "x", 5, 1), ("a", "x", 5, 0), ("a", "b", 4, 3), ("b", "q", 1, 4), (None, "q", 1, 5), (None, "q", 1, 6)]
    df = spark.createDataFrame(rows, "user_id string, item_id string, ts long, pos long")
    got = {r.pos: r.split for r in S.leave_one_out(df, pos="pos").collect()}
    assert got == {2: "train", 1: "train", 0: "test", 3: "train", 4: "test", 5: "test", 6: "train"}
    got = {r.pos: r.split for r in S.leave_one_out(df, train="second", pos="pos").collect()}
    assert got == {0: "test", 1: "train", 4: "test", 5: "test", 6: "train"}
    ranks = {r.pos: r.recency_rank for r in S.recency_rank(df, pos="pos").collect()}
    assert ranks == {0: 1, 1: 2, 2: 3, 3: 4, 4: 1, 5: 1, 6: 2}


def test_times_of_any_kind(spark):
    for kind, cast in (("date", "date_add(date'2024-01-01', cast(k as int))"), ("timestamp", "timestamp'2024-01-01' + make_dt_interval(k)"), ("double", "k / 2.0")):
        df = spark.sql(f"select 1 as user_id, k as item_id, {cast} as ts from (select explode(sequence(0, 5)) as k)")
        assert [r.item_id for r in S.leave_one_out(df).filter("split = 'test'").collect()] == [5], kind
    import pytest
    with pytest.raises(TypeError):
        S.leave_one_out(spark.createDataFrame([(1, 2, "x")], "user_id long, item_id long, ts string"))


def test_exact_splits_with_repeated_rows_and_small_tables(spark):
    # copies of one row have one hash: the cut goes through them, by count
    df = spark.createDataFrame([(1, 1)] * 30 + [(2, k) for k in range(7)], "user_id long, item_id long")
    got = {r.split: r["count"] for r in S.exact_random_split(df, (0.8, 0.1)).groupBy("split").count().collect()}
    assert got == {"train": 29, "valid": 3, "test": 5}
    for n, want in ((0, {}), (1, {"test": 1}), (2, {"train": 1, "test": 1})):
        got = {r.split: r["count"] for r in S.exact_random_split(spark.range(n).selectExpr("id as user_id", "id as item_id"), (0.8, 0.1)).groupBy("split").count().collect()}
        assert got == want
    strata = df.selectExpr("user_id", "item_id", "case when user_id = 1 then 'a' end as s")
    got = {(r.s, r.split): r["count"] for r in S.stratified_split(strata, "s", 0.1).groupBy("s", "split").count().collect()}
    assert got == {("a", "test"): 3, ("a", "train"): 27, (None, "test"): 1, (None, "train"): 6}


def test_random_split_is_partition_independent(spark):
    df = _users(spark, [7, 9, 11])
    a = sorted(tuple(r) for r in S.random_within_user(df.repartition(1), 0.3, 7).select("item_id", "split").collect())
    b = sorted(tuple(r) for r in S.random_within_user(df.repartition(5), 0.3, 7).select("item_id", "split").collect())
    assert a == b


def test_negatives_exact_edge_cases(spark):
    # pool = items 0..9; user 0 saw all; user 1 saw all but item 9; user 2 saw one item
    rows = [(0, i) for i in range(10)] + [(1, i) for i in range(9)] + [(2, 0)]
    seen = spark.createDataFrame(rows, "user_id long, item_id long")
    negs = N.sample_negatives(seen, 4, seed=3, salt="t")
    got = {}
    for r in negs.collect():
        got.setdefault(r.user_id, []).append((r.neg_rank, r.item_id))
    assert 0 not in got                                  # nothing unseen
    assert got[1] == [(1, 9)]                            # exactly the one unseen item
    assert len(got[2]) == 4 and all(i != 0 for _, i in got[2])
    assert sorted(k for k, _ in got[2]) == [1, 2, 3, 4]
    under = {r.user_id: r.n_drawn for r in N.underfilled(negs, seen, 4).collect()}
    assert under == {0: 0, 1: 1}


def test_pool_smaller_than_n_and_no_seen_items(spark):
    rows = [(u, i) for u in range(30) for i in range(0, 40, (u % 5) + 1)]
    seen = spark.createDataFrame(rows, "user_id long, item_id long")
    negs = N.sample_negatives(seen, 50, seed=1, salt="t")
    assert negs.join(seen, ["user_id", "item_id"], "left_semi").count() == 0
    per_user = {r.user_id: r.c for r in negs.groupBy("user_id").agg(F.count("*").alias("c")).collect()}
    pool = 40
    for u in range(30):
        n_seen = len(range(0, 40, (u % 5) + 1))
        assert per_user.get(u, 0) == min(50, pool - n_seen)


def test_negatives_same_under_partitioning_and_no_cartesian(spark):
    rows = [(u, (u * 7 + i) % 50) for u in range(40) for i in range(10)]
    seen = spark.createDataFrame(rows, "user_id long, item_id long")
    a = sorted(tuple(r) for r in N.sample_negatives(seen.repartition(1), 5, 9, "t").collect())
    b = sorted(tuple(r) for r in N.sample_negatives(seen.repartition(7), 5, 9, "t").collect())
    assert a == b
    plan = N.sample_negatives(seen, 5, 9, "t")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_disjoint_train_test_negatives(spark):
    rows = [(u, i) for u in range(20) for i in range(u, u + 5)]
    seen = spark.createDataFrame(rows, "user_id long, item_id long")
    d = N.train_test_negatives(seen, 4, 10, seed=2, disjoint=True)
    tr = d.filter("split = 'train'").select("user_id", "item_id")
    te = d.filter("split = 'test'").select("user_id", "item_id")
    assert tr.join(te, ["user_id", "item_id"]).count() == 0


def test_labelled_lists_positive_first(spark):
    pos = spark.createDataFrame([(1, 10), (1, 11)], "user_id long, item_id long")
    neg = spark.createDataFrame([(1, 50, 1), (1, 51, 2)], "user_id long, item_id long, neg_rank long")
    lists = N.labelled_lists(pos, neg).collect()
    assert len(lists) == 6
    firsts = [r for r in lists if r.pos_in_list == 0]
    assert {(r.list_item, r.item_id, r.label) for r in firsts} == {(10, 10, 1.0), (11, 11, 1.0)}


def test_completion_rating(spark):
    df = spark.createDataFrame([(0.0,), (0.2,), (0.8,), (1.0,), (1.5,)], "p double")
    got = [r.c for r in df.select(completion_rating("p", 0.8).alias("c")).collect()]
    assert got == [0.0, 5 * (0.25 ** 0.5), 5.0, 5.0, 5.0]


def test_second_leg_gives_the_same_rows(spark):
    rows = [(u, (u * 11 + i * 3) % 60) for u in range(25) for i in range(u + 1)]
    seen = spark.createDataFrame(rows, "user_id long, item_id long")
    full = sorted(tuple(r) for r in N.sample_negatives(seen, 6, 5, "t").collect())
    # a one-slot first leg forces nearly every user through the second leg
    tiny = sorted(tuple(r) for r in N.sample_negatives(seen, 6, 5, "t", first_leg_scale=0.0,
                                                       first_leg_margin=1).collect())
    assert full == tiny


def test_listed_users_draw_in_their_row(spark):
    rows = [(u, (u * 11 + i * 3) % 60) for u in range(25) for i in range(2 * u + 1)] + [(30, None), (None, 5), (None, 7)]
    seen = spark.createDataFrame(rows, "user_id long, item_id long")
    draw = N.sample_negatives(seen, 6, 5, "t")
    plan = draw._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Generate") == 1      # no slot is a row, none is shuffled
    rows = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    assert rows(draw) == rows(N.sample_negatives(seen, 6, 5, "t", listed=4)) == rows(N.sample_negatives(seen, 6, 5, "t", listed=-1))
    # a slot's place follows from its user: md5 is no part of the walk over the slots
    assert all("md5" not in line for line in plan.splitlines() if "transform(" in line)


def test_approximate_modes(spark):
    rows = [(u, i, float(i % 5)) for u in range(200) for i in range(20)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    s = S.approximate_stratified_split(df, 0.1, seed=3)
    share = s.filter("split = 'test'").count() / 4000
    assert 0.07 < share < 0.13
    r = S.approximate_random_split(df, (0.8, 0.1, 0.1), seed=3)
    assert r.count() == 4000 and {x.split for x in r.select("split").distinct().collect()} == {"train", "valid", "test"}
