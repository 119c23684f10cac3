"""Bitmaps against Python sets."""

import random

from pyspark.sql import functions as F

from recengine.operators import itemsets as S

RNG = random.Random(2)
PAIRS = ([(u, RNG.randrange(200_000)) for u in range(5) for _ in range(60)] + [(9, k) for k in range(65_400, 65_700)] + [(None, 3), (7, None), (7, 0), (7, 0), (8, 63), (8, 64), (8, 2**31 + 5), (8, 65_535)])


def sets_of(rows):
    out = {}
    for u, i in rows:
        if i is not None:
            out.setdefault(u, set()).add(i)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id long, item_idx long").repartition(4)


def test_build_and_read_back(spark):
    want = sets_of(PAIRS)
    sets = S.item_sets(frame(spark, PAIRS))
    assert sets_of([tuple(r) for r in S.items_of(sets).collect()]) == want
    assert {r.user_id: r.n_items for r in S.set_sizes(sets).collect()} == {u: len(s) for u, s in want.items()}
    assert sets.where("user_id = 9").count() == 2 and sets.agg(F.max(F.size("words"))).first()[0] <= 1024


def test_membership(spark):
    want = sets_of(PAIRS)
    asked = [(u, RNG.randrange(200_000)) for u in (0, 1, 9, 55, None)] + [(u, i) for u, i in PAIRS if i is not None] + [(8, 65), (8, 5), (9, 65_399), (None, 4)]
    sets = S.item_sets(frame(spark, PAIRS))
    got = sorted(S.without(frame(spark, asked), sets).collect(), key=str)
    assert [tuple(r) for r in got] == sorted(((u, i) for u, i in asked if i not in want.get(u, ())), key=lambda t: str(spark.createDataFrame([t], "user_id long, item_idx long").first()))
    assert S.within(frame(spark, asked), sets).count() == sum(i in want.get(u, ()) for u, i in asked)


def test_pool_minus(spark):
    want, pool = sets_of(PAIRS), {0, 3, 63, 64, 65, 65_401, 130_000}
    users = frame(spark, [(u, 0) for u in (0, 7, 8, 9, 77)])
    rest = S.pool_minus(S.item_sets(spark.createDataFrame([(1, i) for i in pool], "owner long, item_idx long"), "owner"), S.item_sets(frame(spark, PAIRS)), users)
    assert sets_of([tuple(r) for r in S.items_of(rest).collect()]) == {u: pool - want.get(u, set()) for u in (0, 7, 8, 9, 77)}


def test_empty(spark):
    assert S.item_sets(frame(spark, [])).count() == 0
    assert S.without(frame(spark, [(1, 2)]), S.item_sets(frame(spark, []))).count() == 1


def test_no_work_per_word_or_bit_is_interpreted_twice(spark):
    """The users' maps are built under the join, the pool's words join last, and bits are told by a filter."""
    users = frame(spark, [(1, 0), (2, 0)])
    rest = S.pool_minus(S.item_sets(spark.createDataFrame([(1, 3)], "owner long, item_idx long"), "owner"), S.item_sets(frame(spark, PAIRS)), users)
    plan = S.items_of(rest)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("map_from_entries" in x for x in plan)
    assert not any("map_from_entries" in x and "transform(" in x for x in plan)
    assert all("lambda" not in x for x in plan if "getbit" in x)
    joins = [x for x in plan if " Join " in x or x.strip().startswith("Join")]
    assert "__pb" in joins[0] and "__b" in joins[1]
