"""The repeated side of a skewed join is shuffled, whatever the planner reckons of its size."""

import __spark_entry__ as E
from loomstone.operators import relational as R


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "BroadcastHashJoin" in plan, "SortMergeJoin" in plan


def test_repeated_side_is_never_broadcast(spark):
    big = spark.createDataFrame([(k % 3, k) for k in range(30)], "k int, v int").repartition(3)
    small = spark.createDataFrame([(0, 10), (1, 20), (1, 21)], "k int, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = R.skewed_join(big, small, ["k"], 4, how)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, big.join(small, "k", how).collect()), key=str)
        assert joins(got) == (False, True)
    assert joins(E.queries()["q_skewed_join"](spark, "/root/testdata/sf0.001")) == (False, True)
