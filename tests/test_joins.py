"""Joins on hot keys: the same rows as a plain join, dealt to many tasks."""

import pytest
from pyspark.sql import functions as F

from usage_ts.operators.joins import salted


@pytest.fixture(scope="module")
def sides(spark):
    many = spark.range(2000).select("id", F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "b").alias("k"))
    few = spark.createDataFrame([("hot", 1), ("b", 2), (None, 3), ("unused", 4)], "k string, `v.x` int")
    return many, few


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_same_rows_as_a_plain_join(sides, how, null_safe):
    many, few = sides
    got = sorted((r["id"], r["k"] or "", r["v.x"] or 0) for r in salted(many, few, ["k"], how, null_safe).collect())
    value = {"hot": 1, "b": 2, None: 3 if null_safe else 0}
    key = lambda i: "hot" if i % 10 < 7 else "b" if i % 10 < 9 else None
    want = [(i, key(i) or "", value[key(i)]) for i in range(2000) if how == "left" or value[key(i)]]
    assert got == want


def test_empty_sides(sides):
    many, few = sides
    assert salted(many.limit(0), few, ["k"]).count() == 0
    assert salted(many, few.limit(0), ["k"], "left").count() == 2000


def test_a_hot_key_is_dealt_to_many_tasks(spark, sides):
    many, few = sides
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = salted(many, few, ["k"])._jdf.queryExecution().executedPlan().toString()
        dealt = plan.split("hashpartitioning(", 1)[1].split(")")[0]
        assert "k#" in dealt and "_salt#" in dealt
        assert salted(many, few, ["k"]).count() == 1800
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_side_is_broadcast_once_and_a_large_one_never(spark, sides):
    many, few = sides
    small = plan_of(salted(many, few, ["k"]))
    assert "BroadcastHashJoin" in small and "_salt" not in small
    # Estimated at a few megabytes, 64 times as much once it is copied.
    large = spark.range(700_000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))
    joined = salted(many, large, ["k"])
    assert "Broadcast" not in plan_of(joined) and "_salt" in plan_of(joined)
    assert joined.count() == 0
    keyed = many.withColumn("k", F.col("id").cast("string"))
    assert salted(keyed, large, ["k"]).count() == 2000
