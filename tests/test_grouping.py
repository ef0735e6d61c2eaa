"""Skew-proof grouping and joining against brute force, with every key treated as hot or not."""

import random

import pytest
from pyspark.sql import functions as F

from codequarry.functions.grouping import first_wins, skew_join, top_per_group


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    # one key holds a third of the rows
    return [(0 if rng.random() < 0.34 else rng.randrange(1, 40), i, rng.randrange(1000))
            for i in range(3000)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [1, 500, 10**9])
def test_skew_join_equals_plain_join(spark, rows, how, hot_rows):
    nameless = [(None, 10_000 + i, i) for i in range(50)]
    big = spark.createDataFrame(rows + nameless, "k INT, i INT, x INT").repartition(4)
    small = spark.createDataFrame([(k, f"v{k}") for k in range(0, 30, 2)], "k INT, v STRING")
    ours = skew_join(big, small, ["k"], how, ["i"], hot_rows=hot_rows, slots=5, max_hot=3)
    plain = big.join(small, "k", how)
    assert ours.columns == plain.columns
    assert sorted(map(repr, ours.collect())) == sorted(map(repr, plain.collect()))


def test_hot_key_is_spread(spark, rows):
    big = spark.createDataFrame(rows, "k INT, i INT, x INT")
    small = spark.createDataFrame([(0, "hot"), (1, "cold")], "k INT, v STRING")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew_join(big, small, ["k"], "inner", ["i"], hot_rows=500, slots=16)
        tasks = joined.where("k = 0").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tasks > 4


@pytest.mark.parametrize("k", [1, 7, 400])
def test_top_per_group(spark, rows, k):
    df = spark.createDataFrame(rows, "k INT, i INT, x INT")
    ours = top_per_group(df, ["k"], ["-x", "i"], k, slots=4, rank="r")
    want = []
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[1]))
        want += [(*r, n + 1) for n, r in enumerate(group[:k])]
    assert sorted(map(tuple, ours.collect())) == sorted(want)


def test_first_wins_is_not_arbitrary(spark, rows):
    df = spark.createDataFrame(rows, "k INT, i INT, x INT")
    want = sorted(min((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
                  for key in {r[0] for r in rows})
    for parts in (1, 9):
        got = first_wins(df.repartition(parts), ["k"], ["x", "i"]).collect()
        assert sorted(map(tuple, got)) == want


def test_dedupe_limits_groups_before_the_shuffle(spark, rows):
    df = spark.createDataFrame(rows, "k INT, i INT, x INT")
    plan = first_wins(df, ["k"], ["x"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    below = plan[plan.index("Exchange"):]
    assert "Partial" in below
