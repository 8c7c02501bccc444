"""Registered queries with so low a bound that their groups are hot give the rows they give otherwise."""

import pytest
from helpers import DATA, rows_of, sql_rows
from pyspark.sql import functions as F

from chronica.operators import temporal
from chronica.operators.quantiles import group_quantiles
from chronica.operators.shards import HotGroups, running_sums, text_axis
from chronica.plans import core_queries as Q


@pytest.mark.parametrize("name", ["p2_found", "p6_found", "p6_esd"])
def test_hot_groups_change_nothing(spark, name):
    query = Q.queries()[name]
    small = query(spark, DATA, most_rows=20)
    assert rows_of(small) == (sql_rows(Q.oracle_sql()[name]) if name in Q.oracle_sql() else rows_of(query(spark, DATA)))


def test_quantiles_of_hot_groups(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(700)) / 7).alias("v"))
    df = df.unionByName(spark.createDataFrame([(None, 1.0), (None, 4.0), (9, None)], "k bigint, v double"))
    at = (0.0, 0.1, 0.5, 0.9, 1.0)
    hot = HotGroups(df, ["k"], 50)
    assert hot.any and not HotGroups(df, ["k"], 50, largest=3).any
    a, b = (group_quantiles(df, ["k"], F.col("v"), at, h).collect() for h in (hot, HotGroups(df, ["k"], 10**6)))
    near = lambda rows: {r["k"]: (r["n"], [round(x, 9) for x in r["q"]]) for r in rows}
    assert near(a) == near(b) and len(a) == 4
    empty = df.where("false")
    assert group_quantiles(empty, ["k"], F.col("v"), at, HotGroups(empty, ["k"], 5)).count() == 0


def test_running_sums_of_hot_groups(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("k"), "id", (F.col("id") % 5).alias("v"))
    a, b = (running_sums(df, ["k"], [F.col("id")], {"s": F.col("v"), "n": F.lit(1)}, F.col("id"), HotGroups(df, ["k"], m)).select("k", "id", "v", "s", "n") for m in (30, 10**6))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_a_shard_must_be_a_number(spark):
    df = spark.createDataFrame([("a", "2150-03"), ("a", "2150-04")], "k string, t string")
    with pytest.raises(TypeError):
        HotGroups(df, ["k"], 1).sharded(df, F.col("t"))
    texts = ["", "2150", "2150-03-01", "2150-03-02", "abc", "é", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text_axis(F.col("t"), 7)).collect()]
    assert got[:-1] == sorted(got[:-1]) and got[-1] is None


def test_windows_after_a_row_in_hot_keys(spark):
    df = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", "ts", "value")
    for run in (lambda m: temporal.sum_after(df, ["user_id"], "ts", "value", 6, "x", m), lambda m: temporal.raised_within(df, ["user_id"], "ts", "value", 24, "x", m)):
        a, b = ({r["event_id"]: r["x"] for r in run(m).collect()} for m in (5, 10**6))
        assert a.keys() == b.keys() and all(a[k] == b[k] or abs(a[k] - b[k]) < 1e-6 for k in a)


def test_islands_and_existence_in_hot_keys(spark):
    df = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", "ts", "value", "event_type")
    a, b = (sorted(map(tuple, temporal.low_islands(df, ["user_id"], "ts", "event_id", F.col("value") < 60, 12, m).collect())) for m in (5, 10**6))
    assert a == b and a
    rows, marks = df.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), df.where("event_type = 'click'")
    a, b = ({r["event_id"]: r["exists_within"] for r in temporal.exists_within(rows, marks, "user_id", "ts", "ts", 2, 1, most_rows=m).collect()} for m in (5, 10**6))
    assert a == b and set(a.values()) == {True, False}


def test_joins_within_a_window(spark):
    df = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", "ts")
    left, right = df.where("event_id % 3 = 0").withColumnRenamed("ts", "at"), df.withColumnsRenamed({"ts": "time", "event_id": "other"})
    got = temporal.join_within(left, right, "user_id", "at", "time", 24).select("event_id", "other")
    want = left.join(right, "user_id").where("time < at and time >= at - interval 24 hours").select("event_id", "other")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
