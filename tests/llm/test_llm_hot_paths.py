"""Registered queries with so low a bound that their groups are hot, tasks many or baskets cut give the rows they give otherwise."""

import pytest
from helpers import DATA, rows_of, sql_rows
from pyspark.sql import functions as F

from chronica.llm import cooccurrence, mixing, sql
from chronica.llm import queries as Q


@pytest.mark.parametrize("name, bound", [("p1_found", {"edges_per_task": 3}), ("p4_found", {"most_rows": 10}), ("p7_found", {"most_rows": 1})])
def test_hot_groups_change_nothing(spark, name, bound):
    assert rows_of(Q.queries()[name](spark, DATA, **bound)) == sql_rows(sql.oracle_sql()[name])


def test_cut_baskets_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "MOST_IN_BLOCK", 3)
    assert rows_of(Q.p3_pairs(spark, DATA)) == sql_rows(sql.P3_PAIRS)


def test_cells_are_bounded_whatever_the_data_hold(spark):
    df = spark.range(3000).select(F.col("id"), F.lit("s").alias("src"), F.col("id").cast("string").alias("lang"), F.md5(F.col("id").cast("string")).alias("topic"), (F.col("id") % 97 + 1).alias("z"))
    out = mixing.mix(df, "id", "src", F.col("lang"), F.col("topic"), "z", [("s", 1.0, 2)], total=100_000.0)
    got = out.agg(F.sum("z").alias("z"), F.count_distinct("language", "topic").alias("k")).first()
    assert got["k"] == 1 and abs(got["z"] - 100_000) <= 97
    by = {(r["margin"], r["value"]): r["share"] for r in mixing.margins(out, "src", "z").collect()}
    assert by == {("source", "s"): 1.0, ("language", "other"): 1.0, ("topic", "other"): 1.0}


def test_hot_sizes_are_packed_alike(spark):
    from chronica.llm import packing

    df = spark.range(4000).select(F.col("id"), (F.col("id") % 7 + F.when(F.col("id") % 500 == 0, 60).otherwise(0)).alias("z"))
    a, b = (packing.pack(df, "id", "z", [("ten", 10), ("forty", 40)], most_rows=m) for m in (50, 10**6))
    assert rows_of(a) == rows_of(b)
