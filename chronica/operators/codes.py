"""Code tables: first key wins, longest prefix, ordered patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A lookup table: of equal keys the one with the least ``order``, its value cut at the first comma."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))
    return first.withColumn(value, F.trim(F.split(F.col(value), ",")[0]))


def longest_prefix(codes: DataFrame, code: str, lookup: DataFrame, lookup_code: str, value: str, least: int = 3) -> DataFrame:
    """``codes`` with the value of the longest proper or equal prefix, of ``least`` characters or more, in the lookup.

    The distinct codes are expanded to their prefixes, so the join is on equality and each code
    is resolved once however often it stands in the rows.
    """
    distinct = codes.select(F.col(code).alias("c")).where("c is not null").distinct().where(F.length("c") >= least)
    prefixes = distinct.select("c", F.explode(F.sequence(F.lit(least), F.length("c"))).alias("n"))
    prefixes = prefixes.select("c", "n", F.substring(F.col("c"), F.lit(1), F.col("n")).alias("p"))
    table = lookup.select(F.col(lookup_code).alias("p"), F.col(value).alias("found"))
    hit = prefixes.join(table, "p").groupBy("c").agg(F.max_by("found", "n").alias(value), F.max("n").alias("prefix_length"))
    return codes.join(hit, F.col(code) == F.col("c"), "left").drop("c")


def first_pattern(name: Column, patterns: list[tuple[str, str]], excluded: str | None = None) -> Column:
    """The class of the first pattern that a name matches, without regard to case; null if none or excluded."""
    out = F.when(name.rlike(f"(?i){excluded}"), F.lit(None).cast("string")) if excluded else F.when(F.lit(False), F.lit(""))
    for pattern, label in patterns:
        out = out.when(name.rlike(f"(?i){pattern}"), label)
    return out


def prefix_flag(code: Column, version: Column, prefixes: dict[str, list[str]]) -> Column:
    """Whether a code starts with one of the prefixes of its version."""
    out = F.lit(False)
    for v, starts in prefixes.items():
        for start in starts:
            out = out | ((version == v) & code.startswith(start))
    return F.coalesce(out, F.lit(False))


def misses(rows: DataFrame, code: str, value: str, keys: list[str]) -> DataFrame:
    """Rows, rows without a value and distinct codes without one, by ``keys``."""
    gone = F.col(value).isNull()
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(gone).alias("missed"), F.count_distinct(F.when(gone, F.col(code))).alias("codes_missed"))
