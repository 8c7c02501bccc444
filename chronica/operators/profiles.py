"""Visits and profiles: sets with first times, what an index visit may show, pairs over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EMPTY = "array<string>"


def visit_items(visits: DataFrame, key: str, lists: dict[str, str | None]) -> DataFrame:
    """One row per visit, kind and item with its first stamp: (key, kind, item, first_stamp).

    ``lists`` maps a list column to the map column with its stamps. All rows of a visit count together.
    Names are trimmed, in lower case, with single blanks; a stamp is compared as text after its ``T`` is a blank.
    """
    parts = []
    for names, stamps in lists.items():
        each = visits.select(F.col(key), F.lit(names).alias("kind"), F.explode(names).alias("raw"), (F.col(stamps) if stamps else F.lit(None).cast("map<string,string>")).alias("m"))
        item = F.lower(F.trim(F.regexp_replace("raw", r"\s+", " ")))
        stamp = F.translate(F.try_element_at("m", F.col("raw")), "T", " ")
        parts.append(each.where(F.col("raw").isNotNull()).select(key, "kind", item.alias("item"), stamp.alias("stamp")).where("item <> ''"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(key, "kind", "item").agg(F.min("stamp").alias("first_stamp"))


def with_enough(items: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Visits with at least ``least`` items, as sorted arrays by kind."""
    by = items.groupBy(key).agg(*[F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("item")))).alias(k) for k in ("conditions", "procedures", "drugs")])
    return by.where(F.size("conditions") + F.size("procedures") + F.size("drugs") >= least)


def index_cut(profiles: DataFrame, chronic: list[str]) -> DataFrame:
    """What the index visit of each profile may show: (dose_id, kind, concept).

    Procedures and drugs stamped before the index time, a date only against its day; conditions
    that are chronic or stood in an earlier visit.
    """
    none = F.array().cast(EMPTY)
    t0 = F.translate("index_t0", "T", " ")
    earlier = F.array_distinct(F.flatten(F.transform(F.filter("visits", lambda v: ~v.is_index), lambda v: F.coalesce(v.conditions, none))))
    index = profiles.select("dose_id", t0.alias("t0"), earlier.alias("known"), F.explode(F.filter("visits", lambda v: v.is_index)).alias("v"))
    shown = index.select("dose_id", "t0", "known", "v", F.inline(F.array(
        F.struct(F.lit("conditions").alias("kind"), F.coalesce("v.conditions", none).alias("names")), F.struct(F.lit("procedures").alias("kind"), F.coalesce("v.procedures", none).alias("names")),
        F.struct(F.lit("drugs").alias("kind"), F.coalesce("v.drugs", none).alias("names")),
    )))
    each = shown.select("dose_id", "t0", "known", "kind", F.col("v.concept_times").alias("m"), F.explode("names").alias("concept"))
    stamp = F.translate(F.try_element_at("m", F.col("concept")), "T", " ")
    before = F.when(F.length(stamp) <= 10, stamp < F.substring("t0", 1, 10)).otherwise(stamp < F.col("t0"))
    kept = F.when(F.col("kind") == "conditions", F.col("concept").isin(chronic) | F.array_contains("known", F.col("concept"))).otherwise(before)
    return each.where(F.coalesce(kept, F.lit(False))).select("dose_id", "kind", "concept").distinct()


def consecutive_pairs(profiles: DataFrame) -> DataFrame:
    """Pairs of concepts in two visits that follow each other: (dose_id, a, b, newest), a pair once with its newest visit.

    The arrays of one visit and the next are combined, so the pairs of a profile are bounded by the sizes of two visits.
    """
    none = F.array().cast(EMPTY)
    v = profiles.select("dose_id", F.explode("visits").alias("v")).select("dose_id", F.col("v.number").alias("n"), F.array_distinct(F.concat(F.coalesce("v.conditions", none), F.coalesce("v.procedures", none), F.coalesce("v.drugs", none))).alias("c"))
    v = v.where(F.size("c") > 0).distinct()
    order = Window.partitionBy("dose_id").orderBy("n")
    two = v.withColumn("next", F.lead("c").over(order)).withColumn("m", F.lead("n").over(order)).where("next is not null")
    pairs = two.select("dose_id", "m", F.explode("c").alias("x"), "next").select("dose_id", "m", "x", F.explode("next").alias("y")).where("x <> y")
    return pairs.groupBy("dose_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("m").alias("newest"))
