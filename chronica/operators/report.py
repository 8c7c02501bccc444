"""Counts, shares, quantiles and metrics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronica.operators.quantiles import group_quantiles
from chronica.operators.shards import HotGroups


def funnel(rows: DataFrame, unit: str, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step, label, n_rows, n_units, dropped) of successive filters, in one pass over the rows.

    Each unit is first reduced to how many of its rows pass every step, combined before the shuffle. A null unit is none.
    """
    passed, counts = F.lit(True), []
    for i, (_, cond) in enumerate(steps):
        passed = passed & F.coalesce(cond, F.lit(False))
        counts.append(F.count_if(passed).alias(f"n{i}"))
    by = rows.groupBy(unit).agg(*counts)
    aggs = [c for i in range(len(steps)) for c in (F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}"), F.count_if((F.col(f"n{i}") > 0) & F.col(unit).isNotNull()).alias(f"u{i}"))]
    one = by.agg(*aggs)
    entries = [F.struct(F.lit(i).alias("step"), F.lit(label).alias("label"), F.col(f"n{i}").alias("n_rows"), F.col(f"u{i}").alias("n_units")) for i, (label, _) in enumerate(steps)]
    flat = one.select(F.inline(F.array(*entries)))
    before = F.lag("n_rows").over(Window.orderBy("step"))  # one row per step
    return flat.withColumn("dropped", F.coalesce(before - F.col("n_rows"), F.lit(0)))


def value_counts(rows: DataFrame, column: Column, name: str = "value", digits: int = 2, top: int | None = None) -> DataFrame:
    """(value, n, percent) of a column, a null written as ``null``; of the ``top`` most common ones, ties by value, if given."""
    by = rows.groupBy(F.coalesce(column.cast("string"), F.lit("null")).alias(name)).agg(F.count(F.lit(1)).alias("n"))
    every = max(1, rows.count())
    if top is not None:
        by = by.orderBy(F.col("n").desc(), name).limit(top)
    return by.withColumn("percent", F.round(F.col("n") * 100.0 / every, digits))


def quantiles(
    rows: DataFrame, keys: list[str], value: str, at: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9), most_rows: int = 500_000
) -> DataFrame:
    """Exact quantiles with linear interpolation, over counts of distinct values; groups of more than ``most_rows`` are cut by value."""
    by = group_quantiles(rows, keys, F.col(value), at, HotGroups(rows, keys, most_rows))
    return by.select(*keys, "n", *[F.get("q", F.lit(i)).alias(f"p{round(p * 100):02d}") for i, p in enumerate(at)])


def crosstab(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by ``row`` with one column per value; no rows count as 0."""
    return rows.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def error_metrics(rows: DataFrame, truth: Column, predicted: Column, keys: list[str] | None = None) -> DataFrame:
    """n, mean absolute error, mean absolute percentage error and the share within 20 %."""
    off = F.abs(truth - predicted)
    grouped = rows.groupBy(*keys) if keys else rows.groupBy()
    return grouped.agg(
        F.count(off).alias("n"), F.avg(off).alias("mae"), (F.avg(off / F.nullif(truth, F.lit(0.0))) * 100).alias("mape"),
        (F.avg(F.when(off <= 0.2 * truth, 1.0).otherwise(0.0)) * 100).alias("within_20"),
    )


def cover(rows: DataFrame, entity: str, feature: str, features: DataFrame) -> DataFrame:
    """Distinct entities with each feature; features that nobody has count 0."""
    by = rows.groupBy(feature).agg(F.count_distinct(entity).alias("n"))
    return features.join(by, feature, "left").select(feature, F.coalesce("n", F.lit(0)).alias("n"))


def nearest_rank(values: Column, q: float) -> Column:
    """The nearest-rank percentile of an array: the element at the floor of q times its length."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    return F.get(ordered, F.least(n - 1, F.floor(n * q).cast("int")))


def binary_scores(rows: DataFrame, predicted: Column, gold: Column) -> DataFrame:
    """True and false positives, misses, precision, recall and F1; 0 where undefined."""
    by = rows.agg(F.count_if(predicted & gold).alias("tp"), F.count_if(predicted & ~gold).alias("fp"), F.count_if(~predicted & gold).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return by.select("tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def best_threshold(rows: DataFrame, score: str, gold: Column, shards: int = 64) -> DataFrame:
    """The threshold with the best F1 for ``score >= threshold``, the lowest on ties: (threshold, f1).

    Works on one row per distinct score. The scores are cut into shards at approximate quantiles, so
    that the running counts of each shard start from the sums of those above it; where the cuts
    fall never changes a count. Null scores take no part; without a score there is no row.
    """
    by = rows.where(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.count_if(gold).alias("g"))
    cuts = sorted(set(by.approxQuantile(score, [k / shards for k in range(1, shards)], 0.01)))
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col(score))) if cuts else F.lit(0)
    parts = by.withColumn("shard", above)
    sums = parts.groupBy("shard").agg(F.sum("n").alias("sn"), F.sum("g").alias("sg"))  # one row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", F.coalesce(F.sum("sn").over(before), F.lit(0)).alias("bn"), F.coalesce(F.sum("sg").over(before), F.lit(0)).alias("bg"), F.sum("sg").over(Window.partitionBy(F.lit(1))).alias("ag"))
    down = Window.partitionBy("shard").orderBy(F.col(score).desc())
    cum = parts.withColumns({"cn": F.sum("n").over(down), "cg": F.sum("g").over(down)}).join(starts, "shard")
    cn, cg = F.col("cn") + F.col("bn"), F.col("cg") + F.col("bg")
    scored = cum.select(F.col(score).alias("threshold"), (2.0 * cg / (cn + F.col("ag"))).alias("f1"))
    best = scored.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("down"))).alias("m")).where("m is not null")
    return best.select((-F.col("m.down")).alias("threshold"), F.col("m.f1").alias("f1"))


def bootstrap_f1(rows: DataFrame, row_id: str, predicted: Column, gold: Column, resamples: int = 2000, seed: int = 5) -> DataFrame:
    """Median and 95 % bounds of F1 over Poisson resamples: (low, median, high).

    F1 depends on how often the true positives, false positives and misses are drawn, and the weights of n rows, each Poisson with
    mean 1, add up to one Poisson number with mean n. So the rows are counted once and each resample draws three numbers,
    from a generator of its own. Rows without an id take no part; without any of the three F1 is 0.
    """
    counts = binary_scores(rows.where(F.col(row_id).isNotNull()), predicted, gold).first()
    sizes = [counts["tp"], counts["fp"], counts["fn"]]

    @F.pandas_udf("double")
    def f1(b: pd.Series) -> pd.Series:
        out = []
        for n in b:
            tp, fp, fn = np.random.default_rng([seed, int(n)]).poisson(sizes)
            out.append(2.0 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)
        return pd.Series(out, dtype="float64")

    drawn = rows.sparkSession.range(resamples).select(f1("id").alias("f1"))
    return drawn.agg(*[F.percentile("f1", F.lit(q)).alias(n) for q, n in ((0.025, "low"), (0.5, "median"), (0.975, "high"))])


def any_true(columns: list[Column]) -> Column:
    """Whether any of several flags holds; null counts as no."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in columns])


def cluster_shape(members: DataFrame, cluster: str, source: str) -> DataFrame:
    """One row on a clustering: clusters, with several members, with several sources, the largest, and singletons."""
    by = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(source).alias("k"))
    return by.agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("n") > 1).alias("multi_member"), F.count_if(F.col("k") > 1).alias("multi_source"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"),
    )


def weighted_precision(labelled: DataFrame, population: DataFrame, strata: list[str], right: Column) -> DataFrame:
    """One row: labelled rows and their precision weighted by how many rows of the population each stratum has."""
    per = labelled.groupBy(*strata).agg(F.count(F.lit(1)).alias("k"), F.avg(right.cast("double")).alias("p"))
    sizes = population.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    return per.join(sizes, strata).agg(F.sum("k").alias("labelled"), (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("precision"))


def usage_totals(replies: DataFrame, usage: str, price_in: float, price_out: float) -> DataFrame:
    """One row: replies, tokens in and out, and cost per million tokens, from the JSON that a service returns with each reply."""
    u = F.from_json(usage, "struct<prompt_tokens:bigint,completion_tokens:bigint>")
    by = replies.agg(F.count(u).alias("replies"), F.coalesce(F.sum(u.prompt_tokens), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum(u.completion_tokens), F.lit(0)).alias("tokens_out"))
    return by.withColumn("cost", (F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6)


def corpus_shape(docs: DataFrame, source: str, words: str, kind: str, kinds: list[str]) -> DataFrame:
    """Per source: passages, quantiles of their words, and how many there are of each kind."""
    by = quantiles(docs, [source], words, (0.1, 0.5, 0.9)).withColumnRenamed("n", "with_words")
    counts = docs.groupBy(source).agg(F.count(F.lit(1)).alias("passages"), *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds])
    return counts.join(by, source, "left")
