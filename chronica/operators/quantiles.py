"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronica.operators.shards import HotGroups, running_sums


def group_quantiles(rows: DataFrame, keys: list[str], value: Column, at: tuple[float, ...], hot: HotGroups) -> DataFrame:
    """Exact quantiles with linear interpolation: (keys, n, q), q an array in the order of ``at``.

    Nulls in ``value`` are left out. Rows are first counted by distinct value, combined before the
    shuffle. A group that isn't hot is then one aggregate over its counts. In a hot group (by
    ``hot``, counted over these keys) the running counts are taken by shards of the value, and the
    values at the ranks looked for are the least whose running count is beyond the rank; so no task
    ever holds all the values of a group.
    """
    counts = rows.select(*keys, value.cast("double").alias("q_v")).where("q_v is not null").groupBy(*keys, "q_v").agg(F.count(F.lit(1)).alias("q_c"))
    points = ", ".join(f"{p}D" for p in at)
    small = lambda df: df.groupBy(*keys).agg(F.sum("q_c").alias("n"), F.expr(f"percentile(q_v, array({points}), q_c)").alias("q"))
    if not hot.any:
        return small(counts)
    marked = hot.sharded(counts, F.col("q_v"), "q_hot")
    cold = small(marked.where("q_hot is null"))
    large = marked.where("q_hot is not null").drop("q_hot")
    ranked = running_sums(large, keys, [F.col("q_v")], {"q_upto": F.col("q_c")}, F.col("q_v"), hot)
    sizes = large.groupBy(*[F.col(k).alias(f"q_{i}") for i, k in enumerate(keys)]).agg(F.sum("q_c").alias("q_n"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"q_{i}"))
    ranked = ranked.join(sizes, same)
    aggs = []
    for i, p in enumerate(at):
        place = (F.col("q_n") - 1) * F.lit(float(p))
        aggs += [F.min(F.when(F.col("q_upto") > F.floor(place), F.col("q_v"))).alias(f"lo{i}"), F.min(F.when(F.col("q_upto") > F.ceil(place), F.col("q_v"))).alias(f"hi{i}")]
    found = ranked.groupBy(*keys).agg(F.first("q_n").alias("n"), *aggs)
    values = []
    for i, p in enumerate(at):
        place = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.floor(place), F.ceil(place)
        values.append(F.when(low == high, F.col(f"lo{i}")).otherwise((high - place) * F.col(f"lo{i}") + (place - low) * F.col(f"hi{i}")))
    return cold.unionByName(found.select(*keys, "n", F.array(*values).alias("q")))
