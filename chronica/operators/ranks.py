"""Row numbers inside groups of any size, computed without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sharded_rank(df: DataFrame, keys: list[str], order: list[Column], shard: Column, name: str = "rank") -> DataFrame:
    """Number the rows of each group from 0, shard by shard.

    ``shard`` spreads a group over many tasks; rows are counted per shard, the shards' starts come
    from a running sum over the counts, and only the rows of one shard are sorted together. Inside
    a shard the rows follow ``order``; the shards follow their own value. ``shard`` must not be
    null. Null keys form one group. An empty table gives an empty table.
    """
    s, start = f"__{name}_shard", f"__{name}_start"
    parts = df.withColumn(s, shard)
    counts = parts.groupBy(*keys, s).agg(F.count(F.lit(1)).alias(f"__{name}_n"))
    before = Window.partitionBy(*keys).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"__{name}_{i}") for i, k in enumerate(keys)],
        F.col(s).alias(f"__{name}_s"),
        F.coalesce(F.sum(f"__{name}_n").over(before), F.lit(0)).alias(start),
    )
    same = F.col(s) == F.col(f"__{name}_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__{name}_{i}"))
    local = Window.partitionBy(*keys, s).orderBy(*order)
    ranked = parts.withColumn(name, F.row_number().over(local)).join(starts, same)
    return ranked.withColumn(name, (F.col(name) + F.col(start) - 1).cast("bigint")).select(*df.columns, name)
