"""Merging the intervals of an entity into continuous periods, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronica.functions.times import micros
from chronica.operators.shards import HotGroups, running_max


def periods_and_gaps(
    df: DataFrame, keys: list[str], start: str, end: str, shard_micros: int = 1_000_000, most_rows: int = 500_000
) -> DataFrame:
    """Continuous periods and the gaps between them, as rows (keys, what, from_time, to_time).

    Intervals that overlap or touch are one period. Rows with a missing start or end, or an end
    not after the start, take no part. Repeated rows change nothing. Null keys form an entity of
    their own. An empty table gives an empty table. Extra columns are left out.

    In order of start an interval opens a period if it starts after the running maximum of the
    ends before it; that maximum is then the end of the period before, hence the start of the gap.
    A period is known by the start that opened it, which is the running maximum of opening starts.
    One exchange by entity serves all of it. An entity of more than ``most_rows`` is cut by start into
    shards of about equal numbers of rows, at whole multiples of ``shard_micros``, each with the maximum of the earlier ones as carry-in.
    """
    taken = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start)))
    ks = [f"k{i}" for i in range(len(keys))]
    rows = taken.select(*[F.col(c).alias(k) for c, k in zip(keys, ks)], F.col(start).alias("s"), F.col(end).alias("e"))
    order, shard = [F.col("s"), F.col("e")], F.floor(micros(F.col("s")) / shard_micros)

    hot = HotGroups(rows, ks, most_rows)
    rows = running_max(rows, ks, order, "e", "before", shard, before=True, hot=hot)
    rows = rows.withColumn("new", F.when(F.col("before").isNull() | (F.col("s") > F.col("before")), F.col("s")))
    rows = running_max(rows, ks, order, "new", "opened", shard, hot=hot)
    merged = rows.groupBy(*ks, "opened").agg(F.max("e").alias("closed"), F.max(F.when(F.col("new").isNotNull(), F.col("before"))).alias("gap"))

    # One pass gives both: each period, and the gap that ends where the period starts.
    both = F.array(
        F.struct(F.lit("period").alias("what"), F.col("opened").alias("from_time"), F.col("closed").alias("to_time")),
        F.struct(F.lit("gap").alias("what"), F.col("gap").alias("from_time"), F.col("opened").alias("to_time")),
    )
    out = merged.select(*[F.col(k).alias(c) for c, k in zip(keys, ks)], F.inline(both))
    return out.where(F.col("from_time").isNotNull())
