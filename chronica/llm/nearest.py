"""Matching records of two tables by nearest time, over one global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronica.operators.shards import HotGroups
from chronica.session import parallelism


def nearest_in_time(
    left: DataFrame, right: DataFrame, entity: list[str], time: str, left_id: str, right_id: str, within: int, most_rows: int = 500_000
) -> DataFrame:
    """For each left row the right row of its entity nearest in time, at most ``within`` away.

    Both tables have the columns ``entity`` and the BIGINT ``time`` (microseconds); ``left_id`` and
    ``right_id``, a whole number, name the rows. Gives entity, left_id, right_id and apart = right less left time;
    left rows without a match are left out. Exactly ``within`` counts. At equal distance the
    earlier right row wins, then the smaller ``right_id``. Rows with a null time, id or entity take
    no part. Repeated left rows give repeated results. Empty tables give an empty table.

    All rows are range-partitioned once by entity and time: an entity of more than ``most_rows`` is cut at quantiles of
    its times, so it lies in several partitions, and one that fits a task is never cut. The partitions are scanned in
    place, forwards and backwards. Only for entities with a cut the last and the first right row of each piece are
    exchanged, by a running maximum and minimum over pieces: a table of one row per piece, which
    is what the partitions' edges need.
    """
    spark = left.sparkSession
    keys = [f"k{i}" for i in range(len(entity))]
    if not isinstance(right.schema[right_id].dataType, T.IntegralType):
        raise TypeError("right_id must be a whole number")

    def side(df: DataFrame, row_id: str, is_right: bool) -> DataFrame:
        whole = df
        for c in [*entity, time, row_id]:
            whole = whole.where(F.col(c).isNotNull())
        ids = [F.lit(None).cast(left.schema[left_id].dataType), F.lit(None).cast("bigint")]
        ids[is_right] = F.col(row_id).cast("bigint") if is_right else F.col(row_id)
        return whole.select(
            *[F.col(c).alias(k) for c, k in zip(entity, keys)], F.col(time).alias("t"), ids[0].alias("l"), ids[1].alias("r")
        )

    both = side(left, left_id, False).unionByName(side(right, right_id, True))
    hot = HotGroups(both, keys, most_rows)
    pieces = hot.sharded(both, F.col("t"), "piece").withColumn("piece", F.coalesce("piece", F.lit(-2)))
    order = pieces.repartitionByRange(parallelism(spark), *keys, "piece")

    # A right row as (time, negated id): the greatest is the latest, of equal times the one of the smallest id.
    latest = F.when(F.col("r").isNotNull(), F.struct(F.col("t"), (-F.col("r")).alias("n")))
    first = F.when(F.col("r").isNotNull(), F.struct(F.col("t"), F.col("r").alias("n")))
    by = Window.partitionBy(*keys, "piece")
    upto = (Window.unboundedPreceding, Window.currentRow)
    is_left = F.col("l").isNotNull()  # right rows of a time come before its left rows, both ways
    scanned = order.withColumns({
        "before": F.max(latest).over(by.orderBy(F.col("t"), is_left).rowsBetween(*upto)),
        "after": F.min(first).over(by.orderBy(F.col("t").desc(), is_left).rowsBetween(*upto)),
    }).where("l is not null")
    if hot.any:
        edges = pieces.where("piece <> -2").groupBy(*keys, "piece").agg(F.max(latest).alias("hi"), F.min(first).alias("lo"))
        prior = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        later = Window.partitionBy(*keys).orderBy(F.col("piece").desc()).rowsBetween(Window.unboundedPreceding, -1)
        carried = edges.select(
            *[F.col(k).alias(f"c_{k}") for k in keys], F.col("piece").alias("c_piece"), F.max("hi").over(prior).alias("c_before"), F.min("lo").over(later).alias("c_after")
        )
        same = F.col("piece") == F.col("c_piece")
        for k in keys:
            same = same & (F.col(k) == F.col(f"c_{k}"))
        joined = scanned.join(carried, same, "left")
        joined = joined.withColumns({"before": F.greatest("before", "c_before"), "after": F.least("after", "c_after")})
    else:
        joined = scanned

    b, a = F.col("before"), F.col("after")
    back, ahead = F.col("t") - b.t, a.t - F.col("t")
    choose_back = b.isNotNull() & (a.isNull() | (back <= ahead))
    # Both sides hold the rows of the left row's own time; of these each gives the smallest id.
    r, apart = F.when(choose_back, -b.n).otherwise(a.n), F.when(choose_back, -back).otherwise(ahead)
    return joined.select(
        *[F.col(k).alias(c) for k, c in zip(keys, entity)], F.col("l").alias(left_id), r.cast(right.schema[right_id].dataType).alias(right_id), apart.alias("apart")
    ).where(F.abs("apart") <= within)
