"""What went before: flags, roll-ups and records of an entity's earlier episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_prior(rows: DataFrame, key: str, time: str, summaries: dict[str, Column]) -> DataFrame:
    """``rows`` with aggregates over the key's strictly earlier rows; rows of the same time don't see each other.

    ``summaries`` maps a name to an aggregate such as ``F.count(...)`` or ``F.bool_or(...)``. A RANGE
    frame that ends before the row's own time replaces a self-join on an inequality, which would
    emit all pairs of a key.
    """
    order = Window.partitionBy(key).orderBy(F.col(time)).rangeBetween(Window.unboundedPreceding, -1)
    return rows.select("*", *[agg.over(order).alias(name) for name, agg in summaries.items()])


def latest_per_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The whole last row of each key in ``order`` (given descending)."""
    return rows.withColumn("l_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("l_rn = 1").drop("l_rn")


def latest_wide(rows: DataFrame, key: str, feature: str, features: list[str], value: str, order: list[str]) -> DataFrame:
    """One row per key with the last non-null value of each feature as a column."""
    at = F.struct(*order)
    return rows.groupBy(key).agg(
        *[F.max_by(F.col(value), F.when((F.col(feature) == f) & F.col(value).isNotNull(), at)).alias(f"last_{f}") for f in features]
    )


def prior_records(episodes: DataFrame, key: str, time: str, fields: list[str], most: int = 3) -> DataFrame:
    """``episodes`` with the last ``most`` strictly earlier episodes of the key, newest first, as an array of structs.

    The bound on the array keeps a key with very many episodes from growing quadratically; where
    ``most`` is none of the caller's wish, use ``with_prior`` for aggregates over all of them.
    """
    order = Window.partitionBy(key).orderBy(F.col(time))
    before = [F.lag(F.struct(time, *fields), k).over(order) for k in range(1, most + 1)]
    return episodes.withColumn("prior", F.filter(F.array(*before), lambda x: x.isNotNull() & (x[time] < F.col(time))))
