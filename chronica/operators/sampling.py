"""Splits and samples in the order of a hash, so that they can be repeated anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronica.operators.ranks import sharded_rank


def hash_order(row_id: Column, seed: int) -> Column:
    """A text that orders rows as if at random, the same for the same id and seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), row_id.cast("string")))


def _ranked(rows: DataFrame, row_id: str, strata: list[str], seed: int) -> DataFrame:
    """``rows`` with s_rank in their stratum, by hash order; the hash's first digits are the shard."""
    marked = rows.withColumn("s_hash", hash_order(F.col(row_id), seed))
    shard = F.conv(F.substring("s_hash", 1, 2), 16, 10).cast("int")
    return sharded_rank(marked, strata, [F.col("s_hash"), F.col(row_id)], shard, "s_rank").drop("s_hash")


def stratified_split(rows: DataFrame, row_id: str, strata: list[str], shares: list[tuple[str, float]], seed: int) -> DataFrame:
    """``rows`` with a split by cuts at rounded shares of each stratum, half to even; the last split takes the rest."""
    sizes = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("s_n"))
    same = F.lit(True)
    sizes = sizes.select(*[F.col(c).alias(f"s_{c}") for c in strata], "s_n")
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    ranked = _ranked(rows, row_id, strata, seed).join(sizes, same)
    split, upto = None, F.lit(0)
    for name, share in shares[:-1]:
        upto = upto + F.bround(F.col("s_n") * share).cast("bigint")
        split = F.when(F.col("s_rank") < upto, name) if split is None else split.when(F.col("s_rank") < upto, name)
    return ranked.withColumn("split", split.otherwise(shares[-1][0]) if split is not None else F.lit(shares[-1][0])).select(*rows.columns, "split")


def temporal_split(rows: DataFrame, row_id: str, late: Column, strata: list[str], shares: list[tuple[str, float]], seed: int) -> DataFrame:
    """Rows of late groups are the last split; the others are split by strata among the rest."""
    early = stratified_split(rows.where(~late), row_id, strata, shares[:-1], seed)
    return early.unionByName(rows.where(late).withColumn("split", F.lit(shares[-1][0])))


def quota_sample(rows: DataFrame, row_id: str, strata: str, quotas: dict[str, int], seed: int) -> DataFrame:
    """At most so many rows of each stratum, in hash order."""
    most = F.lit(0)
    for name, n in quotas.items():
        most = F.when(F.col(strata) == name, n).otherwise(most)
    return _ranked(rows, row_id, [strata], seed).where(F.col("s_rank") < most).drop("s_rank")


def fold(row_id: Column, folds: int, seed: int) -> Column:
    """The fold of a row for cross-validation."""
    return F.pmod(F.xxhash64(F.lit(seed), row_id), F.lit(folds))


def shared_between(splits: DataFrame, entity: str, split: str) -> DataFrame:
    """Entities that stand in more than one split, with the splits: empty if nothing leaks."""
    by = splits.groupBy(entity).agg(F.sort_array(F.collect_set(split)).alias("splits"))
    return by.where(F.size("splits") > 1)


def cell_balanced(rows: DataFrame, row_id: str, cell: str, n: int, seed: int) -> DataFrame:
    """``n`` rows, as many from every cell as an equal share allows; what small cells leave open is filled from the others.

    Rows are taken in hash order, in their cell and among what is left over. With fewer than ``n`` rows all are taken. Cells
    are meant to be few; null is one.
    """
    cells = rows.select(cell).distinct().count()
    share = n // cells if cells else 0
    ranked = _ranked(rows, row_id, [cell], seed)
    first = ranked.where(F.col("s_rank") < share).drop("s_rank")
    rest = ranked.where(F.col("s_rank") >= share).drop("s_rank")
    more = n - first.count()
    return first.unionByName(rest.orderBy(hash_order(F.col(row_id), seed), row_id).limit(max(0, more)))
