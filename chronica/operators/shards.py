"""Running values inside groups of any size: hot groups are cut into shards with a carry-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronica.session import parallelism

HASHES = 16_384
#: A group is cut into at most so many shards.
MOST_SHARDS = 1_024
#: Hot hashes beyond this number are looked up in a small table instead of a list in the plan.
MOST_LISTED = 256


def text_axis(text: Column, length: int = 7) -> Column:
    """The first bytes of a text as a whole number that never falls as the text rises in byte order; null is null."""
    return F.conv(F.rpad(F.substring(F.hex(text.cast("binary")), 1, 2 * length), 2 * length, "0"), 16, 10).cast("bigint")


def _equal(left: DataFrame | None, names: list[str], others: list[str]) -> Column:
    same = F.lit(True)
    for a, b in zip(names, others):
        same = same & (F.col(a) if left is None else left[a]).eqNullSafe(F.col(b))
    return same


class HotGroups:
    """Which groups hold so many rows that one task should not have to sort them.

    Rows are counted by a hash of the keys, with partial sums before the shuffle. What comes to the
    driver is one number per hash; there are 16 hashes per shuffle partition, or more. A hash is hot
    if it holds more than ``most_rows`` and more than 8 times the mean, so at most an eighth of the
    hashes is ever hot. ``largest`` is what the caller knows a group to hold at most: where that is
    no more than ``most_rows``, nothing is counted. Which groups are cut decides where rows are
    sorted, never what comes out.
    """

    def __init__(self, df: DataFrame, keys: list[str], most_rows: int, largest: int | None = None):
        self.keys = keys
        self.hashes = max(HASHES, 16 * parallelism(df.sparkSession))
        self.mark = F.pmod(F.xxhash64(*keys), F.lit(self.hashes))
        self.bound, self.hot, top = most_rows, [], 0
        if largest is None or largest > most_rows:
            rows = df.groupBy(self.mark.alias("h")).agg(F.count(F.lit(1)).alias("n")).collect()
            self.bound = max(most_rows, 8 * sum(r["n"] for r in rows) // self.hashes)
            self.hot = [r["h"] for r in rows if r["n"] > self.bound]
            top = max((r["n"] for r in rows), default=0)
        self.pieces = min(MOST_SHARDS, max(2, -(-2 * top // max(1, self.bound))))

    @property
    def any(self) -> bool:
        return bool(self.hot)

    def rows_of(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` in hot hashes."""
        if len(self.hot) <= MOST_LISTED:
            return df.where(self.mark.isin(self.hot))
        small = df.sparkSession.createDataFrame([(h,) for h in self.hot], "x_hash bigint")
        # At most an eighth of the hashes.
        return df.join(F.broadcast(small), self.mark == F.col("x_hash"), "left_semi")

    def sharded(self, df: DataFrame, axis: Column, name: str = "x_shard") -> DataFrame:
        """``df`` with the shard of each row of a hot group, null for the others.

        ``axis`` is a number that never falls along the order of the group. A hot group is cut at
        approximate quantiles of it, so shards hold about equal numbers of rows wherever those lie;
        rows of one axis value stay together. A null comes before everything.
        """
        kind = df.select(axis.alias("a")).schema["a"].dataType
        if not isinstance(kind, (T.NumericType, T.NullType)):
            raise TypeError(f"a shard must be a number, not {kind.simpleString()}")
        number = axis.cast("double")
        if not self.hot:
            return df.withColumn(name, F.lit(None).cast("int"))
        points = ", ".join(f"{k / self.pieces}D" for k in range(1, self.pieces))
        named = [f"x_cut_{i}" for i in range(len(self.keys))]
        cuts = self.rows_of(df).groupBy(*[F.col(k).alias(c) for k, c in zip(self.keys, named)]).agg(
            F.count(F.lit(1)).alias("x_n"), F.percentile_approx(number, F.expr(f"array({points})"), 10 * self.pieces).alias("x_cuts")
        )
        # Hot groups only: their number is bounded by that of the hot hashes' rows over the bound.
        cuts = cuts.where(F.col("x_n") > self.bound).select(*named, F.coalesce(F.array_distinct("x_cuts"), F.array().cast("array<double>")).alias("x_cuts"))
        joined = df.join(F.broadcast(cuts), _equal(None, self.keys, named), "left")
        place = F.when(number.isNull(), -1).otherwise(F.size(F.filter("x_cuts", lambda c: c < number)))
        return joined.withColumn(name, F.when(F.col("x_cuts").isNotNull(), place)).drop(*named, "x_cuts")


def running_max(
    df: DataFrame, keys: list[str], order: list[Column], value: str, out: str, shard: Column, most_rows: int = 500_000, before: bool = False,
    hot: HotGroups | None = None,
) -> DataFrame:
    """``df`` with the maximum of ``value`` over the rows of its group up to it in ``order``, or only before it.

    ``shard`` is a number that must never fall along ``order``. A value that starts with the time
    makes this the last value so far. Nulls in ``value`` are passed over; null keys form a group.
    """
    hot = HotGroups(df, keys, most_rows) if hot is None else hot
    upto = (Window.unboundedPreceding, -1 if before else Window.currentRow)
    if not hot.any:
        return df.withColumn(out, F.max(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)))
    rows = hot.sharded(df, shard)
    local = Window.partitionBy(*keys, "x_shard").orderBy(*order).rowsBetween(*upto)
    carry = _carried(rows, keys, {"x_carry": (F.max(value), F.max)})
    joined = rows.withColumn("x_own", F.max(value).over(local)).join(carry, _same_shard(keys), "left")
    return joined.select(*df.columns, F.greatest("x_own", "x_carry").alias(out))


def running_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], shard: Column, hot: HotGroups) -> DataFrame:
    """``df`` with running sums over the rows of its group up to and with it in ``order``, by name.

    ``order`` must order the rows of a group fully, else equal rows share no defined place.
    """
    upto = (Window.unboundedPreceding, Window.currentRow)
    if not hot.any:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)
        return df.withColumns({name: F.sum(c).over(w) for name, c in sums.items()})
    rows = hot.sharded(df, shard)
    local = Window.partitionBy(*keys, "x_shard").orderBy(*order).rowsBetween(*upto)
    carry = _carried(rows, keys, {f"x_carry_{name}": (F.sum(c), F.sum) for name, c in sums.items()})
    joined = rows.withColumns({name: F.sum(c).over(local) for name, c in sums.items()}).join(carry, _same_shard(keys), "left")
    kept = [c for c in df.columns if c not in sums]
    return joined.select(*kept, *[(F.col(name) + F.coalesce(F.col(f"x_carry_{name}"), F.lit(0))).alias(name) for name in sums])


def _carried(rows: DataFrame, keys: list[str], values: dict) -> DataFrame:
    """For each shard of a hot group the aggregate of all shards before it: one row per shard."""
    ends = rows.where("x_shard is not null").groupBy(*keys, "x_shard").agg(*[first.alias(name) for name, (first, _) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("x_shard").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(
        *[F.col(k).alias(f"x_{i}") for i, k in enumerate(keys)], F.col("x_shard").alias("x_at"), *[then(name).over(earlier).alias(name) for name, (_, then) in values.items()]
    )


def _same_shard(keys: list[str]) -> Column:
    return (F.col("x_shard") == F.col("x_at")) & _equal(None, keys, [f"x_{i}" for i in range(len(keys))])
