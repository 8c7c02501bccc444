"""Filling fixed-capacity containers with items of varying length."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronica.operators.shards import HotGroups, running_sums
from chronica.session import cut, parallelism

Run = tuple[int, int]  # first number, count


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Bulk-synchronous best fit over items in size order: (size, first rank, first container, count).

    ``counts`` has the number of items of each size from 1 to ``capacity``. The items of a size are
    numbered from 0; the i-th of a run goes to the i-th container of the run. Items and gaps are
    held as runs of equals in size order. A round opens containers for the largest items left, as
    many as their total needs at least; then sweeps follow: going down the sizes, items take the
    smallest gap that holds them, and as a gap takes one item in a sweep, of all items that want
    it the larger wins by rank; gaps are updated and the sweep is repeated until nothing fits.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    given = defaultdict(int)
    gaps: dict[int, list[Run]] = {}
    out: list[tuple[int, int, int, int]] = []
    opened = 0

    def place(size: int, run: Run) -> None:
        out.append((size, given[size], run[0], run[1]))
        given[size] += run[1]
        left[size] -= run[1]
        if not left[size]:
            del left[size]

    while left:
        need = -(-sum(s * n for s, n in left.items()) // capacity)
        for size in sorted(left, reverse=True):
            n = min(need, left[size])
            place(size, (opened, n))
            if capacity - size:
                gaps.setdefault(capacity - size, []).append((opened, n))
            opened, need = opened + n, need - n
            if not need:
                break
        moved = True
        while moved and left:
            moved = False
            after: dict[int, list[Run]] = defaultdict(list)
            widths = sorted(gaps, reverse=True)
            stack: list[tuple[int, list[Run]]] = []  # the smallest gap is on top
            w = 0
            for size in sorted(left, reverse=True):
                while w < len(widths) and widths[w] >= size:
                    stack.append((widths[w], gaps[widths[w]]))
                    w += 1
                n = left[size]
                while n and stack:
                    width, runs = stack[-1]
                    if not runs:
                        stack.pop()
                        continue
                    start, many = runs.pop()
                    m = min(n, many)
                    if many > m:
                        runs.append((start + m, many - m))
                    place(size, (start, m))
                    n -= m
                    moved = True
                    if width > size:
                        after[width - size].append((start, m))
            least = min(left, default=0)
            gaps = {g: runs for g, runs in gaps.items() if runs and g >= least}
            for g, runs in after.items():
                if g >= least:
                    gaps.setdefault(g, []).extend(runs)
    return out


def pack(
    items: DataFrame, item_id: str, size: str, capacities: list[tuple[str, int]], shards: int | None = None, most_rows: int = 500_000
) -> DataFrame:
    """Containers of each capacity for all items: (pack_name, item_id, piece, piece_size, container).

    An item is split only if it is larger than the capacity: into full pieces, each with a
    container of its own, and a remainder that is packed like an item. Items with a null size or
    none take no space: they have one row with piece 0, their size and a null container. Item ids are
    expected to differ; of equal ones each row is packed. Container numbers run from 0 in each
    pack. An empty table gives an empty table.

    Full pieces are numbered by ``shards`` shards (by default as many as shuffle partitions, at least 256).

    The number of items by size is all that decides the containers, and sizes are whole numbers up
    to the capacity: the sweeps of ``best_fit_runs`` run over at most that many classes, a bound that
    does not grow with the data. The items stay distributed: for all packs at once they are numbered inside their size in the order of
    a hash, a size of more than ``most_rows`` items by shards of it, and a binary search in the runs of their size gives each its container. What is sent to the
    tasks are the runs, whose number depends on the capacity and the number of sweeps.
    """
    spark = items.sparkSession
    if not capacities:
        return items.select(F.lit("").alias("pack_name"), item_id, F.lit(0).alias("piece"), F.col(size).cast("bigint").alias("piece_size"), F.lit(0).cast("bigint").alias("container")).where("false")
    # An item of a pack as its full pieces and a remainder; all packs are numbered, counted and written together.
    packs = F.array(*[F.struct(F.lit(p).alias("pack"), F.lit(int(capacity)).cast("bigint").alias("capacity")) for p, (_, capacity) in enumerate(capacities)])
    whole = cut(items.select(F.col(item_id).alias("i"), F.col(size).cast("bigint").alias("whole")))  # sizes are counted once
    each = whole.select("i", "whole", F.inline(packs)).withColumns({"z": F.greatest(F.col("whole"), F.lit(0)) % F.col("capacity"), "full": F.floor(F.greatest(F.col("whole"), F.lit(0)) / F.col("capacity"))})
    shard = F.pmod(F.xxhash64("i"), F.lit(shards or max(256, parallelism(spark))))
    mark = F.xxhash64("i")
    numbered = running_sums(each, ["pack", "z"], [mark, F.col("i")], {"n": F.lit(1)}, mark, HotGroups(each, ["pack", "z"], most_rows))
    sized = cut(numbered.withColumn("n", F.col("n") - 1))
    histogram: list[dict[int, int]] = [{} for _ in capacities]
    for r in sized.where("z > 0").groupBy("pack", "z").agg(F.count(F.lit(1)).alias("c")).collect():  # a row per size below each capacity
        histogram[r["pack"]][r["z"]] = r["c"]
    first: dict[int, list[int]] = defaultdict(list)  # by size and pack as one number
    start: dict[int, list[int]] = defaultdict(list)
    opened = []
    for p, (_, capacity) in enumerate(capacities):
        containers = 0
        for z, rank, container, n in best_fit_runs(histogram[p], capacity):
            first[z * len(capacities) + p].append(rank)
            start[z * len(capacities) + p].append(container)
            containers = max(containers, container + n)
        opened.append(containers)
    name = F.element_at(F.array(*[F.lit(n) for n, _ in capacities]), F.col("pack") + 1).alias("pack_name")
    container = _container_of(spark, first, start)
    rest = sized.where("z > 0").select(name, "i", F.col("full").cast("int").alias("piece"), F.col("z").alias("piece_size"), container(F.col("z") * len(capacities) + F.col("pack"), F.col("n")).alias("container"))
    # Full pieces: their containers follow those of the others, in the order of a running sum by shard.
    large = sized.where("full > 0").select("pack", "i", "capacity", "full", shard.alias("shard"))
    after = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in opened]), F.col("pack") + 1)
    large = _running_start(large, ["pack"], "full", "shard", "i").select(
        "pack", "i", "capacity", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece"), (after + F.col("start")).alias("start")
    )
    large = large.select(name, "i", "piece", F.col("capacity").alias("piece_size"), (F.col("start") + F.col("piece")).alias("container"))
    nothing = sized.where("whole is null or whole <= 0").select(name, "i", F.lit(0).alias("piece"), F.col("whole").alias("piece_size"), F.lit(None).cast("bigint").alias("container"))
    return rest.unionByName(large).unionByName(nothing).withColumnRenamed("i", item_id)


def _container_of(spark: SparkSession, first: dict[int, list[int]], start: dict[int, list[int]]):
    """A function from a class (size and pack as one number) and rank to the container of the run that holds the rank."""
    shared = spark.sparkContext.broadcast({key: (np.array(first[key]), np.array(start[key])) for key in first})

    @F.pandas_udf("bigint")
    def container(classes: pd.Series, n: pd.Series) -> pd.Series:
        out = np.full(len(n), -1, dtype="int64")
        keys, ranks = classes.to_numpy(), n.to_numpy()
        order = np.argsort(keys, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1) if len(order) else []:
            if keys[at[0]] in shared.value:
                a, b = shared.value[keys[at[0]]]
                i = np.searchsorted(a, ranks[at], side="right") - 1
                out[at] = b[i] + ranks[at] - a[i]
        return pd.Series(out)

    return container


def _running_start(df: DataFrame, keys: list[str], amount: str, shard: str, order: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows of its keys before it, by shard then ``order``, as start."""
    sums = df.groupBy(*keys, shard).agg(F.sum(amount).alias("s_sum"))
    before = Window.partitionBy(*keys).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    # One row per key and shard: a number set by the shards.
    starts = sums.select(*keys, shard, F.coalesce(F.sum("s_sum").over(before), F.lit(0)).alias("s_start"))
    inside = Window.partitionBy(*keys, shard).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(amount).over(inside), F.lit(0))
    return df.withColumn("s_own", own).join(starts, [*keys, shard]).withColumn("start", F.col("s_start") + F.col("s_own"))


def fill_report(packed: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """Containers, tokens and the filled share of each pack, beside the least possible number."""
    spark = packed.sparkSession
    sizes = F.broadcast(spark.createDataFrame(capacities, "pack_name string, capacity bigint"))  # one row per pack
    by = packed.where("container is not null").groupBy("pack_name").agg(
        F.sum("piece_size").alias("tokens"), (F.max("container") + 1).alias("containers")
    )
    return by.join(sizes, "pack_name").select(
        "pack_name", "capacity", "tokens", "containers",
        F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"),
        (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"),
    )
