"""Splits that keep related records together."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronica.operators.shards import HotGroups, running_sums
from chronica.session import cut


def _forest():
    """Union-find over the edges of one partition; gives each node with the root of its tree, the least by a salted hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        place: dict[int, int] = {}
        for batch in batches:
            for a, b, pa, pb in zip(*(batch[c].tolist() for c in ("a", "b", "pa", "pb"))):
                if a not in parent:
                    parent[a], place[a] = a, pa
                if b not in parent:
                    parent[b], place[b] = b, pb
                ra, rb = root(a), root(b)
                if ra != rb:
                    if (place[rb], rb) < (place[ra], ra):
                        ra, rb = rb, ra
                    parent[rb] = ra
        nodes = list(parent)
        for i in range(0, len(nodes), 10_000):
            roots = [root(x) for x in nodes[i : i + 10_000]]
            yield pd.DataFrame({"node": nodes[i : i + 10_000], "root": roots, "place": [place[r] for r in roots]})

    return run


def components(edges: DataFrame, a: str, b: str, edges_per_task: int = 1_000_000, levels: list[int] | None = None) -> DataFrame:
    """Each node of a graph with the least node of its connected component: (node, component).

    ``a`` and ``b`` are BIGINT. Edges with a null end and loops are left out; repeats change
    nothing. Nodes without edges don't appear. No edges give an empty table. ``levels``, if given, takes the
    number of edges of each level.

    Distributed union-find: the edges are spread over tasks by a hash of both ends, so a node with
    very many edges is shared out, and each task builds a forest of its own edges. Forests are
    merged level by level: a node that stands in several forests ties their roots together, and
    those ties are the edges of the next level, whose nodes are roots only. The root of a tree is
    its least node by a hash that is salted anew at each level, so whatever order the ids have, a node with
    neighbours stays a root with a chance of a third at most along a chain, and the edges shrink by a constant share a level: the levels
    grow with the logarithm of the number of tasks. Once the edges fit one task one more level ends it. No
    task and no level ever holds the forests of all. The driver sees one count per level.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(a).cast("bigint").alias("x"), F.col(b).cast("bigint").alias("y"))
    level = cut(
        ends.where("x is not null and y is not null and x <> y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )
    forests: list[DataFrame] = []
    while n := level.count():
        salt, tasks = len(forests), -(-n // edges_per_task)
        if levels is not None:
            levels.append(n)
        placed = level.select("a", "b", *[F.xxhash64(F.lit(salt), c).alias(f"p{c}") for c in ("a", "b")])
        trees = cut(placed.repartition(tasks, F.xxhash64("a", "b")).mapInPandas(_forest(), "node bigint, root bigint, place bigint"))
        best = F.struct("place", "root")
        least = trees.groupBy("node").agg(F.min(best).alias("m"), F.max(best).alias("o"))
        forests.append(least.select("node", F.col("m.root").alias("root")))
        if tasks == 1:
            break
        shared = least.where("m <> o").select("node", F.col("m.root").alias("least"))
        ties = trees.join(shared, "node").where("root <> least")
        level = cut(ties.select(F.least("root", "least").alias("a"), F.greatest("root", "least").alias("b")).distinct())
    if not forests:
        return spark.createDataFrame([], "node bigint, component bigint")
    out = forests[-1].select("node", F.col("root").alias("top"))
    for n, lower in enumerate(reversed(forests[:-1])):
        higher = out.select(F.col("node").alias("root"), "top")
        out = lower.join(higher, "root", "left").select("node", F.coalesce("top", "root").alias("top"))
        if n % 4 == 3:  # the plan stays short
            out = cut(out)
    names = out.groupBy("top").agg(F.min("node").alias("component"))
    return out.join(names, "top").select("node", "component")


def with_entity(records: DataFrame, entity: Column, links: DataFrame, a: str, b: str, name: str = "entity", edges_per_task: int = 1_000_000) -> DataFrame:
    """``records`` with the component of their entity number in ``links``, else the number itself.

    A record whose number is null gets null: it is related to no other.
    """
    found = components(links, a, b, edges_per_task).select(F.col("node").alias("e_node"), F.col("component").alias("e_component"))
    # The record travels as one struct, so that none of its columns can clash.
    numbered = records.select(F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("e_record"), entity.alias("e_number"))
    joined = numbered.join(found, F.col("e_number") == F.col("e_node"), "left")
    return joined.select("e_record.*", F.coalesce("e_component", "e_number").alias(name))


def _assign(shapes: list[tuple[list[int], int]], shares: list[float]) -> list[list[int]]:
    """Greedy largest-first over classes of equal groups: for each class how many go to each split.

    A group of counts c goes to the split whose need, the sum over strata of c times the part of
    the stratum's target still missing, is largest, the earlier one on ties. Every group of a class that a split takes lowers its
    need by the same step, so the n groups of a class go where the n largest terms of as many arithmetic
    sequences as there are splits stand. Those above a common water level are counted at once and the few left, at most one a split, are
    given one by one: the result is that of giving out every single group in turn. Needs are exact fractions.
    """
    strata = range(len(shapes[0][0])) if shapes else []
    total = [sum(c[s] * n for c, n in shapes) for s in strata]
    want = [Fraction(x).limit_denominator(10**9) for x in shares]
    want = [x / sum(want) for x in want]
    have = [[0] * len(total) for _ in shares]
    out = []
    for c, n in shapes:
        live = [s for s in strata if c[s]]
        step = sum(Fraction(c[s] * c[s], total[s]) for s in live)
        needs = [sum(c[s] * (w - Fraction(h[s], total[s])) for s in live) for w, h in zip(want, have)]
        given = [0] * len(shares)
        if n > len(shares) and step:
            # The level at which the terms above it, counted as real numbers, are n.
            ranked, upto = sorted(needs, reverse=True), Fraction(0)
            for k in range(1, len(ranked) + 1):
                upto += ranked[k - 1]
                level = (upto - n * step) / k
                if k == len(ranked) or level >= ranked[k]:
                    break
            given = [max(0, int((x - level) // step)) for x in needs]
        for _ in range(n - sum(given)):
            given[max(range(len(shares)), key=lambda j: (needs[j] - given[j] * step, -j))] += 1
        for k, m in enumerate(given):
            for s in live:
                have[k][s] += c[s] * m
        out.append(given)
    return out


def split_by_entity(
    records: DataFrame, record_id: str, entity: str, stratum: str, strata: list[str], targets: list[tuple[str, float]],
    most_rows: int = 500_000,
) -> DataFrame:
    """``record_id``, ``entity``, ``stratum`` and the split of each record.

    All records of an entity are in one split; a record without an entity is an entity by itself,
    and so is each of several. Splits get their shares of each stratum as nearly as the sizes of
    the entities allow. ``strata`` names the strata that count; other values and nulls form one
    more. Shares are scaled to a sum of one. Repeated records of one ``record_id`` count once
    each and stay together, and so do records with neither an entity nor an id. An empty table gives an empty table.

    Entities are reduced to their counts by stratum, and entities with equal counts to one class:
    the greedy pass runs over classes, largest first. Their number is bounded by the number of
    different count vectors, not by the number of entities (an entity of k records needs k rows,
    so at most rows/k are that large). What comes to the driver is one row per count vector, and a class has at most one run of
    numbers per split. Entities are numbered inside their class in the order of a
    hash, a class of more than ``most_rows`` by shards of it, and the numbers are compared with the runs of the class.
    """
    spark = records.sparkSession
    total = sum(share for _, share in targets)
    names, shares = [n for n, _ in targets], [share / total for _, share in targets]
    key = F.coalesce(F.concat(F.lit("e"), F.col(entity).cast("string")), F.concat(F.lit("r"), F.col(record_id).cast("string")), F.lit(""))
    rows = records.select(record_id, entity, stratum, key.alias("g_key"))
    counts = [F.count_if(F.col(stratum) == s).alias(f"c{i}") for i, s in enumerate(strata)]
    other = F.count_if(~F.coalesce(F.col(stratum).isin(strata), F.lit(False))).alias(f"c{len(strata)}")
    cs = [f"c{i}" for i in range(len(strata) + 1)]
    groups = cut(rows.groupBy("g_key").agg(*counts, other))
    classes = groups.groupBy(*cs).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per count vector
    shapes = sorted((([r[c] for c in cs], r["n"]) for r in classes), key=lambda x: (-sum(x[0]), x[0]))
    runs = []
    for (c, _), given in zip(shapes, _assign(shapes, shares)):
        at = 0
        for k, m in enumerate(given):
            if m:
                runs.append((*[int(x) for x in c], at, at + m, names[k]))
            at += m
    schema = ", ".join([*(f"{c} bigint" for c in cs), "run_from bigint", "run_to bigint", "split string"])
    table = spark.createDataFrame(runs, schema)
    mark = F.xxhash64("g_key")
    ranked = running_sums(groups, cs, [mark, F.col("g_key")], {"g_rank": F.lit(1)}, mark, HotGroups(groups, cs, most_rows)).withColumn("g_rank", F.col("g_rank") - 1)
    inside = (F.col("g_rank") >= F.col("run_from")) & (F.col("g_rank") < F.col("run_to"))
    same = inside
    for c in cs:
        same = same & (ranked[c] == table[c])
    placed = ranked.join(table, same).select("g_key", "split")
    return rows.join(placed, "g_key").select(record_id, entity, stratum, "split")


def pairs_with_first(records: DataFrame, record_id: str, entity: str) -> DataFrame:
    """For each entity with several records, the least ``record_id`` with each of the others: (a, b)."""
    found = records.where(F.col(entity).isNotNull() & F.col(record_id).isNotNull()).select(entity, record_id).distinct()
    first = found.groupBy(entity).agg(F.min(record_id).alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(first, entity).where(F.col(record_id) > F.col("a")).select("a", F.col(record_id).alias("b"))


def shares_reached(split: DataFrame, stratum: str, targets: DataFrame) -> DataFrame:
    """Records and shares of each split, overall (stratum ``*``) and by stratum, beside the target."""
    by = split.groupBy("split", F.coalesce(stratum, F.lit("unknown")).alias("stratum")).agg(F.count(F.lit(1)).alias("records"))
    over = by.groupBy("split").agg(F.sum("records").alias("records")).select("split", F.lit("*").alias("stratum"), "records")
    all_rows = by.select("split", "stratum", "records").unionByName(over)
    part = F.col("records") / F.sum("records").over(Window.partitionBy("stratum"))
    return all_rows.withColumn("share", part).join(
        targets.select(F.col("split_name").alias("split"), F.col("share").alias("target_share")), "split", "left"
    )
