"""Edge tables: merging, simple graphs, bounded shortest paths, triples along paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronica.functions.scalars import normalised


def junk_reason(entity: Column, rules: list[tuple[str, str]]) -> Column:
    """The reason of the first rule (reason, pattern) an entity matches; null if it is none."""
    out = F.when(F.trim(entity) == "", "blank")
    for reason, pattern in rules:
        out = out.when(entity.rlike(pattern), reason)
    return out


def merge_edges(edges: DataFrame, source: str) -> DataFrame:
    """Equal edges, but for case and blanks, as one: with all sources, how often they were seen, and the least spelling.

    Self-loops and edges with a blank part go. Columns head, relation, tail and ``source``. Equal
    writings are counted before they are normalised, so each is normalised once.
    """
    counted = edges.groupBy("head", "relation", "tail", source).agg(F.count(F.lit(1)).alias("n"))
    keyed = counted.select(*[normalised(F.col(c)).alias(f"k_{c}") for c in ("head", "relation", "tail")], "head", "relation", "tail", source, "n")
    kept = keyed.where("k_head <> k_tail and k_head <> '' and k_tail <> '' and k_relation <> ''")
    return kept.groupBy("k_head", "k_relation", "k_tail").agg(
        F.min("head").alias("head"), F.min("relation").alias("relation"), F.min("tail").alias("tail"),
        F.sort_array(F.collect_set(source)).alias("sources"), F.sum("n").alias("n"),
    ).drop("k_head", "k_relation", "k_tail")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions: (a, relation, b, inverse)."""
    there = edges.select(F.col("head").alias("a"), "relation", F.col("tail").alias("b"), F.lit(False).alias("inverse"))
    back = edges.select(F.col("tail").alias("a"), "relation", F.col("head").alias("b"), F.lit(True).alias("inverse"))
    return there.unionByName(back)


def simple_graph(edges: DataFrame, order: str, noise: list[str]) -> DataFrame:
    """One edge per unordered pair of nodes, the first in ``order``, then by its other columns; self-loops and noise relations go."""
    kept = edges.where((F.col("head") != F.col("tail")) & ~F.col("relation").isin(noise))
    first = F.struct(order, "head", "relation", "tail", *[c for c in edges.columns if c not in (order, "head", "relation", "tail")])
    best = kept.groupBy(F.least("head", "tail").alias("g_lo"), F.greatest("head", "tail").alias("g_hi")).agg(F.min(first).alias("g_first"))
    return best.select("g_first.*").select(*edges.columns)


def shortest_paths(edges: DataFrame, pairs: DataFrame, hops: int = 3, most: int = 5) -> DataFrame:
    """All shortest paths of at most ``hops`` edges for each pair (source, target), at most ``most`` a pair by node names.

    Gives source, target, nodes. ``edges`` is a simple graph with columns head and tail. The
    frontier grows one hop at a time, keyed by pair; a pair leaves it once its paths have met the target, and
    a path never comes back to one of its nodes.
    """
    steps = both_ways(edges.withColumn("relation", F.lit(""))).select("a", "b").distinct()
    walk = pairs.select("source", "target").distinct().where("source <> target").withColumn("nodes", F.array("source"))
    done = None
    for _ in range(hops):
        grown = walk.withColumn("a", F.element_at("nodes", -1)).join(steps, "a").where(~F.array_contains("nodes", F.col("b")))
        walk = grown.select("source", "target", F.array_append("nodes", F.col("b")).alias("nodes"), (F.col("b") == F.col("target")).alias("met"))
        found = walk.where("met").select("source", "target", "nodes")
        done = found if done is None else done.unionByName(found)
        reached = found.select("source", "target").distinct()
        walk = walk.where("not met").drop("met").join(reached, ["source", "target"], "left_anti")
    order = Window.partitionBy("source", "target").orderBy(F.array_join("nodes", "\u001f"))
    return done.withColumn("g_rn", F.row_number().over(order)).where(F.col("g_rn") <= most).drop("g_rn")


def triples_along(paths: DataFrame, edges: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """The edges of each path in order: (source, target, nodes, hop, head, relation, tail) and the ``carried`` columns of the edge."""
    hops = paths.select("source", "target", "nodes", F.posexplode(F.slice("nodes", 1, F.size("nodes") - 1)).alias("hop", "a"))
    hops = hops.withColumn("b", F.element_at("nodes", F.col("hop") + 2))
    keyed = edges.select(F.least("head", "tail").alias("lo"), F.greatest("head", "tail").alias("hi"), "head", "relation", "tail", *(carried or []))
    met = (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi"))
    return hops.join(keyed, met).select("source", "target", "nodes", "hop", "head", "relation", "tail", *(carried or []))


def top_share(rows: DataFrame, keys: list[str], score: str, tie: str, share: float) -> DataFrame:
    """The best ``share`` of each group by score, rounded half to even, at least one row."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), tie)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("t_rn", F.row_number().over(order)).withColumn("t_n", F.greatest(F.lit(1), F.bround(n * share))).where("t_rn <= t_n").drop("t_rn", "t_n")


def gate(left: DataFrame, right: DataFrame, key: str, mode: str) -> DataFrame:
    """Keys allowed by two key sets: ``both``, ``either``, ``left`` or ``left_if_right_empty``."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    if mode == "both" or (mode == "left_if_right_empty" and b.head(1)):
        return a.join(b, key, "left_semi")
    return a.union(b).distinct() if mode == "either" else a


def item_pairs(sets: DataFrame, items: str, themes: list[list[str]]) -> DataFrame:
    """Unordered pairs (a, b) to search between: items that share a row, and terms of one theme."""
    first = sets.select(F.array_sort(F.array_distinct(items)).alias("s")).distinct().select("s", F.posexplode("s").alias("i", "a"))
    shared = first.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    inside = [(min(x, y), max(x, y)) for t in themes for i, x in enumerate(t) for y in t[i + 1 :] if x != y]
    if inside:
        shared = shared.unionByName(sets.sparkSession.createDataFrame(inside, "a string, b string"))
    return shared.distinct()


def meeting_paths(edges: DataFrame, pairs: DataFrame, length: int = 4, most: int = 20, frontier: int | None = None) -> DataFrame:
    """Directed walks between the ends of each pair, found from both ends: (source, target, nodes, relations).

    Each end is walked half the ``length``, in both directions of every edge, an inverse step marked
    with ``-``; walks that meet are joined. All simple walks of at most ``length`` edges are found; at most ``most`` per pair come out, the shortest first.
    As walks multiply at hubs, a caller may bound the walks of a pair and end by ``frontier``, in the order of their nodes, and lose those beyond it.
    """
    steps = both_ways(edges).select("a", "b", F.when(F.col("inverse"), F.concat(F.lit("-"), "relation")).otherwise(F.col("relation")).alias("r"))

    def walk(start: str, hops: int) -> DataFrame:
        now = pairs.select("source", "target").distinct().where("source <> target").select("source", "target", F.array(start).alias("n"), F.array().cast("array<string>").alias("r"))
        every = now
        for _ in range(hops):
            grown = now.withColumn("a", F.element_at("n", -1)).join(steps.withColumnRenamed("r", "step"), "a").where(~F.array_contains("n", F.col("b")))
            grown = grown.select("source", "target", F.array_append("n", F.col("b")).alias("n"), F.array_append("r", F.col("step")).alias("r"))
            order = Window.partitionBy("source", "target").orderBy(F.array_join("n", "\u001f"), F.array_join("r", "\u001f"))
            now = grown if frontier is None else grown.withColumn("w_rn", F.row_number().over(order)).where(F.col("w_rn") <= frontier).drop("w_rn")
            every = every.unionByName(now)
        return every

    there = walk("source", length - length // 2).select("source", "target", F.col("n").alias("n1"), F.col("r").alias("r1"), F.element_at("n", -1).alias("m"))
    back = walk("target", length // 2).select("source", "target", F.col("n").alias("n2"), F.col("r").alias("r2"), F.element_at("n", -1).alias("m"))
    met = there.join(back, ["source", "target", "m"])
    turned = F.transform(F.reverse("r2"), lambda x: F.when(x.startswith("-"), F.substring(x, F.lit(2), F.length(x))).otherwise(F.concat(F.lit("-"), x)))
    nodes = F.concat("n1", F.slice(F.reverse("n2"), 2, F.size("n2")))
    joined = met.select("source", "target", nodes.alias("nodes"), F.concat("r1", turned).alias("relations"))
    simple = joined.where(F.size(F.array_distinct("nodes")) == F.size("nodes")).distinct()
    order = Window.partitionBy("source", "target").orderBy(F.size("nodes"), F.array_join("nodes", "\u001f"), F.array_join("relations", "\u001f"))
    return simple.withColumn("g_rn", F.row_number().over(order)).where(F.col("g_rn") <= most).drop("g_rn")
