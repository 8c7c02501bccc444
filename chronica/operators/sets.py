"""Sets per entity: companions, equal sets, nearest sets, near-duplicate sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronica.functions.scalars import hamming, jaccard
from chronica.session import cut


def entity_sets(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Each entity with the sorted distinct items it has: (keys, items)."""
    return rows.where(F.col(item).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_set(item)).alias("items"))


def equal_sets(sets: DataFrame, items: str = "items") -> DataFrame:
    """Distinct sets with how many entities have them."""
    return sets.groupBy(items).agg(F.count(F.lit(1)).alias("n"))


def companions(sets: DataFrame, most: int) -> DataFrame:
    """For each item the ``most`` items that share most entities with it, ties by name: (item, other, n, rank).

    Equal sets are collapsed first; each distinct set gives its pairs once, weighted.
    """
    weighted = equal_sets(sets).where(F.size("items") > 1)
    first = weighted.select("items", "n", F.explode("items").alias("item"))
    pairs = first.select("item", F.explode("items").alias("other"), "n").where("item <> other").groupBy("item", "other").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("item").orderBy(F.col("n").desc(), "other")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def nearest_sets(sets: DataFrame, row_id: str, most: int) -> DataFrame:
    """For each entity the ``most`` others with the greatest Jaccard similarity above 0, ties by id.

    Gives (id, neighbour, similarity, rank). Equal sets are collapsed to classes: similarity is
    computed once per pair of classes that share an item. Of a class only the ``most`` + 1 least ids can be
    among anybody's neighbours, as ties are broken by id; so no class is ever expanded against
    another.
    """
    classes = cut(sets.groupBy("items").agg(F.min(row_id).alias("class")))
    members = sets.join(classes, "items").select("class", F.col(row_id).alias("m"))
    least = members.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("m"))).where(F.col("r") <= most + 1).drop("r")
    spread = classes.select("class", F.explode("items").alias("i"))
    met = spread.select(F.col("class").alias("a"), "i").join(spread.select(F.col("class").alias("b"), "i"), "i").select("a", "b").distinct()
    left, right = classes.select(F.col("class").alias("a"), F.col("items").alias("ia")), classes.select(F.col("class").alias("b"), F.col("items").alias("ib"))
    scored = met.join(left, "a").join(right, "b").select("a", "b", jaccard(F.col("ia"), F.col("ib")).alias("s"))
    near = scored.join(least.withColumnRenamed("class", "b"), "b")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.col("s").desc(), "m"))).where(F.col("r") <= most + 1)
    each = members.select(F.col("class").alias("a"), F.col("m").alias("q")).join(best.select("a", "m", "s"), "a").where("q <> m")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc(), "m"))).where(F.col("rank") <= most)
    return ranked.select(F.col("q").alias(row_id), F.col("m").alias("neighbour"), F.col("s").alias("similarity"), "rank")


def near_candidates(large: DataFrame, order: str, apart: int, least_items: int) -> DataFrame:
    """(a, b), a before b in ``order``: every pair of sets that differ in fewer than ``apart`` items, and few others.

    Let one set have k items more than the other, and both differ in at most d = ``apart`` - 1. Then at most (d + k) / 2 items of the longer and
    (d - k) / 2 of the shorter are not in the other, so the rarest (d + k) / 2 + 2 and (d - k) / 2 + 2 items of the two share two at
    least: of the two prefixes, all that is common in the one that ends first is in the other. So for each k sets meet by pairs of
    their rarest items, with the size of the shorter; sets too small for this meet by single items or by size alone. What meets is compared
    inside the join by the parities of its items over 128 bits, which never differ in more places than the sets do; only pairs that
    pass are ever written.
    """
    d = apart - 1
    counts = large.select(F.explode("items").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    each = large.select(F.col(order).alias("o"), F.explode("items").alias("i")).join(counts, "i").withColumn("h", F.xxhash64("i"))
    bits = [F.bit_xor(F.expr(f"CASE WHEN pmod(h, 128) DIV 64 = {k} THEN shiftleft(1L, CAST(pmod(h, 64) AS INT)) ELSE 0L END")).alias(f"p{k}") for k in (0, 1)]
    rare = F.slice(F.sort_array(F.collect_list(F.struct("n", "i", "h"))), 1, d + 2)["h"]
    marked = cut(each.groupBy("o").agg(F.count(F.lit(1)).alias("size"), *bits, rare.alias("rare")))

    def keys(k: int, own: int, size: Column) -> Column:
        """Keys of a set as one of two whose sizes are ``size`` and ``size`` + k; up to ``own`` of its items are not in the other."""
        key = lambda *at: F.xxhash64(F.lit(k), size, *[F.get("rare", F.lit(i)) for i in at])
        pairs = F.array(*[key(i, j) for j in range(own + 2) for i in range(j)])
        both = size - (d - k) // 2  # at least so many items of the shorter are in both
        met = F.when(both >= 2, pairs).when(both == 1, F.array(*[key(i) for i in range(own + 1)])).otherwise(F.array(key()))
        return F.when(size > least_items, met).otherwise(F.array().cast("array<bigint>"))

    def side(name: str, lists: list[Column]) -> DataFrame:
        return marked.select(F.explode(F.concat(*lists)).alias("key"), *[F.col(c).alias(f"{name}_{c}") for c in ("o", "size", "p0", "p1")])

    short = side("l", [keys(k, (d - k) // 2, F.col("size")) for k in range(d + 1)])
    long = side("r", [keys(k, (d + k) // 2, F.col("size") - k) for k in range(d + 1)])
    parity = sum((F.bit_count(F.col(f"l_p{k}").bitwiseXOR(F.col(f"r_p{k}"))) for k in (0, 1)), F.lit(0))
    once = (F.col("l_size") < F.col("r_size")) | (F.col("l_o") < F.col("r_o"))
    met = short.join(long, (short["key"] == long["key"]) & (parity < apart) & once)
    return met.select(F.least("l_o", "r_o").alias("a"), F.greatest("l_o", "r_o").alias("b")).distinct()


def drop_near_sets(sets: DataFrame, order: str, apart: int = 5, least_items: int = 10) -> DataFrame:
    """Sets left by a greedy pass in ``order``: one goes if an earlier kept one differs in fewer than ``apart`` items.

    Only sets of more than ``least_items`` are compared. ``sets`` has distinct items and a unique
    ``order``. Pairs come from ``near_candidates`` and are then compared item by item. The greedy
    pass runs in rounds: a set is kept once all its earlier neighbours are gone, and goes once one
    of them is kept.
    """
    if apart < 2:
        return sets
    large = cut(sets.where(F.size("items") > least_items).select(order, "items"))
    met = near_candidates(large, order, apart, least_items)
    left, right = large.select(F.col(order).alias("a"), F.col("items").alias("x")), large.select(F.col(order).alias("b"), F.col("items").alias("y"))
    near = met.join(left, "a").join(right, "b").where(hamming(F.col("x"), F.col("y")) < apart).select("a", "b")
    edges = cut(near)
    gone = None
    while edges.head(1):
        heads = edges.select(F.col("a").alias("h")).distinct().join(edges.select(F.col("b").alias("h")).distinct(), "h", "left_anti")
        out = cut(edges.join(heads, F.col("a") == F.col("h"), "left_semi").select(F.col("b").alias(order)).distinct())
        gone = out if gone is None else gone.unionByName(out)
        dead = out.select(F.col(order).alias("h"))
        edges = edges.join(heads, F.col("a") == F.col("h"), "left_anti").join(dead, F.col("a") == F.col("h"), "left_anti").join(dead, F.col("b") == F.col("h"), "left_anti")
        edges = cut(edges)
    return sets if gone is None else sets.join(gone, order, "left_anti")
