"""Items that appear together: pair counts by basket collapsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronica.operators.ranks import sharded_rank
from chronica.session import cut, parallelism

#: A basket of more items is cut into blocks of so many, and pairs of blocks are shared out over the tasks.
MOST_IN_BLOCK = 2_000


def normalised(name: Column) -> Column:
    """A name trimmed, in lower case, with single inner spaces; blank is null."""
    bare = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    return F.when(bare != "", bare)


def baskets(records: DataFrame, record_id: str, lists: list[str]) -> DataFrame:
    """One row per record with its sorted distinct items: (record_id, items).

    A record is all rows of a ``record_id``; rows without one take no part. Null lists and null or
    blank names are nothing; a record may end up with no items.
    """
    every = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists])
    names = F.array_distinct(F.filter(F.transform(every, normalised), lambda x: x.isNotNull()))
    rows = records.where(F.col(record_id).isNotNull()).select(record_id, F.explode_outer(names).alias("item"))
    return rows.groupBy(record_id).agg(F.sort_array(F.collect_set("item")).alias("items"))


def _blocks(baskets: DataFrame) -> DataFrame:
    """Baskets cut into blocks: those of more than ``MOST_IN_BLOCK`` codes become pairs of blocks, spread over the tasks.

    Gives codes, others (the second block, null for the pairs inside of ``codes``) and w. Every pair of a basket is in one row.
    """
    step = MOST_IN_BLOCK
    small = baskets.where(F.size("codes") <= step).select("codes", F.lit(None).cast("array<int>").alias("others"), "w")
    n = F.ceil(F.size("codes") / step).cast("int")
    part = lambda k: F.slice("codes", k * step + 1, F.lit(step))
    large = baskets.where(F.size("codes") > step).select("codes", "w", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    large = large.select("codes", "w", "i", F.explode(F.sequence("i", F.ceil(F.size("codes") / step).cast("int") - 1)).alias("j"))
    cut_up = large.select(part(F.col("i")).alias("codes"), F.when(F.col("i") != F.col("j"), part(F.col("j"))).alias("others"), "w")
    return small.unionByName(cut_up.repartition(parallelism(baskets.sparkSession)))


def _pairs(blocks: DataFrame) -> DataFrame:
    """(a, b, w) for every pair of each row."""
    others = F.col("others") if "others" in blocks.columns else F.lit(None).cast("array<int>")
    first = blocks.select("codes", others.alias("others"), "w", F.posexplode("codes").alias("i", "a"))
    rest = F.coalesce("others", F.slice("codes", F.col("i") + 2, F.size("codes")))
    return first.select("a", F.explode(rest).alias("b"), "w")


def pair_counts(
    records: DataFrame, record_id: str, lists: list[str], least_count: int = 5, least_per_mille: int = 0
) -> DataFrame:
    """Pairs of items that share enough records, with how far that exceeds chance.

    Gives item_a < item_b, n_ab, n_a, n_b, n_records, lift = n_ab * N / (n_a * n_b) and conviction
    of a implying b = (1 - n_b/N) / (1 - n_ab/n_a), null where b always comes with a. Kept are
    pairs with n_ab >= ``least_count`` and n_ab * 1000 >= N * ``least_per_mille``; N counts all
    records, those without items too. No records give an empty table.

    Equal baskets are collapsed to one with a weight. An item rarer than the least pair count can
    be in no kept pair, so it is dropped from the baskets before pairs are made, after which more
    baskets are equal and are collapsed again. Items are numbered, so pairs travel as two numbers. Each distinct basket gives its pairs once, a very large one from several tasks, and the
    weights are summed with partial sums before the shuffle. The work follows the distinct baskets
    and the items frequent enough, not the number of records.
    """
    whole = baskets(records, record_id, lists)
    # The distinct baskets serve three times, and are what is left of the records.
    weighted = cut(whole.groupBy("items").agg(F.count(F.lit(1)).alias("w")))
    total, longest = weighted.agg(F.sum("w"), F.max(F.size("items"))).first()
    total, longest = total or 0, longest or 0
    single = weighted.select(F.explode("items").alias("item"), "w").groupBy("item").agg(F.sum("w").alias("n"))
    wide = "decimal(38,0)"
    single = single.withColumn("n_records", F.lit(total).cast("bigint"))
    enough = (F.col("n") >= least_count) & (F.col("n").cast(wide) * 1000 >= F.col("n_records").cast(wide) * least_per_mille)
    frequent = single.where(enough)

    # From here on an item is a number; names come back at the end.
    spread = F.pmod(F.xxhash64("item"), F.lit(max(64, parallelism(records.sparkSession))))
    coded = sharded_rank(frequent, [], [F.col("item")], spread, "code").withColumn("code", F.col("code").cast("int"))
    marked = weighted.where(F.size("items") > 1).withColumn("b", F.xxhash64("items")).withColumn("c", F.md5(F.concat_ws("\u001f", "items")))
    kept = marked.select("b", "c", "w", F.explode("items").alias("item")).join(coded.select("item", "code"), "item")
    again = kept.groupBy("b", "c").agg(F.first("w").alias("w"), F.sort_array(F.collect_list("code")).alias("codes"))
    again = again.where(F.size("codes") > 1).groupBy("codes").agg(F.sum("w").alias("w"))
    blocks = again if longest <= MOST_IN_BLOCK else _blocks(again)
    pairs = _pairs(blocks).groupBy("a", "b").agg(F.sum("w").alias("n_ab")).where(F.col("n_ab") >= least_count)
    name = lambda end: coded.select(F.col("code").alias(end), F.col("item").alias(f"item_{end}"))
    counted = pairs.join(name("a"), "a").join(name("b"), "b").select(
        F.least("item_a", "item_b").alias("item_a"), F.greatest("item_a", "item_b").alias("item_b"), "n_ab"
    )

    left = frequent.select(F.col("item").alias("item_a"), F.col("n").alias("n_a"), "n_records")
    right = frequent.select(F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    out = counted.join(left, "item_a").join(right, "item_b")
    out = out.where(F.col("n_ab").cast(wide) * 1000 >= F.col("n_records").cast(wide) * least_per_mille)
    a, b, ab, every = (F.col(c).cast("double") for c in ("n_a", "n_b", "n_ab", "n_records"))
    return out.select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", "n_records",
        (ab * every / (a * b)).alias("lift"),
        F.when(F.col("n_ab") < F.col("n_a"), (1 - b / every) / (1 - ab / a)).alias("conviction"),
    )


def beyond_chance(pairs: DataFrame, times: int = 3) -> DataFrame:
    """Pairs with n_ab * N >= ``times`` * n_a * n_b, in exact whole numbers."""
    wide = "decimal(38,0)"
    return pairs.where(
        F.col("n_ab").cast(wide) * F.col("n_records").cast(wide) >= F.col("n_a").cast(wide) * F.col("n_b").cast(wide) * times
    )
