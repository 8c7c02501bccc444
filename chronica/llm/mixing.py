"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of the scaled draw of each source, and of the bucket its threshold falls in.
BUCKETS = 8192
TOP = 8.0
#: The languages and topics that are raked by themselves; all others are one class, ``other``.
LANGUAGES = ("en", "de", "fr", "es", "unknown")
TOPICS = (
    "Hospital course", "Fluid balance", "Dosing", "Plan", "Monitoring", "Kidney impairment", "Escalation", "Results", "Adverse effects", "Special groups", "none",
)
OTHER = "other"


def language(lang: Column) -> Column:
    """The language of a tag in any case and with any region; null or blank is ``unknown``."""
    bare = F.lower(F.trim(lang))
    return F.when(bare.isNull() | (bare == ""), "unknown").otherwise(F.regexp_extract(bare, "^([^-_]*)", 1))


def rake(
    cells: list[tuple[str, str, str, float]], shares: dict[str, float], repeats: dict[str, int], total: float | None, rounds: int = 60
) -> tuple[dict[tuple[str, str, str], float], float]:
    """Repeats of each (source, language, topic) cell, and the total size aimed at.

    Sources get their share of the total, scaled to the sources that have any text. Within them
    languages and topics are raked to their shares in the eligible text. No cell goes beyond its
    source's cap; what a cap cuts off goes to the source's other cells, so the source's share is
    kept. By default the total is the largest at which every share can be reached.
    """
    size: dict[str, float] = {}
    for s, _, _, x in cells:
        size[s] = size.get(s, 0.0) + x
    live = {s: shares[s] for s in shares if size.get(s) and shares[s] > 0}
    if not live:
        return {}, 0.0
    scale = sum(live.values())
    live = {s: x / scale for s, x in live.items()}
    most = min(repeats[s] * size[s] / x for s, x in live.items())
    total = most if total is None else total
    goal = {s: min(total * x, repeats[s] * size[s]) for s, x in live.items()}
    every = sum(size[s] for s in live)
    margins: list[tuple[int, dict[str, float]]] = []
    for at in (1, 2):
        margin: dict[str, float] = {}
        for cell in cells:
            if cell[0] in live:
                margin[cell[at]] = margin.get(cell[at], 0.0) + cell[3] / every * sum(goal.values())
        margins.append((at, margin))
    weight = {c[:3]: c[3] for c in cells if c[0] in live and c[3] > 0}
    cap = {c[:3]: c[3] * repeats[c[0]] for c in cells if c[0] in live and c[3] > 0}
    for _ in range(rounds):
        for at, margin in [*margins, (0, goal)]:
            now: dict[str, float] = {}
            for key, x in weight.items():
                now[key[at]] = now.get(key[at], 0.0) + x
            for key in weight:
                if now[key[at]] > 0:
                    weight[key] = min(cap[key], weight[key] * margin[key[at]] / now[key[at]])
    for s, aim in goal.items():  # what the caps cut off goes to the source's cells with room
        mine = [k for k in weight if k[0] == s]
        for _ in range(50):
            lack = aim - sum(weight[k] for k in mine)
            room = sum(cap[k] - weight[k] for k in mine)
            if abs(lack) < 1e-9 * max(1.0, aim):
                break
            for k in mine:
                weight[k] = min(cap[k], weight[k] + lack * (cap[k] - weight[k]) / room) if lack > 0 and room > 0 else weight[k] * aim / (aim - lack)
    return {k: min(repeats[k[0]], round(x * repeats[k[0]] / cap[k], 9)) for k, x in weight.items()}, sum(goal.values())


def mix(
    docs: DataFrame, doc_id: str, source: str, lang: Column, topic: Column, size: str,
    targets: list[tuple[str, float, int]], total: float | None = None, seed: int = 17,
    languages: tuple[str, ...] = LANGUAGES, topics: tuple[str, ...] = TOPICS,
) -> DataFrame:
    """Copies of documents such that each source has its target share of the total size.

    Gives doc_id, source, language, topic, size and copy (from 1): one row per copy. ``targets`` has (source, share,
    most repeats). Sources without a target, null sources and documents without size are left
    out; a target without documents gets nothing and the other shares are scaled up. Repeated
    document ids are drawn together. An empty table gives an empty table. Languages and topics that aren't named are one class each; a null topic is ``none``.

    The sizes are summed by source, language and topic, which is all the raking needs: at most one row per
    target and named language and topic, whatever the data hold. Each document is then taken the whole part of its cell's
    repeats, and once more if a hash of its id, scaled by the rest, is below a threshold. The threshold is calibrated per
    source on sums by buckets of the hash, and again by as many buckets inside the one it falls in, so that the size drawn meets the
    target to about one document, whichever is nearer; no document is preferred for its length.
    No document is moved before the rows are written.
    """
    spark = docs.sparkSession
    names = [t[0] for t in targets]
    one_of = lambda c, named: F.when(c.isin(*named), c).otherwise(OTHER)
    rows = docs.where(F.col(source).isin(names) & (F.col(size) > 0)).select(
        F.col(doc_id).alias("d"), F.col(source).alias("s"), one_of(lang, languages).alias("l"), one_of(F.coalesce(topic, F.lit("none")), topics).alias("t"), F.col(size).cast("bigint").alias("z")
    )
    sums = rows.groupBy("s", "l", "t").agg(F.sum("z").alias("z")).collect()  # one row per cell of named classes
    repeats = {t[0]: int(t[2]) for t in targets}
    plan, _ = rake([(r["s"], r["l"], r["t"], float(r["z"])) for r in sums], {t[0]: float(t[1]) for t in targets}, repeats, total)
    shown = [F.col("d").alias(doc_id), F.col("s").alias(source), F.col("l").alias("language"), F.col("t").alias("topic"), F.col("z").alias(size)]
    if not plan:
        return rows.select(*shown, F.lit(1).alias("copy")).where("false")
    size_of = {(r["s"], r["l"], r["t"]): float(r["z"]) for r in sums}
    facts = [(*k, int(x), float(x - int(x))) for k, x in plan.items()]
    cells = F.broadcast(spark.createDataFrame(facts, "s string, l string, t string, times int, part double"))
    draw = (F.pmod(F.xxhash64(F.lit(seed), "d"), F.lit(1 << 40)) + 0.5) / (1 << 40)
    place = F.least(draw / F.col("part") * (BUCKETS / TOP), F.lit(float(BUCKETS)))
    drawn = rows.join(cells, ["s", "l", "t"]).withColumn("q", F.when(F.col("part") > 0, place))
    bucket = F.floor("q").cast("int")
    inner = F.floor((F.col("q") - F.floor("q")) * BUCKETS).cast("int")

    def threshold(sums: list[tuple[int, int]], lack: float) -> tuple[int, float]:
        """The first bucket that is too large for what is lacking, and what it must give."""
        for b, z in sorted(sums):
            if lack < z:
                return b, lack
            lack -= z
        return BUCKETS + 1, 0.0

    sources = sorted({k[0] for k in plan})
    lacks = {s: sum((x - int(x)) * size_of[k] for k, x in plan.items() if k[0] == s) for s in sources}
    by_bucket = drawn.where("q is not null").groupBy("s", bucket.alias("b")).agg(F.sum("z").alias("z")).collect()  # sources x buckets
    outer = {s: threshold([(r["b"], r["z"]) for r in by_bucket if r["s"] == s], lacks[s]) for s in sources}
    edge = F.broadcast(spark.createDataFrame([(s, outer[s][0]) for s in sources], "s string, edge int"))  # one row per source
    by_inner = drawn.join(edge, "s").where(bucket == F.col("edge")).groupBy("s", inner.alias("b")).agg(F.sum("z").alias("z")).collect()
    limits = []
    for s in sources:
        mine = sorted((r["b"], r["z"]) for r in by_inner if r["s"] == s)
        b, lack = threshold(mine, outer[s][1])
        if b < BUCKETS and 2 * lack > dict(mine)[b]:  # nearer with it than without
            b += 1
        limits.append((s, outer[s][0], b))
    limit = F.broadcast(spark.createDataFrame(limits, "s string, edge int, below int"))
    chosen = (bucket < F.col("edge")) | ((bucket == F.col("edge")) & (inner < F.col("below")))
    copies = F.col("times") + F.when(F.col("q").isNotNull() & chosen, 1).otherwise(0)
    taken = drawn.join(limit, "s").withColumn("copies", copies).where("copies > 0")
    return taken.select(*shown, F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))


def margins(mixed: DataFrame, source: str, size: str) -> DataFrame:
    """What each source, language and topic reached: (margin, value, tokens, share)."""
    by = mixed.groupBy(source, "language", "topic").agg(F.sum(size).alias("z"))  # one row per cell
    pairs = F.array(*[F.struct(F.lit(name).alias("margin"), F.col(c).alias("value")) for name, c in (("source", source), ("language", "language"), ("topic", "topic"))])
    long = by.select("z", F.inline(pairs)).groupBy("margin", "value").agg(F.sum("z").alias("tokens"))
    return long.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy("margin")))


def mix_report(mixed: DataFrame, source: str, size: str, targets: DataFrame) -> DataFrame:
    """For every target the share reached, in size, with documents, copies and the most repeats used."""
    by = mixed.groupBy(F.col(source).alias("source")).agg(
        F.sum(size).alias("tokens"), F.count(F.lit(1)).alias("copies"), F.count_if(F.col("copy") == 1).alias("documents"), F.max("copy").alias("repeats_used")
    )
    want = targets.select("source", "target_share", "max_repeats")
    every = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # over one row per source
    reached = by.withColumn("share_reached", F.col("tokens") / every)
    zero = {"tokens": 0, "copies": 0, "documents": 0, "repeats_used": 0, "share_reached": 0.0}
    out = want.join(reached, "source", "left").fillna(zero)
    return out.select("source", "target_share", "share_reached", "tokens", "documents", "copies", "repeats_used", "max_repeats")
