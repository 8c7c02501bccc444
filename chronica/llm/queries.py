"""Registered queries of this folder's operators, over the whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronica.functions.ids import number_of
from chronica.functions.times import DAY, HOUR, is_date_only, micros, parse_stamp
from chronica.llm import cooccurrence, known, mixing, nearest, packing, residue, splits
from chronica.llm.tokens import VOCABULARY, token_count
from chronica.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]
LISTS = ["conditions", "procedures", "drugs"]
BANDS = ["le20", "40_60", "ge80"]


def _persons(spark: SparkSession, folder: str, edges_per_task: int = 1_000_000) -> DataFrame:
    links = table(spark, folder, "subject_links").select(
        number_of(F.col("old_subject_id")).alias("a"), number_of(F.col("new_subject_id")).alias("b")
    )
    cohort = table(spark, folder, "cohort").select(
        "hadm_id", "subject_id", F.lower(F.trim(F.regexp_replace("dose_band", r"\s+", ""))).alias("dose_band")
    )
    return splits.with_entity(cohort, number_of(F.col("subject_id")), links, "a", "b", "person", edges_per_task)


def p1_found(spark: SparkSession, folder: str, edges_per_task: int = 1_000_000) -> DataFrame:
    """For each person with several admissions the least hadm_id with each of the others."""
    pairs = splits.pairs_with_first(_persons(spark, folder, edges_per_task), "hadm_id", "person")
    return pairs.select(F.col("a").alias("hadm_id_a"), F.col("b").alias("hadm_id_b"))


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Every cohort record with its split."""
    targets = [(r["split_name"], float(r["share"])) for r in table(spark, folder, "split_targets").collect()]
    return splits.split_by_entity(_persons(spark, folder), "hadm_id", "person", "dose_band", BANDS, targets)


def p1_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of records each split reached, overall and by dose band."""
    return splits.shares_reached(p1_splits(spark, folder), "dose_band", table(spark, folder, "split_targets"))


def p1_together(spark: SparkSession, folder: str) -> DataFrame:
    """Records and persons that were split, and how many persons lie in more than one split: none."""
    by = p1_splits(spark, folder).where("person is not null").groupBy("person").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("k"))
    return by.agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("persons"), F.count_if(F.col("k") > 1).alias("torn"))


def p3_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All item pairs in at least 5 visits, with lift and conviction."""
    return cooccurrence.pair_counts(table(spark, folder, "visits"), "hadm_id", LISTS)


def p3_every_pair(spark: SparkSession, folder: str) -> DataFrame:
    """All item pairs that share a visit, however rare, with lift and conviction."""
    return cooccurrence.pair_counts(table(spark, folder, "visits"), "hadm_id", LISTS, 1)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Item pairs that share enough visits and at least three times as many as by chance."""
    pairs = cooccurrence.pair_counts(table(spark, folder, "visits"), "hadm_id", LISTS, 5, 1)
    return cooccurrence.beyond_chance(pairs, 3).select("item_a", "item_b")


def p4_found(spark: SparkSession, folder: str, most_rows: int = 500_000) -> DataFrame:
    """For each cohort record and itemid the result nearest to t_dec within two hours."""
    within = 2 * HOUR
    labs = table(spark, folder, "labevents").where(F.col("valuenum").isNotNull() & ~F.isnan("valuenum")).select(
        number_of(F.col("subject_id")).alias("subject"), "itemid", micros(F.coalesce("charttime", "storetime")).alias("time"), "labevent_id"
    )
    labs = labs.where("time is not null and subject is not null and itemid is not null")
    records = table(spark, folder, "cohort").select(
        number_of(F.col("subject_id")).alias("subject"), "hadm_id", micros(F.col("t_dec")).alias("time")
    ).where("time is not null and subject is not null").distinct()
    # Results in none of the two-hour cells around a record of their subject can't be near one; the others are written once.
    cell = F.floor(F.col("time") / within)
    cells = records.select("subject", F.explode(F.sequence(cell - 1, cell + 1)).alias("cell")).distinct()
    near = cut(labs.withColumn("cell", cell).join(cells, ["subject", "cell"], "left_semi").drop("cell"))
    # A record asks for the items its subject has there.
    asked = records.join(near.select("subject", "itemid").distinct(), "subject")
    found = nearest.nearest_in_time(asked, near, ["subject", "itemid"], "time", "hadm_id", "labevent_id", within, most_rows)
    # Several records of one hadm_id: the nearest of their results.
    best = found.groupBy("hadm_id", "itemid").agg(F.min(F.struct(F.abs("apart").alias("d"), "apart", "labevent_id")).alias("m"))
    return best.select("hadm_id", "itemid", F.col("m.labevent_id").alias("labevent_id"))


COLUMNS = {"uo_6h_after_ml": 6.0, "escalated_24h": 24.0, "creatinine_after_48h": 48.0}


KNOWN_KEYS = ["origin", "record_id", "item"]


def _profile_knowledge(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles and concepts with their index time and the times they were known, in microseconds."""
    times = known.concept_times(table(spark, folder, "profiles").where("dose_id is not null"))
    stamp = micros(parse_stamp(F.col("known_text")))
    end = F.when(is_date_only(F.col("known_text")), stamp + DAY - 1).otherwise(stamp)
    keys = [F.lit("profile").alias("origin"), F.col("dose_id").alias("record_id"), F.col("concept").alias("item")]
    return times.select(*keys, micros(parse_stamp(F.col("index_t0"))).cast("double").alias("asked"), end.cast("double").alias("known"))


def _history_knowledge(spark: SparkSession, folder: str) -> DataFrame:
    """History events and columns on an axis of hours from t_dec."""
    rows = table(spark, folder, "history_events").where("hours_before_t_dec is not null and not isnan(hours_before_t_dec)")
    one = lambda item, after: F.struct(F.lit(item).alias("item"), F.lit(after).alias("after"))
    columns = [F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.col("hours_before_t_dec") > 0), one(c, h)) for c, h in COLUMNS.items()]
    parts = F.filter(F.array(one("row", 0.0), *columns), lambda x: x.isNotNull())
    long = rows.select(F.col("hist_id").cast("string").alias("record_id"), F.col("hours_before_t_dec").alias("h"), F.inline(parts))
    return long.select(F.lit("history").alias("origin"), "record_id", "item", F.lit(0.0).alias("asked"), (F.col("after") - F.col("h")).alias("known"))


def _knowledge(spark: SparkSession, folder: str, most_rows: int) -> DataFrame:
    """(origin, record_id, item, known_at): the time at which the item was known before it is asked for, or null."""
    both = _profile_knowledge(spark, folder).unionByName(_history_knowledge(spark, folder))
    # A row must be known before t_dec; a response whose window closes at t_dec is known.
    upto = (F.col("origin") == "history") & (F.col("item") != "row")
    return known.was_known(both, KNOWN_KEYS, "asked", "known", upto, most_rows)


def p7_found(spark: SparkSession, folder: str, most_rows: int = 500_000) -> DataFrame:
    """What stands in a profile or a history event but was not known at its time."""
    return _knowledge(spark, folder, most_rows).where("known_at is null").select(*KNOWN_KEYS)


def p7_known(spark: SparkSession, folder: str, most_rows: int = 500_000) -> DataFrame:
    """What was known at the time of the profile or history event: the parts that may be used."""
    return _knowledge(spark, folder, most_rows).where("known_at is not null").select(*KNOWN_KEYS)


def _sizes(spark: SparkSession, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return table(spark, folder, "documents").withColumn("tokens", token_count("text", vocabulary))


def _capacities(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    return [(r["pack_name"], int(r["capacity_tokens"])) for r in table(spark, folder, "pack_sizes").orderBy("capacity_tokens").collect()]


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's container, for each capacity."""
    return packing.pack(_sizes(spark, folder).select("doc_id", "tokens"), "doc_id", "tokens", _capacities(spark, folder))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.fill_report(p8_pack(spark, folder), _capacities(spark, folder))


def p8_held(spark: SparkSession, folder: str) -> DataFrame:
    """Per pack the documents, containers over their capacity, and documents whose pieces aren't theirs: none."""
    caps = _capacities(spark, folder)
    sizes = _sizes(spark, folder).select("doc_id", "tokens")
    packed = packing.pack(sizes, "doc_id", "tokens", caps)
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in caps for x in kv]), F.col("pack_name"))
    over = packed.where("container is not null").groupBy("pack_name", "container").agg(F.sum("piece_size").alias("z")).groupBy("pack_name").agg(F.count_if(F.col("z") > limit).alias("over_full"))
    whole = packed.groupBy("pack_name", "doc_id").agg(F.coalesce(F.sum("piece_size"), F.lit(0)).alias("z"), F.count(F.lit(1)).alias("k"))
    torn = whole.join(sizes, "doc_id").groupBy("pack_name").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("z") != F.coalesce("tokens", F.lit(0))) | ((F.col("k") > 1) & (F.col("tokens") <= limit))).alias("torn")
    )
    return torn.join(over, "pack_name").select("pack_name", "documents", "over_full", "torn")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of documents such that each source has its target share of all tokens."""
    targets = [(r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in table(spark, folder, "source_targets").collect()]
    docs = cut(_sizes(spark, folder).select("doc_id", "source", "lang", F.get("section_path", F.lit(0)).alias("topic"), "tokens"))
    return mixing.mix(docs, "doc_id", "source", mixing.language(F.col("lang")), F.col("topic"), "tokens", targets)


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of all tokens each source reached, beside its target."""
    return mixing.mix_report(p9_mix(spark, folder), "source", "tokens", table(spark, folder, "source_targets"))


def p9_margins(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens and share that each source, language and topic reached."""
    return mixing.margins(p9_mix(spark, folder), "source", "tokens")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text holds residue."""
    return residue.residue(table(spark, folder, "documents"), "doc_id", "text").where("is_residue").select("doc_id")


def p10_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without residue."""
    return residue.residue(table(spark, folder, "documents"), "doc_id", "text").where("not is_residue").select("doc_id")


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found, "p1_splits": p1_splits, "p1_shares": p1_shares, "p1_together": p1_together, "p3_found": p3_found, "p3_pairs": p3_pairs, "p3_every_pair": p3_every_pair,
        "p4_found": p4_found, "p7_found": p7_found, "p7_known": p7_known, "p8_pack": p8_pack, "p8_fill": p8_fill, "p8_held": p8_held,
        "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_margins": p9_margins, "p10_found": p10_found, "p10_kept": p10_kept,
    }
