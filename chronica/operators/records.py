"""Decision records with what went before them, and the records most like a given one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronica.functions.scalars import jaccard
from chronica.functions.times import DAY, micros


def clean_value(value: Column, kind: str) -> Column:
    """A value as a record holds it: NaN is null, a time its ISO text, everything else as it is."""
    if kind in ("double", "float"):
        return F.when(~F.isnan(value), value)
    if kind.startswith("timestamp"):
        return F.translate(value.cast("string"), " ", "T")
    return value


def build_records(events: DataFrame, subject: str, episode: str, time: str, dose: str, tie: str, state: list[str]) -> DataFrame:
    """One record per episode: its first event, and a summary of every earlier episode of the subject up to that time.

    Gives record_id (subject_episode), subject, episode, t0, dose, state and prior, an array of structs, the farthest back first: episode,
    days_before, first_dose, n_doses, total, max_dose, truncated_at_t0 and the first event's state. An earlier episode
    started before t0; only its events before t0 count, and truncated_at_t0 says whether there are later ones. Rows
    with a null subject, episode or time take no part; of equal times the least ``tie`` comes first.

    An episode's events are first gathered to one row, so events meet only through episodes: each
    pair of episodes of a subject in time order, which is what the records hold.
    """
    kept = events.where(F.col(subject).isNotNull() & F.col(episode).isNotNull() & F.col(time).isNotNull())
    one = F.struct(micros(F.col(time)).alias("t"), F.col(tie).alias("i"), F.col(dose).cast("double").alias("d"), F.struct(*[F.col(c) for c in state]).alias("s"), F.col(time).alias("at"))
    by = kept.groupBy(F.col(subject).alias("subject"), F.col(episode).alias("episode")).agg(F.array_sort(F.collect_list(one)).alias("e"))
    first = by.select("subject", "episode", "e", F.col("e")[0].alias("f"))
    earlier = first.select("subject", F.col("episode").alias("p_episode"), F.col("e").alias("p_e"), F.col("f").alias("p_f"))
    met = first.drop("e").join(earlier, "subject").where(F.col("p_f.t") < F.col("f.t"))
    before = F.filter("p_e", lambda x: x.t < F.col("f.t"))
    doses = F.transform(before, lambda x: x.d)
    summary = F.struct(
        (-F.round((F.col("f.t") - F.col("p_f.t")) / DAY, 1)).alias("o"), F.col("p_episode").alias("episode"), F.round((F.col("f.t") - F.col("p_f.t")) / DAY, 1).alias("days_before"),
        F.col("p_f.d").alias("first_dose"), F.size(before).cast("bigint").alias("n_doses"), F.aggregate(doses, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("total"),
        F.array_max(doses).alias("max_dose"), (F.size(before) < F.size("p_e")).alias("truncated_at_t0"), F.col("p_f.s").alias("state"),
    )
    prior = met.groupBy("subject", "episode").agg(F.array_sort(F.collect_list(summary)).alias("prior"))
    out = first.drop("e").join(prior, ["subject", "episode"], "left")
    shown = F.transform("prior", lambda p: p.dropFields("o"))
    kind = F.coalesce(shown, F.array().cast(met.select(F.array(summary.dropFields("o")).alias("x")).schema["x"].dataType))
    return out.select(
        F.concat_ws("_", "subject", "episode").alias("record_id"), "subject", "episode", F.col("f.at").alias("t0"), F.col("f.d").alias("dose"), F.col("f.s").alias("state"), kind.alias("prior")
    )


def recent_concepts(profiles: DataFrame, last: int = 2) -> DataFrame:
    """(dose_id, concepts): the distinct concepts of the ``last`` visits of each profile that have any, sorted. Repeated profiles count once."""
    none = F.array().cast("array<string>")
    names = lambda v: F.concat(F.coalesce(v.conditions, none), F.coalesce(v.procedures, none), F.coalesce(v.drugs, none))
    held = F.array_sort(F.filter(F.transform("visits", lambda v: F.struct(v.number.alias("n"), names(v).alias("c"))), lambda x: F.size(x.c) > 0))
    recent = F.slice(held, F.greatest(F.lit(1), F.size(held) - last + 1), F.lit(last))
    every = F.filter(F.flatten(F.transform(recent, lambda x: x.c)), lambda c: c.isNotNull())
    rows = profiles.where("dose_id is not null").select("dose_id", F.coalesce(F.sort_array(F.array_distinct(every)), none).alias("concepts"))
    return rows.groupBy("dose_id").agg(F.max("concepts").alias("concepts"))


def scales(pool: DataFrame, numeric: list[str]) -> DataFrame:
    """One row with the population deviation of each number, as scale_name; 1 where it is 0 or missing."""
    spread = lambda c: F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0))
    return pool.agg(*[spread(c).alias(f"scale_{c}") for c in numeric])


def similar_records(queries: DataFrame, pool: DataFrame, record_id: str, subject: str, concepts: str, sex: str, numeric: list[str], most: int = 5) -> DataFrame:
    """For each query record the ``most`` pool records with the greatest Jaccard similarity of concepts, one per subject.

    Gives ``record_id``, neighbour, subject, similarity and rank. Ties go to the least demographic distance, then the least
    id: the distance is 1 for an unequal or missing sex, and for each number the difference over the pool's deviation,
    or 1 where one is missing. Records that share no concept are no neighbours. A query never meets
    its own id.

    Queries meet the pool through shared concepts by an equality join, and of each subject and query one row goes on, with partial
    results before the shuffle. Meant for a stated set of queries against all of a pool.
    """
    wide = pool.select(F.col(record_id).alias("p_id"), F.col(subject).alias("p_subject"), F.col(concepts).alias("p_concepts"), F.col(sex).alias("p_sex"), *[F.col(c).cast("double").alias(f"p_{c}") for c in numeric])
    asked = queries.select(F.col(record_id).alias("q_id"), F.col(concepts).alias("q_concepts"), F.col(sex).alias("q_sex"), *[F.col(c).cast("double").alias(f"q_{c}") for c in numeric])
    left = asked.select("q_id", F.explode("q_concepts").alias("c"))
    right = wide.select("p_id", F.explode("p_concepts").alias("c"))
    met = left.join(right, "c").select("q_id", "p_id").distinct().where("q_id <> p_id")
    one = scales(pool, numeric).first()  # one row
    apart = F.when(F.col("q_sex") == F.col("p_sex"), 0.0).otherwise(1.0)
    for c in numeric:
        apart = apart + F.coalesce(F.abs(F.col(f"q_{c}") - F.col(f"p_{c}")) / F.lit(one[f"scale_{c}"]), F.lit(1.0))
    scored = met.join(asked, "q_id").join(wide, "p_id").select(
        "q_id", "p_subject", F.struct((-jaccard(F.col("q_concepts"), F.col("p_concepts"))).alias("s"), F.round(apart, 9).alias("d"), F.col("p_id").alias("i")).alias("b")
    )
    best = scored.groupBy("q_id", "p_subject").agg(F.min("b").alias("b"))
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("b"))
    return best.withColumn("rank", rank).where(F.col("rank") <= most).select(
        F.col("q_id").alias(record_id), F.col("b.i").alias("neighbour"), F.col("p_subject").alias("subject"), (-F.col("b.s")).alias("similarity"), F.col("rank").cast("bigint").alias("rank")
    )


def state_concepts(flags: dict[str, Column], always: list[str]) -> Column:
    """The concepts a state stands for: those that always hold, and those of the flags that are set (not null, false, 0 or blank)."""
    marks = [F.lit(c) for c in always] + [F.when(flag, F.lit(name)) for name, flag in flags.items()]
    return F.array_distinct(F.filter(F.array(*marks), lambda x: x.isNotNull()))


def is_set(value: Column) -> Column:
    """Whether a flag of any kind is set: not null, false, 0 or blank."""
    text = F.trim(value.cast("string"))
    return F.coalesce(~F.lower(text).isin("", "0", "0.0", "false"), F.lit(False))


def dataset(records: DataFrame, split: str, features: list[Column], label: Column, group: Column, record_id: str) -> DataFrame:
    """The rows of a split with a label, as record_id, y, group and the features."""
    rows = records.where((F.col("split") == split) & label.isNotNull())
    return rows.select(record_id, label.cast("double").alias("y"), group.alias("group"), *features)
