"""Registered queries of the reference's record-level operators over the project's own tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronica.functions.ids import number_of
from chronica.functions.times import micros
from chronica.operators import history, profiles, report, sampling, temporal
from chronica.session import table
from chronica.sources import external

Query = Callable[[SparkSession, str], DataFrame]
CHRONIC = ["long-standing renal decline", "congestive pump failure", "raised arterial pressure"]
STAMPS = {"conditions": None, "procedures": "procedure_times", "drugs": "drug_times"}


def visit_items(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.visit_items(table(spark, folder, "visits"), "hadm_id", STAMPS)


def visits_with_enough(spark: SparkSession, folder: str) -> DataFrame:
    out = profiles.with_enough(visit_items(spark, folder), "hadm_id", 2)
    return out.select("hadm_id", *[F.size(c).cast("bigint").alias(f"n_{c}") for c in ("conditions", "procedures", "drugs")])


def index_visit_cut(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.index_cut(table(spark, folder, "profiles"), CHRONIC)


def consecutive_visit_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.consecutive_pairs(table(spark, folder, "profiles")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("newest").alias("newest"))


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "cohort").select(number_of(F.col("subject_id")).alias("s"), "hadm_id", "t_dec")
    return c.where("t_dec is not null").distinct()


def latest_visible_lab(spark: SparkSession, folder: str) -> DataFrame:
    """The latest creatinine charted in the 48 hours before the decision and stored before it."""
    labs = table(spark, folder, "labevents").where("itemid = '510101' and valuenum > 0").select(number_of(F.col("subject_id")).alias("s"), "charttime", "storetime", "valuenum", "labevent_id")
    two_days = F.make_interval(hours=F.lit(48))
    met = _targets(spark, folder).join(labs, "s").where((F.col("storetime") < F.col("t_dec")) & (F.col("charttime") >= F.col("t_dec") - two_days))
    return met.groupBy("hadm_id").agg(F.max_by("valuenum", F.struct("charttime", "labevent_id")).alias("value"), F.count(F.lit(1)).alias("n"))


def late_results(spark: SparkSession, folder: str) -> DataFrame:
    """Per item, results drawn before the decision but stored only afterwards: what a leak would use."""
    labs = table(spark, folder, "labevents").select(number_of(F.col("subject_id")).alias("s"), "itemid", "charttime", "storetime")
    met = temporal.join_within(_targets(spark, folder), labs, "s", "t_dec", "charttime", 24)
    return met.groupBy("itemid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("storetime") >= F.col("t_dec")).alias("late"))


def chart_latest_by_item(spark: SparkSession, folder: str) -> DataFrame:
    """The last visible number of each item in the 6 hours before the decision."""
    rows = table(spark, folder, "chartevents").where("valuenum is not null").select("hadm_id", "itemid", "charttime", "storetime", "valuenum", "chartevent_id")
    met = _targets(spark, folder).join(rows, "hadm_id").where((F.col("storetime") < F.col("t_dec")) & (F.col("charttime") >= F.col("t_dec") - F.make_interval(hours=F.lit(6))))
    return met.groupBy("hadm_id", "itemid").agg(F.max_by("valuenum", F.struct("charttime", "chartevent_id")).alias("value"))


def history_features(spark: SparkSession, folder: str) -> DataFrame:
    """Roll-up of each admission's earlier events: counts, span, doses; the last event's dose even where it is missing."""
    h = table(spark, folder, "history_events").where("hours_before_t_dec > 0")
    return h.groupBy("hadm_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_hadm_id").alias("n_admissions"), F.max("dose_mg").alias("max_dose"), F.sum("dose_mg").alias("total_dose"),
        F.min("hours_before_t_dec").alias("hours_since"), F.min_by("dose_mg", F.struct("hours_before_t_dec", "hist_id")).alias("last_dose"),
        F.min_by("dose_mg", F.when(F.col("dose_mg").isNotNull(), F.struct("hours_before_t_dec", "hist_id"))).alias("last_known_dose"),
        F.count_if(F.col("kind") == "bolus").alias("n_bolus"), F.expr("percentile(dose_mg, 0.5D)").alias("median_dose"),
    )


def prior_admission_records(spark: SparkSession, folder: str) -> DataFrame:
    """Dose records with their earlier admissions flattened: how many, the nearest, its dose, any truncated."""
    d = table(spark, folder, "dose_records").dropDuplicates(["dose_id"]).select("dose_id", F.explode("prior_admissions").alias("p"))
    return d.groupBy("dose_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("p.days_before").alias("nearest"), F.sum("p.n_doses").alias("doses"), F.bool_or(F.coalesce("p.truncated_at_t0", F.lit(False))).alias("truncated")
    )


def split_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Records, subjects and doses of each declared split."""
    d = table(spark, folder, "dose_records").dropDuplicates(["dose_id"])
    split = F.coalesce(F.nullif(F.trim("split"), F.lit("")), F.lit("none"))
    return d.groupBy(split.alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("subject_id").alias("subjects"), F.expr("percentile(label.dose_mg, 0.5D)").alias("median_dose"), F.round(F.avg("label.dose_mg"), 6).alias("mean_dose")
    )


def eval_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Training records, and outside of training the last record of each subject."""
    d = table(spark, folder, "dose_records").dropDuplicates(["dose_id"]).select("dose_id", "subject_id", "t0", F.coalesce("split", F.lit("")).alias("split"))
    last = history.latest_per_key(d.where("split <> 'train'"), "subject_id", [F.col("t0").desc(), F.col("dose_id").desc()])
    return d.where("split = 'train'").unionByName(last).select("dose_id", "split")


def copy_last_floor(spark: SparkSession, folder: str) -> DataFrame:
    """Error of repeating the first dose of the nearest earlier admission."""
    d = table(spark, folder, "dose_records").dropDuplicates(["dose_id"]).select("dose_id", F.col("label.dose_mg").alias("y"), F.explode("prior_admissions").alias("p"))
    near = d.where("p.first_dose_mg is not null").groupBy("dose_id").agg(F.first("y").alias("y"), F.min_by("p.first_dose_mg", F.struct("p.days_before", "p.hadm_id")).alias("p"))
    return report.error_metrics(near, F.col("y"), F.col("p")).select("n", F.round("mae", 6).alias("mae"))


def plausible_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Charted numbers per item: how many, quartiles."""
    out = report.quantiles(table(spark, folder, "chartevents"), ["itemid"], "valuenum", (0.25, 0.5, 0.75))
    return out


def infusion_rate_events(spark: SparkSession, folder: str) -> DataFrame:
    """History events in one schema: bolus or infusion, milligrams given, rate times duration where no dose is written."""
    h = table(spark, folder, "history_events")
    kind = F.when(F.col("kind").isin("bolus", "oral"), F.col("kind")).otherwise("infusion")
    given = F.coalesce("dose_mg", F.when(kind == "infusion", F.col("rate_mg_h") * F.col("duration_h")))
    return h.groupBy(kind.alias("kind"), F.col("scope")).agg(F.count(F.lit(1)).alias("n"), F.count(given).alias("with_dose"), F.round(F.sum(given), 2).alias("total_mg"))


def group_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Records by fold of their subject; a subject is in one fold."""
    c = table(spark, folder, "cohort").select(number_of(F.col("subject_id")).alias("s"), "hadm_id").distinct()
    return c.where("s is not null").groupBy(sampling.fold(F.col("s"), 5, 3).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("subjects"))


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Each dose record's state as JSON without nulls."""
    d = table(spark, folder, "dose_records").dropDuplicates(["dose_id"])
    return d.select("dose_id", external.payload([F.col("state.sex").alias("sex"), F.col("state.ckd_stage").alias("ckd_stage"), F.col("split").alias("split")]).alias("payload"))


def hours_since_admission(spark: SparkSession, folder: str) -> DataFrame:
    """Hours from admission to decision, by right-closed bins."""
    c = table(spark, folder, "cohort").dropDuplicates(["hadm_id"])
    h = (micros(F.col("t_dec")) - micros(F.col("admittime"))) / 3.6e9
    label = F.when(h.isNull(), "none").when(h <= 6, "to 6").when(h <= 24, "to 24").otherwise("later")
    return c.groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_N = """CASE WHEN regexp_full_match(regexp_replace({0}, '\\s', '', 'g'), '[0-9]+(\\.[0-9]+)?[eE]\\+?[0-9]+') THEN CAST(CAST(regexp_replace({0}, '\\s', '', 'g') AS DOUBLE) AS BIGINT)
  WHEN regexp_full_match(regexp_replace({0}, '\\s', '', 'g'), '[0-9]+\\.0*') THEN CAST(regexp_extract(regexp_replace({0}, '\\s', '', 'g'), '^([0-9]+)\\.', 1) AS BIGINT)
  ELSE TRY_CAST(nullif(regexp_replace({0}, '[^0-9]', '', 'g'), '') AS BIGINT) END""".format("subject_id")
_T = f"t AS (SELECT DISTINCT {_N} AS s, hadm_id, t_dec FROM cohort WHERE t_dec IS NOT NULL)"
_D = "d AS (SELECT dose_id, any_value(subject_id) AS subject_id, any_value(t0) AS t0, any_value(split) AS split, any_value(state) AS state, any_value(prior_admissions) AS prior_admissions, any_value(label) AS label FROM dose_records GROUP BY dose_id)"
_I = """i AS (SELECT hadm_id, kind, lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) AS item, min(replace(stamp, 'T', ' ')) AS first_stamp FROM (
    SELECT hadm_id, 'conditions' AS kind, unnest(conditions) AS raw, NULL AS stamp FROM visits
    UNION ALL SELECT hadm_id, 'procedures', raw, m[raw] FROM (SELECT hadm_id, unnest(procedures) AS raw, procedure_times AS m FROM visits)
    UNION ALL SELECT hadm_id, 'drugs', raw, m[raw] FROM (SELECT hadm_id, unnest(drugs) AS raw, drug_times AS m FROM visits))
  WHERE raw IS NOT NULL AND trim(regexp_replace(raw, '\\s+', ' ', 'g')) <> '' GROUP BY ALL)"""
_CHRONIC = ", ".join(f"'{c}'" for c in CHRONIC)

SQL = {
    "visit_items": f"WITH {_I} SELECT hadm_id, kind, item, first_stamp FROM i",
    "visits_with_enough": f"""WITH {_I} SELECT hadm_id, count(*) FILTER (kind = 'conditions') AS n_conditions, count(*) FILTER (kind = 'procedures') AS n_procedures,
      count(*) FILTER (kind = 'drugs') AS n_drugs FROM i GROUP BY hadm_id HAVING count(*) >= 2""",
    "index_visit_cut": f"""WITH p AS (SELECT DISTINCT dose_id, replace(index_t0, 'T', ' ') AS t0, unnest(visits) AS v FROM profiles),
      k AS (SELECT DISTINCT dose_id, unnest(v.conditions) AS c FROM p WHERE NOT v.is_index),
      c AS (SELECT dose_id, t0, 'conditions' AS kind, unnest(v.conditions) AS concept, v.concept_times AS m FROM p WHERE v.is_index
        UNION ALL SELECT dose_id, t0, 'procedures', unnest(v.procedures), v.concept_times FROM p WHERE v.is_index UNION ALL SELECT dose_id, t0, 'drugs', unnest(v.drugs), v.concept_times FROM p WHERE v.is_index),
      s AS (SELECT *, replace(m[concept], 'T', ' ') AS st FROM c)
      SELECT DISTINCT dose_id, kind, concept FROM s WHERE CASE WHEN kind = 'conditions' THEN concept IN ({_CHRONIC}) OR (dose_id, concept) IN (SELECT dose_id, c FROM k)
        WHEN length(st) <= 10 THEN st < t0[1:10] ELSE st < t0 END""",
    "consecutive_visit_pairs": """WITH v AS (SELECT DISTINCT dose_id, v.number AS n, list_sort(list_distinct(list_concat(list_concat(coalesce(v.conditions, []), coalesce(v.procedures, [])), coalesce(v.drugs, [])))) AS c
        FROM (SELECT dose_id, unnest(visits) AS v FROM profiles)),
      w AS (SELECT dose_id, c, lead(c) OVER (PARTITION BY dose_id ORDER BY n) AS nx, lead(n) OVER (PARTITION BY dose_id ORDER BY n) AS m FROM v WHERE len(c) > 0),
      x AS (SELECT dose_id, m, unnest(c) AS x, nx FROM w WHERE nx IS NOT NULL), y AS (SELECT dose_id, m, x, unnest(nx) AS y FROM x),
      z AS (SELECT dose_id, least(x, y) AS a, greatest(x, y) AS b, max(m) AS newest FROM y WHERE x <> y GROUP BY ALL)
      SELECT a, b, count(*) AS n, max(newest) AS newest FROM z GROUP BY a, b""",
    "latest_visible_lab": f"""WITH {_T}, l AS (SELECT {_N} AS s, charttime, storetime, valuenum, labevent_id FROM labevents WHERE itemid = '510101' AND valuenum > 0)
      SELECT hadm_id, arg_max(valuenum, {{'a': charttime, 'b': labevent_id}}) AS value, count(*) AS n FROM t JOIN l USING (s) WHERE storetime < t_dec AND charttime >= t_dec - INTERVAL 48 HOUR GROUP BY hadm_id""",
    "late_results": f"""WITH {_T}, l AS (SELECT {_N} AS s, itemid, charttime, storetime FROM labevents)
      SELECT itemid, count(*) AS n, count(*) FILTER (storetime >= t_dec) AS late FROM t JOIN l USING (s) WHERE charttime < t_dec AND charttime >= t_dec - INTERVAL 24 HOUR GROUP BY itemid""",
    "chart_latest_by_item": f"""WITH {_T} SELECT t.hadm_id, itemid, arg_max(valuenum, {{'a': charttime, 'b': chartevent_id}}) AS value FROM t JOIN chartevents c ON c.hadm_id = t.hadm_id
      WHERE valuenum IS NOT NULL AND storetime < t_dec AND charttime >= t_dec - INTERVAL 6 HOUR GROUP BY ALL""",
    "history_features": """WITH h AS (SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY hours_before_t_dec, hist_id) AS rn FROM history_events WHERE hours_before_t_dec > 0)
      SELECT hadm_id, count(*) AS n, count(DISTINCT event_hadm_id) AS n_admissions, max(dose_mg) AS max_dose, sum(dose_mg) AS total_dose, min(hours_before_t_dec) AS hours_since,
        max(dose_mg) FILTER (rn = 1) AS last_dose, arg_min(dose_mg, rn) FILTER (dose_mg IS NOT NULL) AS last_known_dose, count(*) FILTER (kind = 'bolus') AS n_bolus, median(dose_mg) AS median_dose FROM h GROUP BY hadm_id""",
    "prior_admission_records": f"""WITH {_D}, p AS (SELECT dose_id, unnest(prior_admissions) AS p FROM d)
      SELECT dose_id, count(*) AS n, min(p.days_before) AS nearest, sum(p.n_doses)::BIGINT AS doses, bool_or(coalesce(p.truncated_at_t0, false)) AS truncated FROM p GROUP BY dose_id""",
    "split_balance": f"""WITH {_D} SELECT coalesce(nullif(trim(split), ''), 'none') AS split, count(*) AS n, count(DISTINCT subject_id) AS subjects, median(label.dose_mg) AS median_dose, round(avg(label.dose_mg), 6) AS mean_dose FROM d GROUP BY 1""",
    "eval_targets": f"""WITH {_D}, e AS (SELECT dose_id, subject_id, t0, coalesce(split, '') AS split FROM d)
      SELECT dose_id, split FROM e WHERE split = 'train' UNION ALL (SELECT dose_id, split FROM e WHERE split <> 'train' QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY t0 DESC, dose_id DESC) = 1)""",
    "copy_last_floor": f"""WITH {_D}, p AS (SELECT dose_id, label.dose_mg AS y, unnest(prior_admissions) AS p FROM d),
      n AS (SELECT dose_id, y, p.first_dose_mg AS g FROM p WHERE p.first_dose_mg IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dose_id ORDER BY p.days_before NULLS FIRST, p.hadm_id NULLS FIRST) = 1)
      SELECT count(y) AS n, round(avg(abs(y - g)), 6) AS mae FROM n""",
    "plausible_readings": "SELECT itemid, count(*) AS n, quantile_cont(valuenum, 0.25) AS p25, quantile_cont(valuenum, 0.5) AS p50, quantile_cont(valuenum, 0.75) AS p75 FROM chartevents WHERE valuenum IS NOT NULL GROUP BY 1",
    "infusion_rate_events": """WITH h AS (SELECT CASE WHEN kind IN ('bolus', 'oral') THEN kind ELSE 'infusion' END AS k, scope, dose_mg, rate_mg_h * duration_h AS r FROM history_events)
      SELECT k AS kind, scope, count(*) AS n, count(coalesce(dose_mg, CASE WHEN k = 'infusion' THEN r END)) AS with_dose, round(sum(coalesce(dose_mg, CASE WHEN k = 'infusion' THEN r END)), 2) AS total_mg FROM h GROUP BY ALL""",
    "payloads": f"""WITH {_D}, p AS (SELECT dose_id, [CASE WHEN state.sex IS NOT NULL THEN '"sex":"' || state.sex || '"' END, CASE WHEN state.ckd_stage IS NOT NULL THEN '"ckd_stage":"' || state.ckd_stage || '"' END, CASE WHEN split IS NOT NULL THEN '"split":"' || split || '"' END] AS f FROM d)
      SELECT dose_id, '{{' || array_to_string(list_filter(f, lambda x: x IS NOT NULL), ',') || '}}' AS payload FROM p""",
    "hours_since_admission": """WITH c AS (SELECT hadm_id, any_value(t_dec) AS t_dec, any_value(admittime) AS a FROM cohort GROUP BY hadm_id), h AS (SELECT (epoch_us(t_dec) - epoch_us(a)) / 3.6e9 AS h FROM c)
      SELECT CASE WHEN h IS NULL THEN 'none' WHEN h <= 6 THEN 'to 6' WHEN h <= 24 THEN 'to 24' ELSE 'later' END AS bin, count(*) AS n FROM h GROUP BY 1""",
}

QUERIES: list[Query] = [
    visit_items, visits_with_enough, index_visit_cut, consecutive_visit_pairs, latest_visible_lab, late_results, chart_latest_by_item, history_features, prior_admission_records,
    split_balance, eval_targets, copy_last_floor, plausible_readings, infusion_rate_events, group_folds, payloads, hours_since_admission,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
