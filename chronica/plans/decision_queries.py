"""Registered queries of what was ordered, given and known at a decision, and of the records built from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronica.functions.ids import number_of
from chronica.operators import decisions as D
from chronica.operators import records as R
from chronica.operators import report, temporal
from chronica.plans.record_queries import _N
from chronica.session import table

Query = Callable[[SparkSession, str], DataFrame]
LADDER = [10.0, 20.0, 40.0, 60.0, 80.0, 100.0, 120.0, 140.0, 160.0, 200.0]


def _admissions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per admission, whatever its repeats say: the least of each column."""
    c = table(spark, folder, "cohort").where("hadm_id is not null")
    return c.groupBy("hadm_id").agg(
        F.min(number_of(F.col("subject_id"))).alias("s"), F.min("t_dec").alias("t_dec"), F.min("admittime").alias("admittime"), F.min("dose_mg").alias("dose_mg"),
        F.min("first_careunit").alias("first_careunit"), F.min("service_at_t_dec").alias("service_at_t_dec"),
    )


def _doses(spark: SparkSession, folder: str) -> DataFrame:
    """One row per dose record, the greatest of its repeats."""
    d = table(spark, folder, "dose_records").where("dose_id is not null")
    one = d.select("dose_id", F.struct("t0", "subject_id", "split", "state", F.col("label.dose_mg").alias("dose_mg")).alias("r"))
    return one.groupBy("dose_id").agg(F.max("r").alias("r")).select("dose_id", "r.*")


def given_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that say something was given, and those that say it was not, by source."""
    d = table(spark, folder, "documents").where("text is not null")
    return d.groupBy("source").agg(F.count_if(D.given(F.col("text"), "given")).alias("given"), F.count(F.lit(1)).alias("n"))


def event_streams(spark: SparkSession, folder: str) -> DataFrame:
    """History events by named stream; an event may be in several."""
    h = table(spark, folder, "history_events")
    named = {
        "bolus": (F.col("kind") == "bolus") & (F.col("dose_mg") > 0), "infusion": F.col("kind") == "infusion", "oral": F.col("kind") == "oral",
        "large": F.col("dose_mg") >= 80,
    }
    return D.streams(h, named).groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hadm_id").alias("admissions"))


def matching_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The latest history event of the 24 hours before each decision whose dose is the decision's."""
    a = _admissions(spark, folder)
    h = table(spark, folder, "history_events").where("hours_before_t_dec is not null and not isnan(hours_before_t_dec)")
    back = F.make_dt_interval(secs=F.round(F.col("hours_before_t_dec") * 3600, 0).cast("decimal(18,6)"))
    rows = h.join(a.select("hadm_id", "t_dec"), "hadm_id").select("hadm_id", (F.col("t_dec") - back).alias("given_at"), F.col("dose_mg").alias("order_mg"), "hist_id")
    out = D.matching_latest(a, rows, "hadm_id", "t_dec", "given_at", "dose_mg", "order_mg", "hist_id", 24, 1e-3)
    return out.select("hadm_id", "hist_id", F.round("gap_hours", 3).alias("gap_hours"))


def place_of_care(spark: SparkSession, folder: str) -> DataFrame:
    """Where each history event's admission was treated, from the first of three tables that says so."""
    h = table(spark, folder, "history_events").select("hadm_id").where("hadm_id is not null").distinct()
    a = _admissions(spark, folder)
    drugs = table(spark, folder, "visits").where("hadm_id is not null").select("hadm_id", F.explode("drugs").alias("v")).groupBy("hadm_id").agg(F.min(F.trim("v")).alias("v"))
    lookups = [("service", a.select("hadm_id", F.col("service_at_t_dec").alias("v"))), ("unit", a.select("hadm_id", F.col("first_careunit").alias("v"))), ("drug", drugs)]
    return D.first_filled(h, "hadm_id", lookups, "v", "place")


def baseline_before_admission(spark: SparkSession, folder: str) -> DataFrame:
    """The last creatinine from before the day of admission, at most a year old."""
    labs = table(spark, folder, "labevents").where("itemid = '510101' and valuenum > 0").select(number_of(F.col("subject_id")).alias("s"), "charttime", "valuenum", "labevent_id")
    out = D.latest_before_day(_admissions(spark, folder).select("hadm_id", "s", "admittime"), labs, "s", "admittime", "charttime", "valuenum", "labevent_id", 365)
    return out.where("last_value is not null").select("hadm_id", "last_value", "last_time")


def procedure_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """Admissions with a procedure on or before the day of the decision."""
    return D.has_by_day(_admissions(spark, folder), table(spark, folder, "procedureevents"), "hadm_id", "t_dec", "starttime").select("hadm_id")


def stages(spark: SparkSession, folder: str) -> DataFrame:
    return _doses(spark, folder).groupBy(D.stage(F.col("state.egfr")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def dose_bands(spark: SparkSession, folder: str) -> DataFrame:
    a = _admissions(spark, folder)
    one, two = D.dose_band(F.col("dose_mg"), D.BANDS_1, D.LAST_1), D.dose_band(F.col("dose_mg"), D.BANDS_2, D.LAST_2)
    return a.groupBy(one.alias("band_1"), two.alias("band_2")).agg(F.count(F.lit(1)).alias("n"))


def net_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Line quantities summed with returned ones as inflow."""
    net = F.sum(D.signed(F.col("l_quantity"), F.col("l_returnflag") == "R"))
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.round(net, 4).alias("net"))


def urine_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Urine per kilogram and hour of the day before."""
    s = F.col("state")
    rate = D.rate_per_weight(s["urine_prior24h_ml"], s["weight_kg"], F.lit(30.0), 24.0)
    return _doses(spark, folder).select("dose_id", F.round(rate, 6).alias("rate")).where("rate is not null")


def status_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The status stated in chart values, by item."""
    c = table(spark, folder, "chartevents").where("itemid = '310901'")
    return c.groupBy(D.code_status(F.col("value")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def daily_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type and day, and the change since the day before that has any."""
    by = table(spark, folder, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return D.step_difference(by, ["event_type"], "day", "n")


def dose_grid(spark: SparkSession, folder: str) -> DataFrame:
    return D.dose_grid(table(spark, folder, "cohort"), "dose_mg", LADDER, [30.0, 50.0, 70.0], 10.0, 200.0, 25)


def low_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of at least a week in which a subject's creatinine stayed above 1.2."""
    labs = table(spark, folder, "labevents").where("itemid = '510101' and valuenum is not null and charttime is not null")
    rows = labs.select(number_of(F.col("subject_id")).alias("s"), "charttime", "labevent_id", "valuenum")
    return temporal.low_islands(rows, ["s"], "charttime", "labevent_id", F.col("valuenum") > 1.2, 24 * 7)


def built_records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as episodes of customers: each with its earlier ones, up to its first shipment."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    l = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_returnflag")
    events = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    out = R.build_records(events, "o_custkey", "l_orderkey", "l_shipdate", "l_quantity", "l_linenumber", ["l_returnflag"])
    p = F.col("prior")
    add = lambda f: F.aggregate(p, F.lit(0.0), lambda a, x: a + f(x).cast("double"))
    return out.select(
        "record_id", "t0", "dose", F.size(p).cast("bigint").alias("n_prior"), F.round(add(lambda x: x.total), 4).alias("total"), add(lambda x: x.n_doses).alias("n_doses"),
        add(lambda x: x.truncated_at_t0.cast("int")).alias("truncated"), F.get(p, F.lit(0)).days_before.alias("farthest"), F.get(p, F.size(p) - 1).days_before.alias("nearest"),
    )


def recent_profile_concepts(spark: SparkSession, folder: str) -> DataFrame:
    out = R.recent_concepts(table(spark, folder, "profiles"), 2)
    return out.select("dose_id", F.array_join("concepts", "|").alias("concepts"))


def similar_records(spark: SparkSession, folder: str) -> DataFrame:
    """The five training records most like each other record whose subject is divisible by 20, one per subject."""
    d = _doses(spark, folder).join(R.recent_concepts(table(spark, folder, "profiles"), 2), "dose_id")
    rows = d.select("dose_id", "subject_id", "split", "concepts", F.col("state.sex").alias("sex"), F.col("state.age").alias("age"), F.col("state.egfr").alias("egfr"))
    out = R.similar_records(rows.where("split <> 'train' and subject_id % 20 = 0"), rows.where("split = 'train'"), "dose_id", "subject_id", "concepts", "sex", ["age", "egfr"], 5)
    return out.withColumn("similarity", F.round("similarity", 6))


def concepts_of_state(spark: SparkSession, folder: str) -> DataFrame:
    flags = {"heart failure": R.is_set(F.col("state.has_chf")), "diabetes": R.is_set(F.col("state.has_diabetes")), "kidney disease": F.coalesce(F.col("state.egfr") < 60, F.lit(False))}
    names = R.state_concepts(flags, ["loop diuretics"])
    return _doses(spark, folder).groupBy(F.array_join(names, "|").alias("concepts")).agg(F.count(F.lit(1)).alias("n"))


def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Label, group and features of the training records."""
    s = F.col("state")
    kinds = {"age": "double", "egfr": "double", "predose_sbp": "double", "sex": "string"}
    features = [R.clean_value(s[c], k).alias(c) for c, k in kinds.items()]
    return R.dataset(_doses(spark, folder), "train", features, F.col("dose_mg"), F.col("subject_id"), "dose_id")


def feature_scales(spark: SparkSession, folder: str) -> DataFrame:
    d = _doses(spark, folder).where("split = 'train'").select(F.col("state.age").alias("age"), F.col("state.egfr").alias("egfr"))
    return R.scales(d, ["age", "egfr"]).select(F.round("scale_age", 6).alias("scale_age"), F.round("scale_egfr", 6).alias("scale_egfr"))


def any_flag(spark: SparkSession, folder: str) -> DataFrame:
    """Records with any of two flags, by split."""
    flag = report.any_true([F.col("state.has_chf"), F.col("state.has_diabetes")])
    return _doses(spark, folder).groupBy(F.coalesce(F.nullif(F.trim("split"), F.lit("")), F.lit("none")).alias("split")).agg(F.count_if(flag).alias("flagged"), F.count(F.lit(1)).alias("n"))


def nearest_rank_values(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest-rank percentiles of the quantities of each order."""
    by = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return by.select("l_orderkey", *[report.nearest_rank(F.col("q"), p).alias(f"p{round(p * 100)}") for p in (0.5, 0.9)])


_A = f"""a AS (SELECT hadm_id, min({_N}) AS s, min(t_dec) AS t_dec, min(admittime) AS admittime, min(dose_mg) AS dose_mg,
  min(first_careunit) AS first_careunit, min(service_at_t_dec) AS service_at_t_dec FROM cohort WHERE hadm_id IS NOT NULL GROUP BY hadm_id)"""
_D = """d AS (SELECT dose_id, any_value(t0) AS t0, any_value(subject_id) AS subject_id, any_value(split) AS split, any_value(state) AS state, any_value(label.dose_mg) AS dose_mg
  FROM dose_records WHERE dose_id IS NOT NULL GROUP BY dose_id)"""
_GRID = {
    "all": "true", "multiple_of_step": "ten", "not_multiple_of_step": "NOT ten", "half_step": "five AND NOT ten", "other_integer": "one AND NOT ten AND NOT five", "non_integer": "NOT one",
    "watched": "w30 OR w50 OR w70", "on_ladder": "lad", "multiple_off_ladder": "ten AND NOT lad", "below_step": "v < 9.999", "above_grid": "v > 200.001",
    **{f"watched_{x}": f"w{x}" for x in (30, 50, 70)}, **{f"grid_{x}": f"abs(v - {x}) < 0.001" for x in range(10, 201, 10)},
}
_RECENT = """v AS (SELECT dose_id, unnest(visits) AS v FROM (SELECT DISTINCT dose_id, visits FROM profiles WHERE dose_id IS NOT NULL)),
  n AS (SELECT dose_id, v.number AS k, list_concat(list_concat(coalesce(v.conditions, []), coalesce(v.procedures, [])), coalesce(v.drugs, [])) AS c FROM v),
  r AS (SELECT dose_id, c FROM n WHERE len(c) > 0 QUALIFY row_number() OVER (PARTITION BY dose_id ORDER BY k DESC) <= 2),
  p AS (SELECT dose_id, list_sort(list_distinct(flatten(list(c)))) AS concepts FROM r GROUP BY dose_id)"""

SQL = {
    "given_texts": "SELECT source, count(*) FILTER (regexp_matches(text, '(?i)given') AND NOT regexp_matches(text, '(?i)\\bnot\\b')) AS given, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY source",
    "event_streams": " UNION ALL ".join(
        f"SELECT '{n}' AS stream, count(*) AS n, count(DISTINCT hadm_id) AS admissions FROM history_events WHERE {c}"
        for n, c in (("bolus", "kind = 'bolus' AND dose_mg > 0"), ("infusion", "kind = 'infusion'"), ("oral", "kind = 'oral'"), ("large", "dose_mg >= 80"))
    ),
    "matching_orders": f"""WITH {_A} SELECT hadm_id, hist_id, round(gap, 3) AS gap_hours FROM (
      SELECT a.hadm_id, h.hist_id, round(h.hours_before_t_dec * 3600) / 3600 AS gap FROM a JOIN history_events h USING (hadm_id)
      WHERE a.t_dec IS NOT NULL AND abs(h.dose_mg - a.dose_mg) < 0.001 AND round(h.hours_before_t_dec * 3600) > 0 AND round(h.hours_before_t_dec * 3600) <= 86400)
      QUALIFY row_number() OVER (PARTITION BY hadm_id ORDER BY gap, hist_id DESC) = 1""",
    "place_of_care": f"""WITH {_A}, h AS (SELECT DISTINCT hadm_id FROM history_events WHERE hadm_id IS NOT NULL),
      g AS (SELECT hadm_id, nullif(min(trim(v)), '') AS v FROM (SELECT hadm_id, unnest(drugs) AS v FROM visits WHERE hadm_id IS NOT NULL) GROUP BY hadm_id)
      SELECT hadm_id, coalesce(nullif(trim(service_at_t_dec), ''), nullif(trim(first_careunit), ''), g.v, '') AS place,
        CASE WHEN nullif(trim(service_at_t_dec), '') IS NOT NULL THEN 'service' WHEN nullif(trim(first_careunit), '') IS NOT NULL THEN 'unit' WHEN g.v IS NOT NULL THEN 'drug' ELSE 'none' END AS place_source
      FROM h LEFT JOIN a USING (hadm_id) LEFT JOIN g USING (hadm_id)""",
    "baseline_before_admission": f"""WITH {_A}, l AS (SELECT {_N} AS s, charttime, valuenum, labevent_id FROM labevents WHERE itemid = '510101' AND valuenum > 0 AND charttime IS NOT NULL)
      SELECT hadm_id, arg_max(valuenum, {{'t': charttime, 'i': labevent_id}}) AS last_value, max(charttime) AS last_time FROM a JOIN l USING (s)
      WHERE charttime < date_trunc('day', admittime) AND charttime >= date_trunc('day', admittime) - INTERVAL 365 DAY GROUP BY hadm_id""",
    "procedure_by_day": f"WITH {_A} SELECT hadm_id FROM a WHERE EXISTS (SELECT 1 FROM procedureevents p WHERE p.hadm_id = a.hadm_id AND p.starttime::DATE <= a.t_dec::DATE)",
    "stages": f"""WITH {_D} SELECT CASE WHEN state.egfr >= 90 THEN 'G1' WHEN state.egfr >= 60 THEN 'G2' WHEN state.egfr >= 45 THEN 'G3a' WHEN state.egfr >= 30 THEN 'G3b'
      WHEN state.egfr >= 15 THEN 'G4' WHEN state.egfr >= 0 THEN 'G5' ELSE 'missing' END AS stage, count(*) AS n FROM d GROUP BY 1""",
    "dose_bands": f"""WITH {_A} SELECT CASE WHEN dose_mg IS NULL THEN NULL WHEN dose_mg <= 20.001 THEN 'le20' WHEN dose_mg <= 40.001 THEN '40' ELSE 'ge60' END AS band_1,
      CASE WHEN dose_mg IS NULL THEN NULL WHEN dose_mg <= 20.001 THEN 'le20' WHEN dose_mg <= 60.001 THEN '40_60' ELSE 'ge80' END AS band_2, count(*) AS n FROM a GROUP BY ALL""",
    "net_amounts": "SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END), 4) AS net FROM lineitem GROUP BY 1",
    "urine_rates": f"WITH {_D} SELECT dose_id, round(state.urine_prior24h_ml / state.weight_kg / 24, 6) AS rate FROM d WHERE state.urine_prior24h_ml IS NOT NULL AND state.weight_kg > 0",
    "status_texts": """SELECT CASE WHEN v LIKE '%comfort%' THEN 'cmo' WHEN r AND i THEN 'dnr_dni' WHEN r THEN 'dnr' WHEN i THEN 'dni' WHEN v LIKE '%full%' THEN 'full' ELSE 'unknown' END AS status, count(*) AS n
      FROM (SELECT v, regexp_matches(v, 'dnr|do not resuscitate') AS r, regexp_matches(v, 'dni|do not intubate') AS i FROM (SELECT lower(coalesce(value, '')) AS v FROM chartevents WHERE itemid = '310901')) GROUP BY 1""",
    "daily_differences": """WITH b AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL)
      SELECT event_type, day, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS difference FROM b""",
    "dose_grid": f"""WITH x AS (SELECT dose_mg AS v, abs(dose_mg - round_even(dose_mg / 10, 0) * 10) < 0.001 AS ten, abs(dose_mg - round_even(dose_mg / 5, 0) * 5) < 0.001 AS five, abs(dose_mg - round_even(dose_mg, 0)) < 0.001 AS one,
        {', '.join(f'abs(dose_mg - {w}) < 0.001 AS w{w}' for w in (30, 50, 70))}, {' OR '.join(f'abs(dose_mg - {r}) < 0.001' for r in LADDER)} AS lad FROM cohort WHERE dose_mg IS NOT NULL),
      c AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, count(*) FILTER ({e}) AS n FROM x" for m, e in _GRID.items())}
        UNION ALL (SELECT 'top_' || printf('%.3f', round(v, 3)), count(*) FROM x GROUP BY round(v, 3) ORDER BY count(*) DESC, round(v, 3) LIMIT 25))
      SELECT metric, n, round(n * 100.0::DOUBLE / (SELECT count(*) FROM x), 2) AS pct FROM c""",
    "low_spans": f"""WITH m AS (SELECT {_N} AS s, charttime, labevent_id, valuenum > 1.2 AS low FROM labevents WHERE itemid = '510101' AND valuenum IS NOT NULL AND charttime IS NOT NULL),
      r AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY s ORDER BY charttime, labevent_id) AS run FROM m)
      SELECT s, min(charttime) AS from_time, max(charttime) AS to_time, count(*) AS n FROM r WHERE low GROUP BY s, run HAVING max(charttime) - min(charttime) >= INTERVAL 7 DAY""",
    "built_records": """WITH e AS (SELECT o_custkey AS c, l_orderkey AS o, l_shipdate AS t, l_quantity AS d, l_linenumber AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
      f AS (SELECT c, o, min(t) AS t0, arg_min(d, {'t': t, 'i': i, 'd': d}) AS d, count(*) AS n FROM e GROUP BY c, o),
      p AS (SELECT a.c, a.o, b.o AS q, round((epoch_us(a.t0) - epoch_us(b.t0)) / 86400000000.0::DOUBLE, 1) AS days, sum(e.d) AS total, count(*) AS n, count(*) < any_value(b.n) AS cut
        FROM f a JOIN f b ON a.c = b.c AND b.t0 < a.t0 JOIN e ON e.c = b.c AND e.o = b.o AND e.t < a.t0 GROUP BY a.c, a.o, b.o, a.t0, b.t0)
      SELECT f.c || '_' || f.o AS record_id, f.t0, f.d AS dose, count(q) AS n_prior, round(coalesce(sum(total), 0), 4) AS total, coalesce(sum(p.n), 0)::DOUBLE AS n_doses,
        count(*) FILTER (cut)::DOUBLE AS truncated, max(days) AS farthest, min(days) AS nearest FROM f LEFT JOIN p ON p.c = f.c AND p.o = f.o GROUP BY f.c, f.o, f.t0, f.d""",
    "recent_profile_concepts": f"""WITH {_RECENT} SELECT dose_id, coalesce(array_to_string(concepts, '|'), '') AS concepts FROM (SELECT DISTINCT dose_id FROM profiles WHERE dose_id IS NOT NULL) LEFT JOIN p USING (dose_id)""",
    "similar_records": f"""WITH {_D}, {_RECENT}, x AS (SELECT dose_id, subject_id, split, coalesce(concepts, []) AS concepts, state.sex AS sex, state.age AS age, state.egfr AS egfr
        FROM d JOIN (SELECT DISTINCT dose_id FROM profiles) USING (dose_id) LEFT JOIN p USING (dose_id)),
      t AS (SELECT * FROM x WHERE split = 'train'), sc AS (SELECT coalesce(nullif(stddev_pop(age), 0), 1) AS a, coalesce(nullif(stddev_pop(egfr), 0), 1) AS e FROM t),
      y AS (SELECT q.dose_id AS q, t.dose_id AS i, t.subject_id AS subject, len(list_intersect(q.concepts, t.concepts))::DOUBLE / len(list_distinct(list_concat(q.concepts, t.concepts))) AS s,
        round(CASE WHEN q.sex = t.sex THEN 0 ELSE 1 END + coalesce(abs(q.age - t.age) / sc.a, 1) + coalesce(abs(q.egfr - t.egfr) / sc.e, 1), 9) AS dist
        FROM x q JOIN t ON list_has_any(q.concepts, t.concepts) AND q.dose_id <> t.dose_id CROSS JOIN sc WHERE q.split <> 'train' AND q.subject_id % 20 = 0),
      z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY q, subject ORDER BY s DESC, dist, i) = 1)
      SELECT q AS dose_id, i AS neighbour, subject, round(s, 6) AS similarity, row_number() OVER (PARTITION BY q ORDER BY s DESC, dist, i) AS rank FROM z QUALIFY rank <= 5""",
    "concepts_of_state": f"""WITH {_D} SELECT 'loop diuretics' || CASE WHEN state.has_chf THEN '|heart failure' ELSE '' END || CASE WHEN state.has_diabetes THEN '|diabetes' ELSE '' END
      || CASE WHEN state.egfr < 60 THEN '|kidney disease' ELSE '' END AS concepts, count(*) AS n FROM d GROUP BY 1""",
    "training_rows": f"WITH {_D} SELECT dose_id, dose_mg AS y, subject_id AS \"group\", state.age AS age, state.egfr AS egfr, state.predose_sbp AS predose_sbp, state.sex AS sex FROM d WHERE split = 'train' AND dose_mg IS NOT NULL",
    "feature_scales": f"WITH {_D} SELECT round(stddev_pop(state.age), 6) AS scale_age, round(stddev_pop(state.egfr), 6) AS scale_egfr FROM d WHERE split = 'train'",
    "any_flag": f"WITH {_D} SELECT coalesce(nullif(trim(split), ''), 'none') AS split, count(*) FILTER (coalesce(state.has_chf, false) OR coalesce(state.has_diabetes, false)) AS flagged, count(*) AS n FROM d GROUP BY 1",
    "nearest_rank_values": "SELECT l_orderkey, " + ", ".join(f"list_sort(list(l_quantity))[least(count(*) - 1, floor(count(*) * {p})::BIGINT) + 1] AS p{round(p * 100)}" for p in (0.5, 0.9)) + " FROM lineitem GROUP BY 1",
}

QUERIES: list[Query] = [
    given_texts, event_streams, matching_orders, place_of_care, baseline_before_admission, procedure_by_day, stages, dose_bands, net_amounts, urine_rates,
    status_texts, daily_differences, dose_grid, low_spans, built_records, recent_profile_concepts, similar_records, concepts_of_state, training_rows,
    feature_scales, any_flag, nearest_rank_values,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
