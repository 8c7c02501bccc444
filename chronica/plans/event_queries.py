"""Registered queries of the temporal, history and report operators on the events and orders tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronica.functions import scalars as X
from chronica.functions.times import micros
from chronica.operators import history, report, temporal
from chronica.session import table

Query = Callable[[SparkSession, str], DataFrame]
LADDER = [1.0, 5.0, 10.0, 20.0, 25.0, 40.0, 50.0]


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the time they became visible: a few hours after they happened."""
    rows = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return rows.withColumn("seen_at", F.col("ts") + F.make_interval(hours=(F.col("event_id") % 7).cast("int")))


def _anchors(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.first_anchor(_events(spark, folder), "user_id", "ts", "event_id", F.col("event_type") == "purchase")


def first_event_anchor(spark: SparkSession, folder: str) -> DataFrame:
    return _anchors(spark, folder)


def latest_in_window(spark: SparkSession, folder: str) -> DataFrame:
    views = _events(spark, folder).where("event_type = 'view'")
    met = temporal.visible_in_window(_anchors(spark, folder), views, "user_id", "anchor", "ts", "seen_at", 48)
    return met.groupBy("user_id", "anchor").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"), F.count(F.lit(1)).alias("n_views"))


def window_sum_by_anchor(spark: SparkSession, folder: str) -> DataFrame:
    met = temporal.visible_in_window(_anchors(spark, folder), _events(spark, folder), "user_id", "anchor", "ts", "seen_at", 72)
    return met.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"), F.count_distinct("event_type").alias("n_types"))


def leak_by_window(spark: SparkSession, folder: str) -> DataFrame:
    """Of the anchors, how many saw an event within 1, 6 and 24 hours, and how many of those were visible only afterwards."""
    events = _events(spark, folder).where("event_type = 'click'")
    met = _anchors(spark, folder).join(events, "user_id").where("ts < anchor")
    hours = (1, 6, 24)
    near = lambda h: F.col("ts") >= F.col("anchor") - F.make_interval(hours=F.lit(h))
    flags = met.groupBy("user_id").agg(
        *[F.bool_or(near(h)).alias(f"near_{h}") for h in hours], *[F.bool_or(near(h) & (F.col("seen_at") >= F.col("anchor"))).alias(f"late_{h}") for h in hours]
    )
    return flags.agg(*[F.count_if(F.col(f"{p}_{h}")).alias(f"{p}_{h}") for p in ("near", "late") for h in hours])


def exists_theta(spark: SparkSession, folder: str) -> DataFrame:
    clicks = _events(spark, folder).where("event_type = 'click'")
    rows = _events(spark, folder).where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return temporal.exists_within(rows, clicks, "user_id", "ts", "ts", 2, 1).where("exists_within").select("event_id", "user_id")


def absent_theta(spark: SparkSession, folder: str) -> DataFrame:
    errors = _events(spark, folder).where("event_type = 'error'")
    rows = _events(spark, folder).where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return temporal.exists_within(rows, errors, "user_id", "ts", "ts", 0, 24, after_back=True).where("not exists_within").select("event_id", "user_id")


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as intervals of some days; every seventh is still open."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    end = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate") + F.make_interval(days=(F.col("o_orderkey") % 30 + 1).cast("int")))
    return o.select(F.col("o_orderkey").alias("span"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("s_from"), end.alias("s_to"))


def _marks(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'")
    return o.select("o_orderkey", F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("at"))


def interval_running(spark: SparkSession, folder: str) -> DataFrame:
    when = temporal.running_at(F.col("s_from"), F.col("s_to"), F.col("at")) & (F.col("span") != F.col("o_orderkey"))
    return temporal.exists_when(_marks(spark, folder), _spans(spark, folder), "cust", when).select("o_orderkey", "cust")


def interval_overlap(spark: SparkSession, folder: str) -> DataFrame:
    when = temporal.overlaps_before(F.col("s_from"), F.col("s_to"), F.col("at"), 24.0 * 30) & (F.col("span") != F.col("o_orderkey"))
    return temporal.absent_when(_marks(spark, folder), _spans(spark, folder), "cust", when).select("o_orderkey", "cust")


def _asof(spark: SparkSession, folder: str, strict: bool, offset: float) -> DataFrame:
    events = _events(spark, folder)
    points = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    rows = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("v_ts"), "value", F.col("event_id").alias("v_id"))
    out = temporal.value_as_of(points, rows, "user_id", "ts", "v_ts", "value", "v_id", strict, offset)
    return out.select("event_id", "as_of_value", F.col("as_of_time").alias("as_of_time"))


def asof_strict(spark: SparkSession, folder: str) -> DataFrame:
    return _asof(spark, folder, True, 0.0)


def asof_inclusive_offset(spark: SparkSession, folder: str) -> DataFrame:
    return _asof(spark, folder, False, 6.0)


def forward_window_sum(spark: SparkSession, folder: str) -> DataFrame:
    out = temporal.sum_after(_events(spark, folder), ["user_id"], "ts", "value", 6, "sum_6h")
    return out.select("event_id", F.round("sum_6h", 4).alias("sum_6h"))


def escalated_24h(spark: SparkSession, folder: str) -> DataFrame:
    buys = _events(spark, folder).where("event_type = 'purchase'")
    return temporal.raised_within(buys, ["user_id"], "ts", "value", 24, "raised").select("event_id", "raised")


def start_anchored_sum(spark: SparkSession, folder: str) -> DataFrame:
    out = temporal.start_anchored_sum(_events(spark, folder), "user_id", "ts", "value", 60 * 24)
    return out.select("user_id", "first_time", F.round("total", 4).alias("total"), "n")


def islands_low(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.low_islands(_events(spark, folder), ["user_id"], "ts", "event_id", F.col("value") < 60, 12)


def prior_summary(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", micros(F.col("o_orderdate")).alias("t"), "o_totalprice", "o_orderpriority")
    out = history.with_prior(o, "o_custkey", "t", {
        "n_prior": F.count(F.lit(1)), "prior_max": F.max("o_totalprice"), "any_urgent": F.bool_or(F.col("o_orderpriority") == "1-URGENT"),
    })
    return out.select("o_orderkey", "n_prior", "prior_max", F.coalesce("any_urgent", F.lit(False)).alias("any_urgent"))


def history_rollup(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem").join(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return l.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("n_orders"), F.min("l_quantity").alias("min_q"), F.max("l_quantity").alias("max_q"),
        F.round(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), 4).alias("returned"),
    )


def prior_nested(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", micros(F.col("o_orderdate")).alias("t"), "o_totalprice")
    out = history.prior_records(o.withColumn("tie", F.col("o_orderkey")), "o_custkey", "t", ["o_totalprice"], 3)
    # The sum does not depend on how equal times are ordered among themselves.
    return out.groupBy("o_custkey").agg(F.sum(F.size("prior")).alias("n_prior_shown"), F.count(F.lit(1)).alias("n_orders"))


def attach_history(spark: SparkSession, folder: str) -> DataFrame:
    """Each urgent order with its customer's earlier line items within 90 days, rolled up."""
    l = table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity")
    own = l.join(table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cust")), "l_orderkey")
    met = _marks(spark, folder).join(own, "cust").where((F.col("l_shipdate") < F.col("at")) & (F.col("l_shipdate") >= F.col("at") - F.make_interval(days=F.lit(90))))
    hours = (micros(F.col("at")) - micros(F.col("l_shipdate"))) / 3.6e9
    return met.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.min(hours), 3).alias("hours_before"))


def active_at_end(spark: SparkSession, folder: str) -> DataFrame:
    """The customer's latest span that was still active when an urgent order came."""
    when = temporal.running_at(F.col("s_from"), F.col("s_to"), F.col("at"))
    met = _marks(spark, folder).join(_spans(spark, folder), "cust").where(when)
    return met.groupBy("o_orderkey").agg(F.max_by("span", F.struct("s_from", "span")).alias("span"))


def latest_wide_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return history.latest_wide(_events(spark, folder), "user_id", "event_type", ["view", "click", "purchase"], "value", ["ts", "event_id"])


def last_per_subject(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return history.latest_per_key(o, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


def funnel(spark: SparkSession, folder: str) -> DataFrame:
    steps = [("all", F.lit(True)), ("returned", F.col("l_returnflag") == "R"), ("large", F.col("l_quantity") >= 25), ("discounted", F.col("l_discount") > 0.05)]
    return report.funnel(table(spark, folder, "lineitem"), "l_orderkey", steps)


def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return report.value_counts(table(spark, folder, "documents"), F.col("lang"), "lang")


def quantiles(spark: SparkSession, folder: str) -> DataFrame:
    out = report.quantiles(table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


def crosstab(spark: SparkSession, folder: str) -> DataFrame:
    return report.crosstab(table(spark, folder, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def coverage(spark: SparkSession, folder: str) -> DataFrame:
    names = spark.createDataFrame([("view",), ("click",), ("purchase",), ("absent",)], "event_type string")
    return report.cover(_events(spark, folder), "user_id", "event_type", names)


def baseline_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of always saying 25 or 10, and of snapping to a ladder."""
    l = table(spark, folder, "lineitem").select("l_quantity", "l_returnflag")
    arms = F.array(
        F.struct(F.lit("always 25").alias("arm"), F.lit(25.0).alias("p")), F.struct(F.lit("always 10").alias("arm"), F.lit(10.0).alias("p")),
        F.struct(F.lit("ladder").alias("arm"), X.snap(F.col("l_quantity"), LADDER).alias("p")),
    )
    out = report.error_metrics(l.select("l_quantity", F.inline(arms)), F.col("l_quantity"), F.col("p"), ["arm"])
    return out.select("arm", "n", *[F.round(c, 6).alias(c) for c in ("mae", "mape", "within_20")])


def group_median_floor(spark: SparkSession, folder: str) -> DataFrame:
    """A median by priority learned on two thirds of the orders, and its error on the rest."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", F.round("o_totalprice", 2).alias("y"))
    train = o.where("o_orderkey % 3 <> 0")
    learned = report.quantiles(train, ["o_orderpriority"], "y", (0.5,)).select("o_orderpriority", F.col("p50").alias("p"))
    test = o.where("o_orderkey % 3 = 0").join(learned, "o_orderpriority", "left")
    return report.error_metrics(test, F.col("y"), F.col("p")).select("n", F.round("mae", 4).alias("mae"))


def best_threshold(spark: SparkSession, folder: str) -> DataFrame:
    out = report.best_threshold(table(spark, folder, "lineitem"), "l_quantity", F.col("l_extendedprice") > 50000)
    return out.select("threshold", F.round("f1", 9).alias("f1"))


def binary_scores(spark: SparkSession, folder: str) -> DataFrame:
    out = report.binary_scores(table(spark, folder, "lineitem"), F.col("l_quantity") >= 30, F.col("l_extendedprice") > 40000)
    return out.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return report.bootstrap_f1(rows, "o_orderkey", F.col("o_totalprice") > 250000, F.col("o_orderpriority") == "1-URGENT", 200)


_E = "SELECT event_id, ts, user_id, event_type, value, ts + (event_id % 7) * INTERVAL 1 HOUR AS seen_at FROM events"
_A = f"""e AS ({_E}), a AS (SELECT user_id, ts AS anchor, event_id AS anchor_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM e WHERE event_type = 'purchase') WHERE rn = 1)"""
_S = """s AS (SELECT o_orderkey AS span, o_custkey AS cust, o_orderdate AS s_from,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + (o_orderkey % 30 + 1) * INTERVAL 1 DAY END AS s_to FROM orders),
m AS (SELECT o_orderkey, o_custkey AS cust, o_orderdate AS at FROM orders WHERE o_orderpriority = '1-URGENT')"""
_ASOF = """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts AS v_ts, value FROM events WHERE event_type = 'view')
SELECT p.event_id, v.value AS as_of_value, v.v_ts AS as_of_time FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND """
_BIN = "SELECT count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn"
_SNAP = "list_min([{" + "}, {".join(f"'a': abs(l_quantity - {r}), 'r': {r}" for r in LADDER) + "}]).r"

SQL = {
    "first_event_anchor": f"WITH {_A} SELECT user_id, anchor, anchor_id FROM a",
    "latest_in_window": f"""WITH {_A} SELECT a.user_id, a.anchor, arg_max(e.value, {{'t': e.ts, 'i': e.event_id}}) AS last_value, count(*) AS n_views
      FROM a JOIN e USING (user_id) WHERE e.event_type = 'view' AND e.seen_at < a.anchor AND e.ts >= a.anchor - INTERVAL 48 HOUR GROUP BY ALL""",
    "window_sum_by_anchor": f"""WITH {_A} SELECT user_id, round(sum(value), 4) AS total, count(DISTINCT event_type) AS n_types
      FROM a JOIN e USING (user_id) WHERE e.seen_at < a.anchor AND e.ts >= a.anchor - INTERVAL 72 HOUR GROUP BY ALL""",
    "leak_by_window": f"""WITH {_A}, f AS (SELECT user_id, {', '.join(f"bool_or(ts >= anchor - INTERVAL {h} HOUR) AS near_{h}, bool_or(ts >= anchor - INTERVAL {h} HOUR AND seen_at >= anchor) AS late_{h}" for h in (1, 6, 24))}
      FROM a JOIN e USING (user_id) WHERE event_type = 'click' AND ts < anchor GROUP BY user_id)
      SELECT {', '.join(f"count(*) FILTER ({p}_{h}) AS {p}_{h}" for p in ('near', 'late') for h in (1, 6, 24))} FROM f""",
    "exists_theta": """SELECT event_id, user_id FROM events p WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.user_id
      AND e.event_type = 'click' AND e.ts >= p.ts - INTERVAL 2 HOUR AND e.ts <= p.ts + INTERVAL 1 HOUR)""",
    "absent_theta": """SELECT event_id, user_id FROM events p WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.user_id
      AND e.event_type = 'error' AND e.ts > p.ts AND e.ts <= p.ts + INTERVAL 24 HOUR)""",
    "interval_running": f"WITH {_S} SELECT o_orderkey, cust FROM m WHERE EXISTS (SELECT 1 FROM s WHERE s.cust = m.cust AND s.span <> m.o_orderkey AND s.s_from <= m.at AND (s.s_to IS NULL OR s.s_to > m.at))",
    "interval_overlap": f"WITH {_S} SELECT o_orderkey, cust FROM m WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.cust = m.cust AND s.span <> m.o_orderkey AND s.s_from < m.at AND coalesce(s.s_to, s.s_from) >= m.at - INTERVAL 720 HOUR)",
    "asof_strict": _ASOF + "p.ts > v.v_ts",
    "asof_inclusive_offset": _ASOF + "p.ts + INTERVAL 6 HOUR >= v.v_ts",
    "forward_window_sum": """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 1 FOLLOWING AND 21600000000 FOLLOWING), 4) AS sum_6h FROM events""",
    "escalated_24h": """SELECT event_id, coalesce(max(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 1 FOLLOWING AND 86400000000 FOLLOWING) > value, false) AS raised
      FROM events WHERE event_type = 'purchase'""",
    "start_anchored_sum": """SELECT user_id, min(f) AS first_time, round(sum(value), 4) AS total, count(*) AS n
      FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS f FROM events) WHERE ts <= f + INTERVAL 1 DAY GROUP BY user_id""",
    "islands_low": """WITH m AS (SELECT user_id, ts, event_id, coalesce(value < 60, false) AS low FROM events),
      r AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m)
      SELECT user_id, min(ts) AS from_time, max(ts) AS to_time, count(*) AS n FROM r WHERE low GROUP BY user_id, run HAVING max(ts) - min(ts) >= INTERVAL 12 HOUR""",
    "prior_summary": """SELECT o_orderkey, count(*) OVER w AS n_prior, max(o_totalprice) OVER w AS prior_max, coalesce(bool_or(o_orderpriority = '1-URGENT') OVER w, false) AS any_urgent
      FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "history_rollup": """SELECT o_custkey, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders, min(l_quantity) AS min_q, max(l_quantity) AS max_q,
      round(sum(l_quantity) FILTER (l_returnflag = 'R'), 4) AS returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey""",
    "prior_nested": """WITH r AS (SELECT o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
      f AS (SELECT *, min(rn) OVER (PARTITION BY o_custkey, o_orderdate) AS f FROM r) SELECT o_custkey, sum(least(3, rn - 1) - least(3, rn - f))::BIGINT AS n_prior_shown, count(*) AS n_orders FROM f GROUP BY 1""",
    "attach_history": f"""WITH {_S} SELECT m.o_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(min((epoch_us(m.at) - epoch_us(l_shipdate)) / 3.6e9), 3) AS hours_before
      FROM m JOIN orders o ON o.o_custkey = m.cust JOIN lineitem ON l_orderkey = o.o_orderkey WHERE l_shipdate < m.at AND l_shipdate >= m.at - INTERVAL 90 DAY GROUP BY m.o_orderkey""",
    "active_at_end": f"""WITH {_S} SELECT m.o_orderkey, arg_max(span, {{'a': s_from, 'b': span}}) AS span FROM m JOIN s USING (cust)
      WHERE s.s_from <= m.at AND (s.s_to IS NULL OR s.s_to > m.at) GROUP BY m.o_orderkey""",
    "latest_wide_pivot": "SELECT user_id, " + ", ".join(f"arg_max(value, {{'t': ts, 'i': event_id}}) FILTER (event_type = '{f}' AND value IS NOT NULL) AS last_{f}" for f in ("view", "click", "purchase")) + " FROM events GROUP BY user_id",
    "last_per_subject": """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "funnel": """WITH s AS (SELECT 0 AS step, 'all' AS label, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_units FROM lineitem
      UNION ALL SELECT 1, 'returned', count(*), count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = 'R'
      UNION ALL SELECT 2, 'large', count(*), count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 25
      UNION ALL SELECT 3, 'discounted', count(*), count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 25 AND l_discount > 0.05)
      SELECT *, coalesce(lag(n_rows) OVER (ORDER BY step) - n_rows, 0) AS dropped FROM s""",
    "value_counts": "SELECT coalesce(lang, 'null') AS lang, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM documents GROUP BY 1",
    "quantiles": "SELECT l_returnflag, count(*) AS n, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) AS p{round(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM lineitem GROUP BY 1",
    "crosstab": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"n_F\", count(*) FILTER (o_orderstatus = 'O') AS \"n_O\", count(*) FILTER (o_orderstatus = 'P') AS \"n_P\" FROM orders GROUP BY 1",
    "coverage": "SELECT f.event_type, count(DISTINCT e.user_id) AS n FROM (VALUES ('view'), ('click'), ('purchase'), ('absent')) f(event_type) LEFT JOIN events e USING (event_type) GROUP BY 1",
    "baseline_metrics": f"""WITH l AS (SELECT l_quantity AS y, 'always 25' AS arm, 25.0::DOUBLE AS p FROM lineitem UNION ALL SELECT l_quantity, 'always 10', 10.0 FROM lineitem UNION ALL SELECT l_quantity, 'ladder', {_SNAP} FROM lineitem)
      SELECT arm, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(avg(abs(y - p) / y) * 100, 6) AS mape, round(avg(CASE WHEN abs(y - p) <= 0.2 * y THEN 1.0 ELSE 0.0 END) * 100, 6) AS within_20 FROM l GROUP BY arm""",
    "group_median_floor": """WITH o AS (SELECT o_orderkey, o_orderpriority, round(o_totalprice, 2) AS y FROM orders), m AS (SELECT o_orderpriority, median(y) AS p FROM o WHERE o_orderkey % 3 <> 0 GROUP BY 1)
      SELECT count(p) AS n, round(avg(abs(y - p)), 4) AS mae FROM o LEFT JOIN m USING (o_orderpriority) WHERE o_orderkey % 3 = 0""",
    "best_threshold": """WITH b AS (SELECT l_quantity AS s, count(*) AS n, count(*) FILTER (l_extendedprice > 50000) AS g FROM lineitem GROUP BY 1),
      c AS (SELECT s, sum(n) OVER (ORDER BY s DESC) AS cn, sum(g) OVER (ORDER BY s DESC) AS cg, sum(g) OVER () AS ag FROM b)
      SELECT s AS threshold, round(2.0 * cg / (cn + ag), 9)::DOUBLE AS f1 FROM c ORDER BY 2.0::DOUBLE * cg / (cn + ag) DESC, s LIMIT 1""",
    "binary_scores": f"""WITH x AS ({_BIN} FROM (SELECT l_quantity >= 30 AS p, l_extendedprice > 40000 AS g FROM lineitem))
      SELECT tp, fp, fn, round(tp::DOUBLE / (tp + fp), 9) AS precision, round(tp::DOUBLE / (tp + fn), 9) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 9) AS f1 FROM x""",
}

QUERIES: list[Query] = [
    first_event_anchor, latest_in_window, window_sum_by_anchor, leak_by_window, exists_theta, absent_theta, interval_running, interval_overlap,
    asof_strict, asof_inclusive_offset, forward_window_sum, escalated_24h, start_anchored_sum, islands_low, prior_summary, history_rollup, prior_nested,
    attach_history, active_at_end, latest_wide_pivot, last_per_subject, funnel, value_counts, quantiles, crosstab, coverage, baseline_metrics,
    group_median_floor, best_threshold, binary_scores, bootstrap_ci,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
