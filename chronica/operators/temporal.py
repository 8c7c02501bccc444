"""Point-in-time operators: windows before and after an anchor, as-of lookups, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronica.functions.times import HOUR, micros
from chronica.operators.shards import HotGroups, running_max, running_sums


def first_anchor(events: DataFrame, key: str, time: str, tie: str, when: Column, name: str = "anchor") -> DataFrame:
    """The first event of each key for which ``when`` holds: (key, ``name``, ``name``_id). Null times never anchor."""
    rows = events.where(when & F.col(time).isNotNull())
    first = rows.groupBy(key).agg(F.min(F.struct(F.col(time).alias("t"), F.col(tie).alias("i"))).alias("m"))
    return first.select(key, F.col("m.t").alias(name), F.col("m.i").alias(f"{name}_id"))


def visible_in_window(
    anchors: DataFrame, events: DataFrame, key: str, anchor: str, time: str, visible: str, hours: float | None
) -> DataFrame:
    """Events of the same key that were visible before the anchor and happened at most ``hours`` before it.

    There is no upper bound on the event's own time: visibility bounds it. ``hours`` None drops the
    lower bound. Null times match nothing. Columns of ``events`` must not clash with those of ``anchors`` but for the key.
    """
    met = F.col(visible) < F.col(anchor)
    if hours is not None:
        met = met & (F.col(time) >= F.col(anchor) - F.make_interval(hours=F.lit(0), mins=F.lit(0), secs=F.lit(hours * 3600)))
    return anchors.join(events, key).where(met)


def exists_when(rows: DataFrame, events: DataFrame, key: str, when: Column) -> DataFrame:
    """Rows for which an event of the same key meets ``when``: a semi join with any condition (null counts as no)."""
    right = events.withColumnRenamed(key, f"e_{key}")
    return rows.join(right, (F.col(key) == F.col(f"e_{key}")) & when, "left_semi")


def absent_when(rows: DataFrame, events: DataFrame, key: str, when: Column) -> DataFrame:
    """Rows for which no event of the same key meets ``when``."""
    right = events.withColumnRenamed(key, f"e_{key}")
    return rows.join(right, (F.col(key) == F.col(f"e_{key}")) & when, "left_anti")


def running_at(start: Column, end: Column, at: Column) -> Column:
    """Whether an interval covers a time: started at or before it and still open, or ending after it."""
    return (start <= at) & (end.isNull() | (end > at))


def overlaps_before(start: Column, end: Column, at: Column, hours: float) -> Column:
    """Whether an interval overlaps the ``hours`` before a time."""
    return (start < at) & (F.coalesce(end, start) >= at - F.make_interval(secs=F.lit(hours * 3600)))


def value_as_of(
    points: DataFrame, rows: DataFrame, key: str, point_time: str, row_time: str, value: str, tie: str,
    strict: bool = False, offset_hours: float = 0.0, shard_hours: float = 1 / 60, most_rows: int = 500_000,
) -> DataFrame:
    """Each point with the last non-null ``value`` of its key at or before the point's time plus an offset.

    Gives the columns of ``points`` with as_of_value and as_of_time. ``strict`` asks for before. Of
    equal times the greatest ``tie`` counts. Points with a null time get nulls. Points and rows are
    merged in one order by key and time: one exchange and one sort; keys of more than
    ``most_rows`` are cut into time shards with a carry-in.
    """
    shift = int(offset_hours * HOUR)
    known = rows.where(F.col(value).isNotNull() & F.col(row_time).isNotNull()).select(
        F.col(key).alias("k"), micros(F.col(row_time)).alias("t"), F.lit(1).alias("side"),
        F.struct(micros(F.col(row_time)).alias("t"), F.col(tie).alias("i"), F.col(value).alias("v"), F.col(row_time).alias("at")).alias("seen"),
    )
    asked = points.select(
        F.col(key).alias("k"), (micros(F.col(point_time)) + shift).alias("t"), F.lit(0 if strict else 2).alias("side"), F.struct(*points.columns).alias("p")
    )
    both = asked.unionByName(known, allowMissingColumns=True)
    shard = F.floor(F.col("t") / int(shard_hours * HOUR))
    merged = running_max(both, ["k"], [F.col("t"), F.col("side")], "seen", "last", shard, most_rows).where("p is not null")
    last = F.when(F.col("t").isNotNull(), F.col("last"))
    return merged.select("p.*", last.v.alias("as_of_value"), last.at.alias("as_of_time"))


def exists_within(
    rows: DataFrame, events: DataFrame, key: str, at: str, time: str, back_hours: float, ahead_hours: float, after_back: bool = False, most_rows: int = 500_000
) -> DataFrame:
    """``rows`` with exists_within: whether an event of their key lies from ``back_hours`` before ``at`` to ``ahead_hours`` after it.

    Both ends count; with ``after_back`` the earlier one doesn't. Only the last event up to the later end is looked at, so
    it is one merge by key and time, whatever the number of events of a key. Null times lie nowhere.
    """
    marks = events.select(key, F.col(time).alias("w_time"), F.lit(1).alias("w_one"))
    out = value_as_of(rows, marks, key, at, "w_time", "w_one", "w_one", False, ahead_hours, most_rows=most_rows)
    low = micros(F.col(at)) - int(back_hours * HOUR)
    last = micros(F.col("as_of_time"))
    return out.select(*rows.columns, F.coalesce(last > low if after_back else last >= low, F.lit(False)).alias("exists_within"))


def join_within(left: DataFrame, right: DataFrame, key: str, at: str, time: str, back_hours: float) -> DataFrame:
    """Left and right rows of a key with ``time`` in [at - back_hours, at), joined on the key and cells of time.

    A left row stands in the two or so cells that its window touches, a right row in one, so a key with very many rows is
    joined piece by piece. The columns of the two must not clash but for the key.
    """
    width = int(back_hours * HOUR)
    cells = F.sequence(F.floor((micros(F.col(at)) - width) / width), F.floor((micros(F.col(at)) - 1) / width))
    marked = left.where(F.col(at).isNotNull()).withColumn("j_cell", F.explode(cells))
    met = marked.join(right.withColumn("j_cell", F.floor(micros(F.col(time)) / width)), [key, "j_cell"])
    return met.where((F.col(time) < F.col(at)) & (micros(F.col(time)) >= micros(F.col(at)) - width)).drop("j_cell")


def _forward(rows: DataFrame, keys: list[str], time: str, hours: float, agg: Column, name: str, most_rows: int) -> DataFrame:
    """``rows`` with an aggregate over the rows of their group in (time, time + hours].

    Groups of more than ``most_rows`` are cut into pieces of eight such spans; the rows from the first span of a piece also stand in the piece before, to
    be looked at from there.
    """
    span = int(hours * HOUR)
    hot = HotGroups(rows, keys, most_rows)
    at = micros(F.col(time))
    if not hot.any:
        return rows.withColumn(name, agg.over(Window.partitionBy(*keys).orderBy(at).rangeBetween(1, span)))
    piece = F.floor(at / (8 * span))
    copies = F.when(at - piece * (8 * span) <= span, F.array(F.struct(piece.alias("p"), F.lit(True).alias("own")), F.struct((piece - 1).alias("p"), F.lit(False).alias("own"))))
    alone = F.array(F.struct(piece.alias("p"), F.lit(True).alias("own")))
    spread = rows.select("*", F.explode(F.coalesce(copies, alone)).alias("f_at")).select(*rows.columns, F.col("f_at.p").alias("f_piece"), F.col("f_at.own").alias("f_own"))
    seen = spread.withColumn(name, agg.over(Window.partitionBy(*keys, "f_piece").orderBy(at).rangeBetween(1, span)))
    return seen.where("f_own").drop("f_piece", "f_own")


def sum_after(rows: DataFrame, keys: list[str], time: str, value: str, hours: float, name: str, most_rows: int = 500_000) -> DataFrame:
    """``rows`` with the sum of ``value`` in (time, time + hours]; null if no row with a value is there."""
    return _forward(rows, keys, time, hours, F.sum(value), name, most_rows)


def raised_within(rows: DataFrame, keys: list[str], time: str, value: str, hours: float, name: str, most_rows: int = 500_000) -> DataFrame:
    """``rows`` with whether a larger ``value`` follows in (time, time + hours]; an equal one doesn't count."""
    out = _forward(rows, keys, time, hours, F.max(value), "f_later", most_rows)
    return out.withColumn(name, F.coalesce(F.col("f_later") > F.col(value), F.lit(False))).drop("f_later")


def start_anchored_sum(rows: DataFrame, key: str, time: str, value: str, minutes: float) -> DataFrame:
    """For each key its first time, and the sum of ``value`` within ``minutes`` of it. The first times are joined back, so no key is gathered."""
    first = rows.where(F.col(time).isNotNull()).groupBy(F.col(key).alias("a_key")).agg(F.min(time).alias("first_time"))
    near = rows.join(first, F.col(key).eqNullSafe(F.col("a_key"))).where(F.col(time) <= F.col("first_time") + F.make_interval(secs=F.lit(minutes * 60)))
    return near.groupBy(key).agg(F.min("first_time").alias("first_time"), F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def low_islands(rows: DataFrame, keys: list[str], time: str, tie: str, low: Column, least_hours: float, most_rows: int = 500_000) -> DataFrame:
    """Runs of rows for which ``low`` holds without a break, that span at least ``least_hours``: (keys, from_time, to_time, n).

    A run is known by the number of breaks before it, a running sum by shards of time for groups of more than ``most_rows``.
    """
    marked = rows.withColumn("i_low", F.coalesce(low, F.lit(False)))
    breaks = {"i_run": F.when(F.col("i_low"), 0).otherwise(1)}
    marked = running_sums(marked, keys, [F.col(time), F.col(tie)], breaks, micros(F.col(time)), HotGroups(rows, keys, most_rows))
    runs = marked.where("i_low").groupBy(*keys, "i_run").agg(F.min(time).alias("from_time"), F.max(time).alias("to_time"), F.count(F.lit(1)).alias("n"))
    return runs.where(micros(F.col("to_time")) - micros(F.col("from_time")) >= int(least_hours * HOUR)).drop("i_run")
