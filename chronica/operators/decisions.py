"""What was ordered, given, known and measured around the time of a decision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronica.functions.scalars import is_multiple, on_ladder
from chronica.functions.times import DAY, HOUR, micros
from chronica.operators.temporal import value_as_of


def given(text: Column, word: str) -> Column:
    """Whether a text says that something was done: it holds ``word`` and nowhere the whole word ``not``; null is no."""
    return F.coalesce(text.rlike(f"(?i){word}") & ~text.rlike(r"(?i)\bnot\b"), F.lit(False))


def streams(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    """``rows`` once for each named stream whose condition holds, with the column stream; one pass for all of them."""
    marks = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]), lambda x: x.isNotNull())
    return rows.withColumn("stream", F.explode(marks))


def matching_latest(
    targets: DataFrame, rows: DataFrame, key: str, at: str, time: str, wanted: str, measure: str, tie: str, hours: float, tolerance: float
) -> DataFrame:
    """For each target the latest row of its key in [at - hours, at) whose measure equals the wanted one but for ``tolerance``.

    Gives key, at, row_time, tie and gap_hours; targets without such a row are left out, repeated ones come once. ``at`` and
    ``time`` are wall-clock times. Key, measure and time are joined as equal cells (the measure and the day, each with its
    neighbours on the target's side), so a key with very many rows is met only where both are near.
    """
    cell = lambda c: F.floor(c / (10 * tolerance))
    whole = int(hours * HOUR)
    left = targets.select(F.col(key).alias("k"), F.col(at).alias("t_at"), micros(F.col(at)).alias("t"), F.col(wanted).alias("w")).where("k is not null and t is not null and w is not null").distinct()
    left = left.withColumn("m_cell", F.explode(F.array_distinct(F.array(cell(F.col("w") - tolerance), cell(F.col("w") + tolerance)))))
    left = left.withColumn("t_cell", F.explode(F.sequence(F.floor((F.col("t") - whole) / DAY), F.floor(F.col("t") / DAY))))
    right = rows.select(F.col(key).alias("k"), micros(F.col(time)).alias("s"), F.col(time).alias("row_time"), F.col(measure).alias("m"), F.col(tie).alias("i")).where("s is not null and m is not null")
    right = right.withColumns({"m_cell": cell(F.col("m")), "t_cell": F.floor(F.col("s") / DAY)})
    met = left.join(right, ["k", "m_cell", "t_cell"]).where((F.col("s") < F.col("t")) & (F.col("s") >= F.col("t") - whole) & (F.abs(F.col("m") - F.col("w")) < tolerance))
    best = met.groupBy("k", "t_at", "w").agg(F.max(F.struct("s", "i", "row_time", "t")).alias("b"))
    return best.select(F.col("k").alias(key), F.col("t_at").alias(at), F.col("b.row_time").alias("row_time"), F.col("b.i").alias(tie), ((F.col("b.t") - F.col("b.s")) / HOUR).alias("gap_hours"))


def first_filled(rows: DataFrame, key: str, lookups: list[tuple[str, DataFrame]], value: str, name: str = "value") -> DataFrame:
    """``rows`` with the first value that isn't blank of several lookups (label, table of key and ``value``), and whose it is.

    Adds ``name`` and ``name``_source; blank and ``none`` where no lookup has one. A key is expected once
    in each lookup.
    """
    out, values = rows, []
    for i, (_, table) in enumerate(lookups):
        side = table.select(F.col(key).alias(f"f_k{i}"), F.trim(F.col(value)).alias(f"f_v{i}")).where(F.col(f"f_v{i}") != "")
        out = out.join(side, F.col(key) == F.col(f"f_k{i}"), "left")
        values.append(F.col(f"f_v{i}"))
    source = reduce(lambda a, iv: a.when(values[iv[0]].isNotNull(), iv[1][0]), enumerate(lookups), F.when(F.lit(False), F.lit("")))
    return out.select(*rows.columns, F.coalesce(*values, F.lit("")).alias(name), source.otherwise("none").alias(f"{name}_source"))


def latest_before_day(targets: DataFrame, rows: DataFrame, key: str, at: str, time: str, value: str, tie: str, days: int) -> DataFrame:
    """``targets`` with the latest value of their key from before the day of ``at``, at most ``days`` days earlier than it.

    Adds last_value and last_time; both null where there is none. One merge by key and time.
    """
    start = F.date_trunc("day", F.col(at)).cast("timestamp_ntz")
    dated = targets.withColumn("d_start", start)
    out = value_as_of(dated, rows, key, "d_start", time, value, tie, strict=True)
    near = micros(F.col("as_of_time")) >= micros(F.col("d_start")) - days * DAY
    return out.select(*targets.columns, F.when(near, F.col("as_of_value")).alias("last_value"), F.when(near, F.col("as_of_time")).alias("last_time"))


def has_by_day(targets: DataFrame, rows: DataFrame, key: str, at: str, time: str) -> DataFrame:
    """``targets`` whose key has a row on or before the day of ``at``: only the first day of each key is joined."""
    first = rows.where(F.col(time).isNotNull()).groupBy(F.col(key).alias("b_key")).agg(F.min(F.to_date(time)).alias("b_day"))
    return targets.join(first, (F.col(key) == F.col("b_key")) & (F.col("b_day") <= F.to_date(at)), "left_semi")


#: Filtration rates from which a stage starts, the highest first.
STAGES = ((90.0, "G1"), (60.0, "G2"), (45.0, "G3a"), (30.0, "G3b"), (15.0, "G4"), (0.0, "G5"))


def stage(rate: Column) -> Column:
    """The stage of a filtration rate; ``missing`` where there is none."""
    out = F.when(rate.isNull(), "missing")
    for floor, name in STAGES:
        out = out.when(rate >= floor, name)
    return out.otherwise("missing")


def dose_band(dose: Column, edges: list[tuple[float, str]], last: str, tolerance: float = 1e-3) -> Column:
    """The band of a dose: that of the first edge it doesn't exceed but for ``tolerance``, else the last one; null stays null."""
    out = F.when(dose.isNull(), F.lit(None).cast("string"))
    for edge, name in edges:
        out = out.when(dose <= edge + tolerance, name)
    return out.otherwise(last)


#: Upper edges of the dose bands of the two cohort versions.
BANDS_1, LAST_1 = [(20.0, "le20"), (40.0, "40")], "ge60"
BANDS_2, LAST_2 = [(20.0, "le20"), (60.0, "40_60")], "ge80"


def signed(amount: Column, is_inflow: Column) -> Column:
    """An amount with its sign turned where it flows in; null counts as 0."""
    return F.when(F.coalesce(is_inflow, F.lit(False)), -F.coalesce(amount, F.lit(0.0))).otherwise(F.coalesce(amount, F.lit(0.0)))


def rate_per_weight(amount: Column, weight: Column, hours: Column, most_hours: float) -> Column:
    """An amount per unit of weight and hour, over at most ``most_hours``; null where weight or hours aren't above 0."""
    spent = F.least(F.greatest(hours, F.lit(0.0)), F.lit(most_hours))
    return F.when((spent > 0) & (weight > 0) & hours.isNotNull(), amount / weight / spent)


def code_status(text: Column) -> Column:
    """The resuscitation status a text states: cmo, dnr_dni, dnr, dni, full, else unknown."""
    low = F.lower(F.coalesce(text, F.lit("")))
    no_revival, no_tube = low.rlike("dnr|do not resuscitate"), low.rlike("dni|do not intubate")
    return (
        F.when(F.contains(low, F.lit("comfort")), "cmo").when(no_revival & no_tube, "dnr_dni").when(no_revival, "dnr").when(no_tube, "dni")
        .when(F.contains(low, F.lit("full")), "full").otherwise("unknown")
    )


def step_difference(rows: DataFrame, keys: list[str], order: str, value: str, name: str = "difference") -> DataFrame:
    """``rows`` with how much ``value`` changed since the row before it in ``order``; null for the first. For small summaries."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn(name, F.col(value) - before)


def dose_grid(rows: DataFrame, dose: str, ladder: list[float], watched: list[float], step: float, most: float, top: int) -> DataFrame:
    """(metric, n, pct): which doses lie on a grid, on a ladder or on watched values, and the most common ones.

    One pass counts everything but the most common values; those are taken from counts by value rounded to 3 digits, ties by value.
    Null doses take no part.
    """
    v = F.col(dose)
    kept = rows.where(v.isNotNull()).select(dose)
    grid = [step * k for k in range(1, round(most / step) + 1)]
    ten, five, one = is_multiple(v, step), is_multiple(v, step / 2), is_multiple(v, 1.0)
    parts = {
        "all": F.lit(True), "multiple_of_step": ten, "not_multiple_of_step": ~ten, "half_step": five & ~ten, "other_integer": one & ~ten & ~five, "non_integer": ~one,
        "watched": on_ladder(v, watched), "on_ladder": on_ladder(v, ladder), "multiple_off_ladder": ten & ~on_ladder(v, ladder),
        "below_step": v < step - 1e-3, "above_grid": v > most + 1e-3,
        **{f"watched_{x:g}": on_ladder(v, [x]) for x in watched}, **{f"grid_{x:g}": on_ladder(v, [x]) for x in grid},
    }
    once = kept.agg(*[F.count_if(c).alias(n) for n, c in parts.items()])
    every = once.first()["all"]  # one number
    long = once.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("n")) for n in parts])))
    common = kept.groupBy(F.round(dose, 3).alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "v").limit(top)
    tops = common.select(F.concat(F.lit("top_"), F.format_number("v", 3)).alias("metric"), "n")
    return long.unionByName(tops).withColumn("pct", F.round(F.col("n") * 100.0 / every, 2) if every else F.lit(0.0))
