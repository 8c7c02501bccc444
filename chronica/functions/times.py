"""Times as microseconds and as text, independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR


def ntz(value: Column) -> Column:
    """``value`` as TIMESTAMP_NTZ."""
    return value.cast("timestamp_ntz")


def micros(value: Column) -> Column:
    """Microseconds of a wall-clock time since 1970-01-01, without any zone shift."""
    since = ntz(value) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (since.cast("decimal(20,6)") * 1_000_000).cast("bigint")


def second_text(value: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of a wall-clock time; fractions are cut."""
    return F.substring(ntz(value).cast("string"), 1, 19)


def parse_stamp(text: Column) -> Column:
    """A stamp written as a date, or as a date and time with a blank or ``T`` between; else null."""
    return F.trim(text).try_cast("timestamp_ntz")


def is_date_only(text: Column) -> Column:
    """Whether a stamp names a day without a time."""
    return F.length(F.trim(text)) <= 10
