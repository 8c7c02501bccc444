"""Identifiers that are written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCIENTIFIC = r"^[+-]?[0-9]+(\.[0-9]+)?[eE][+]?[0-9]+$"
DECIMAL_TAIL = r"^([+-]?[0-9]+)\.0*$"


def number_of(text: Column) -> Column:
    """The whole number that an identifier means, or null if it holds none.

    Understood are bare digits, leading zeros, a decimal tail of zeros, scientific notation,
    blanks or commas between digits, surrounding white space and a prefix of letters. A number
    beyond BIGINT gives null.
    """
    plain = text.try_cast("bigint")  # bare digits need none of the patterns
    bare = F.regexp_replace(text, r"[\s\u00a0]", "")
    digits = F.regexp_replace(bare, "[^0-9]", "")
    return (
        F.when(plain >= 0, plain)
        .when(bare.rlike(SCIENTIFIC), bare.try_cast("double").try_cast("decimal(20,0)").try_cast("bigint"))
        .when(bare.rlike(DECIMAL_TAIL), F.regexp_extract(bare, DECIMAL_TAIL, 1).try_cast("bigint"))
        .when(digits != "", digits.try_cast("bigint"))
    )
