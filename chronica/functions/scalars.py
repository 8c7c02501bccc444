"""Scalar expressions: ladders, bins, clinical formulas, text normalisation, set similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-3


def on_ladder(value: Column, ladder: list[float], tolerance: float = TOLERANCE) -> Column:
    """Whether a value is one of a ladder's rungs but for float noise."""
    return reduce(lambda a, b: a | b, [F.abs(value - r) < tolerance for r in ladder])


def is_multiple(value: Column, step: float, tolerance: float = TOLERANCE) -> Column:
    """Whether a value is a multiple of a step but for float noise."""
    return F.abs(value - F.bround(value / step) * step) < tolerance


def snap(value: Column, ladder: list[float]) -> Column:
    """The nearest rung; halfway goes to the lower one."""
    return F.array_min(F.array(*[F.struct(F.abs(value - r).alias("off"), F.lit(float(r)).alias("rung")) for r in ladder])).rung


def right_closed_bin(value: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the bin (a, b] that holds a value; null outside all of them."""
    out = F.when(F.lit(False), F.lit(""))
    for low, high, label in zip(edges, edges[1:], labels):
        out = out.when((value > low) & (value <= high), label)
    return out


def plausible(columns: dict[str, tuple[float, float]]) -> Column:
    """Whether all columns are within their bounds; null is not implausible."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(c).between(lo, hi), F.lit(True)) for c, (lo, hi) in columns.items()])


def filtration_rate(creatinine: Column, age: Column, female: Column) -> Column:
    """Published race-free creatinine equation of 2021; null for a creatinine that is not above 0."""
    kappa = F.when(female, 0.7).otherwise(0.9)
    alpha = F.when(female, -0.241).otherwise(-0.302)
    ratio = creatinine / kappa
    rate = 142 * F.pow(F.least(ratio, F.lit(1.0)), alpha) * F.pow(F.greatest(ratio, F.lit(1.0)), F.lit(-1.2)) * F.pow(F.lit(0.9938), age)
    return F.when(creatinine > 0, F.when(female, rate * 1.012).otherwise(rate))


def number_in(text: Column) -> Column:
    """The number in a text that may have a comparison sign before it, or null."""
    return F.regexp_extract(text, r"[<>]?\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def code(text: Column) -> Column:
    """A code without dots and blanks, in upper case."""
    return F.upper(F.translate(text, ". ", ""))


def normalised(text: Column) -> Column:
    """Lower case, everything but letters and digits as single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def word_count(text: Column) -> Column:
    """Number of words; 0 for a blank text."""
    bare = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " ")))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def hamming(a: Column, b: Column) -> Column:
    """Number of elements in one of two sets only."""
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
