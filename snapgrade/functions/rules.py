"""Threshold rules and scores as ``when`` chains."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

SEPARATOR = "|"

# Cut points and the class letter of each interval, low to high.
# A value on a cut belongs to the higher class.
MASS_CUTS, MASS_CODES = (0.1, 10.0, 100.0, 4000.0), "meNJW"
TEMPERATURE_CUTS, TEMPERATURE_CODES = (200.0, 450.0, 1000.0), "FWGR"
ECCENTRICITY_CUTS, ECCENTRICITY_CODES = (0.1, 0.3, 0.6), "0123"
DENSITY_CUTS, DENSITY_CODES = (1.0, 3.0, 8.0, 15.0), "gwtis"

# First and last plausible year, pass marks, judge scale.
FIRST_YEAR, LAST_YEAR = 1992, 2026
CODE_PASS_MARK, JUDGE_PASS_MARK = 75, 7
JUDGE_LOW, JUDGE_HIGH, JUDGE_FACTOR = 1, 10, 10


def threshold_code(value: Column, cuts: Sequence[float], codes: Sequence[str], missing: str = "?") -> Column:
    """Letter of the interval ``value`` falls in. NaN is below no cut, so it gets the last letter."""
    if len(codes) != len(cuts) + 1:
        raise ValueError("one code more than cuts is needed")
    start = F.when(value.isNull(), F.lit(missing))
    chain = reduce(lambda acc, pair: acc.when(value < F.lit(pair[0]), F.lit(pair[1])), zip(cuts, codes), start)
    return chain.otherwise(F.lit(codes[-1]))


def mass_class(c: Column) -> Column:
    return threshold_code(c, MASS_CUTS, MASS_CODES)


def temperature_class(c: Column) -> Column:
    return threshold_code(c, TEMPERATURE_CUTS, TEMPERATURE_CODES)


def eccentricity_class(c: Column) -> Column:
    return threshold_code(c, ECCENTRICITY_CUTS, ECCENTRICITY_CODES)


def density_class(c: Column) -> Column:
    return threshold_code(c, DENSITY_CUTS, DENSITY_CODES)


def four_letter_code(mass: Column, temperature: Column, eccentricity: Column, density: Column) -> Column:
    return F.concat(
        mass_class(mass),
        temperature_class(temperature),
        eccentricity_class(eccentricity),
        density_class(density),
    )


def quality_label(
    year: Column, mass: Column, radius: Column, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR
) -> Column:
    """Implausible year first, then missing data; the order matters."""
    return (
        F.when((year < first_year) | (year > last_year), F.lit("ANOMALY"))
        .when(year.isNull() | (mass.isNull() & radius.isNull()), F.lit("CANDIDATE"))
        .otherwise(F.lit("CONFIRMED"))
    )


def component_score(expected: Column, actual: Column) -> Column:
    """25 points per position that agrees regardless of case; 0 unless both are 4 long."""
    points = [
        F.when(F.upper(F.substring(expected, i, 1)) == F.upper(F.substring(actual, i, 1)), 25).otherwise(0)
        for i in (1, 2, 3, 4)
    ]
    both_four = (F.length(expected) == 4) & (F.length(actual) == 4)
    return F.when(both_four, points[0] + points[1] + points[2] + points[3]).otherwise(0)


def equality_score(expected: Column, actual: Column) -> Column:
    return F.when(expected.eqNullSafe(actual), 100).otherwise(0)


def pass_fail(score: Column, mark: int) -> Column:
    return F.when(score >= mark, F.lit("PASS")).otherwise(F.lit("FAIL"))


def clamp_score(score: Column) -> Column:
    return F.greatest(F.lit(JUDGE_LOW), F.least(F.lit(JUDGE_HIGH), score))


def scaled_score(score: Column) -> Column:
    return clamp_score(score) * JUDGE_FACTOR


def join_label(label: Column, code: Column) -> Column:
    """``LABEL`` or ``LABEL|CODE``."""
    return F.concat_ws(SEPARATOR, label, code)


def split_label(composite: Column) -> tuple[Column, Column]:
    """(label, code) of a composite; the code is null when there is no separator."""
    parts = F.split(composite, r"\|")
    return F.get(parts, 0), F.get(parts, 1)
