"""Populations as whole numbers of 1 / 2^20 persons, so that sums are exact and order doesn't matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SCALE, THRESHOLD_PERSONS, NODATA = 1 << 20, 1000, -99999.0
THRESHOLD = THRESHOLD_PERSONS * SCALE


def _scaled(p: Column) -> Column:
    return F.round(p.cast("double") * float(SCALE))


def _wrong(p: Column) -> Column:
    p = p.cast("double")
    return F.isnan(p) | (p < 0) | (_scaled(p) >= 9.223372036854775808e18)


def try_to_fixed(population: Column | str) -> Column:
    """Half away from zero; null for what to_fixed refuses."""
    p = F.col(population) if isinstance(population, str) else population
    return F.when(~_wrong(p), _scaled(p).cast("long"))


def to_fixed(population: Column | str, where: Column | None = None) -> Column:
    """Raises for NaN, infinite, negative or too large populations; `where` is told with the error."""
    p = F.col(population) if isinstance(population, str) else population
    said = F.concat(F.lit("invalid population "), p.cast("string"), *([F.lit(" at "), where] if where is not None else []))
    return F.when(_wrong(p), F.raise_error(said).cast("long")).otherwise(_scaled(p).cast("long"))


def source_to_fixed(population: Column | str, where: Column | None = None) -> Column:
    """As to_fixed, with null for the source's no-data value and for zero."""
    p = F.col(population) if isinstance(population, str) else population
    return F.when(p.isNotNull() & (p != NODATA) & (p != 0), to_fixed(p, where))


def to_persons(fixed: Column | str) -> Column:
    f = F.col(fixed) if isinstance(fixed, str) else fixed
    return f / float(SCALE)
