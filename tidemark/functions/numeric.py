"""Scalar helpers with one meaning everywhere: NaN and infinities are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """The value as a double; null where it is not a finite number."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def is_close(a: Column, b: Column, atol: float, rtol: float = 1e-5) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def year_fraction(date: Column) -> Column:
    return F.year(date) + F.dayofyear(date) / F.lit(365.25)


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole elapsed days between two points in time."""
    return F.timestamp_diff("DAY", start.cast("timestamp_ntz"), end.cast("timestamp_ntz"))


def rounded(value: Column, digits: int = 6) -> Column:
    """Half up on the binary value, written so that other engines give the same digits."""
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + F.lit(0.5)) / scale


def presented(value: Column, digits: int = 2) -> Column:
    """For display: half to even."""
    return F.bround(value, digits)
