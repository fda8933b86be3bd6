"""Exact years between dates and rounding to the even neighbour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_years(start: Column, end: Column) -> Column:
    """Whole anniversaries plus the passed share of the running year."""
    start, end = start.cast("date"), end.cast("date")
    whole = F.floor(F.months_between(end, start) / 12).cast("int")
    last = F.add_months(start, whole * 12)
    following = F.add_months(start, (whole + 1) * 12)
    return whole + F.datediff(end, last) / F.datediff(following, last)


def round_half_even(col: Column, digits: int = 0) -> Column:
    return F.bround(col, digits)


def year_of(col: Column) -> Column:
    return F.year(col.cast("date"))
