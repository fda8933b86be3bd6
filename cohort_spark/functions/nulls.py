"""Membership and counting where a missing value is a value of its own."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_in(col: Column, values: Iterable) -> Column:
    """TRUE or FALSE, never NULL; NULL is a member only if ``values`` has None."""
    values = list(values)
    known = [v for v in values if v is not None]
    member = F.coalesce(col.isin(known), F.lit(False))
    if len(known) < len(values):
        member = member | col.isNull()
    return member


def not_in(col: Column, values: Iterable) -> Column:
    """Complement of :func:`is_in`: a NULL is kept."""
    return ~is_in(col, values)


def missing_to(col: Column, label: str) -> Column:
    return F.coalesce(col, F.lit(label))


def n_unique(col: Column) -> Column:
    """Distinct count in which NULL counts as one value."""
    return F.count_distinct(col) + F.coalesce(F.max(col.isNull().cast("int")), F.lit(0))
