"""Text helpers: lenient numbers, code clean-up, field splitting, matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_number(col: Column) -> Column:
    """Double, or NULL where the text is no number."""
    return col.try_cast("double")


def _first_numeral(col: Column) -> Column:
    found = F.regexp_extract(col, r"(-?(?:\d[\d,]*\.?\d*|\.\d+))", 1)
    return F.regexp_replace(found, ",", "")


def first_number(col: Column) -> Column:
    """First number inside a text, grouping commas dropped; NULL if none."""
    return _first_numeral(col).try_cast("double")


def first_integer(col: Column) -> Column:
    """Whole part of :func:`first_number` with full 64-bit precision."""
    return F.substring_index(_first_numeral(col), ".", 1).try_cast("bigint")


def remove_first(col: Column, literal: str) -> Column:
    """Text without the first occurrence of ``literal``."""
    at = F.instr(col, literal)
    cut = F.concat(
        F.substring(col, F.lit(1), at - 1),
        F.substring(col, at + len(literal), F.length(col)),
    )
    return F.when(at > 0, cut).otherwise(col)


def first_field(col: Column, sep: str = ".") -> Column:
    """Text before the first ``sep``; the whole text if there is none."""
    return F.substring_index(col, sep, 1)


def matches(col: Column, pattern: str) -> Column:
    return col.rlike(pattern)


def matches_ci(col: Column, pattern: str) -> Column:
    return col.rlike("(?i)" + pattern)


def split_fields(df: DataFrame, source: str, pattern: str, names: Sequence[str],
                 too_many: str = "error") -> DataFrame:
    """Replace ``source`` by columns ``names`` split at regex ``pattern``.

    Short rows are filled with NULL from the right.  A row with more fields
    fails the job, or loses the surplus with ``too_many="drop"``.
    """
    if too_many not in ("error", "drop"):
        raise ValueError("too_many is 'error' or 'drop'")
    fields = F.split(F.col(f"`{source}`"), pattern, -1)
    if too_many == "error":
        fields = F.when(
            F.size(fields) > len(names),
            F.raise_error(F.concat(F.lit(f"more than {len(names)} fields in: "),
                                   F.col(f"`{source}`"))),
        ).otherwise(fields)
    columns = []
    for name in df.columns:
        if name != source:
            columns.append(F.col(f"`{name}`"))
            continue
        columns += [F.get(F.col("__fields"), F.lit(i)).alias(n) for i, n in enumerate(names)]
    return df.withColumn("__fields", fields).select(*columns)
