"""Column selection by name prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _quoted(names: list[str]) -> list[str]:
    return [f"`{name}`" for name in names]


def select_prefix(df: DataFrame, *prefixes: str) -> DataFrame:
    """Columns whose name starts with a prefix, case ignored, in prefix order."""
    chosen: list[str] = []
    for prefix in prefixes:
        chosen += [c for c in df.columns
                   if c.lower().startswith(prefix.lower()) and c not in chosen]
    return df.select(*_quoted(chosen))


def drop_prefix(df: DataFrame, *prefixes: str) -> DataFrame:
    lowered = tuple(p.lower() for p in prefixes)
    return df.select(*_quoted([c for c in df.columns if not c.lower().startswith(lowered)]))


def for_person(df: DataFrame, person_id: int, person: str = "person_id") -> DataFrame:
    """All rows of one person; the filter reaches the scan."""
    return df.filter(df[person] == person_id)
