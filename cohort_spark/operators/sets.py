"""Row binding and key sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def bind_rows(*frames: DataFrame) -> DataFrame:
    """Union all by column name; a column a frame lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def key_union(key: str, *frames: DataFrame) -> DataFrame:
    """Distinct keys that occur in any of the frames."""
    return reduce(DataFrame.union, [f.select(key) for f in frames]).distinct()
