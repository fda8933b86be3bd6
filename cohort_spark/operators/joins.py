"""Equi joins in which a missing key matches a missing key.

No join carries a broadcast hint: Catalyst and adaptive execution broadcast a
side only when its measured size is under spark.sql.autoBroadcastJoinThreshold,
and otherwise shuffle, splitting hot keys.  That size is the compressed one, of
which a few megabytes may be hundreds in memory, so joins whose sides both grow
with the input say so (``both_grow``) and are always shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _col(df: DataFrame, name: str):
    return df[f"`{name}`"]


def join_on(left: DataFrame, right: DataFrame, keys: Mapping[str, str], how: str = "inner",
            relationship: str | None = None, suffixes: tuple[str, str] = ("_x", "_y"),
            null_safe: bool = True, both_grow: bool = False) -> DataFrame:
    """Join left columns to differently named right columns; left names stay.

    ``relationship`` may be ``many-to-many`` (nothing is checked),
    ``many-to-one``, ``one-to-many`` or ``one-to-one``; the ``one`` sides are
    checked for repeated keys before the join.  ``both_grow`` says that neither
    side stays small as the input grows, so none is sent through the driver.
    """
    if relationship not in (None, "many-to-many"):
        left_side, _, right_side = relationship.partition("-to-")
        if left_side == "one":
            require_unique(left, list(keys))
        if right_side == "one":
            require_unique(right, list(keys.values()))
    right_keys = {name: f"__key_{i}" for i, name in enumerate(keys.values())}
    renamed = right.select(*[
        _col(right, name).alias(right_keys.get(name, f"__right_{name}")) for name in right.columns
    ])
    condition = None
    for mine, theirs in keys.items():
        a, b = _col(left, mine), renamed[right_keys[theirs]]
        part = a.eqNullSafe(b) if null_safe else a == b
        condition = part if condition is None else condition & part
    others = [name for name in right.columns if name not in right_keys]
    shared = {name for name in others if name in left.columns}
    out = [_col(left, name).alias(name + suffixes[0] if name in shared else name)
           for name in left.columns]
    out += [_col(renamed, f"__right_{name}").alias(name + suffixes[1] if name in shared else name)
            for name in others]
    return left.join(shuffled(renamed) if both_grow else renamed, condition, how).select(*out)


def shuffled(side: DataFrame) -> DataFrame:
    """``side``, never broadcast by the join that it goes into, nor is the other side."""
    return side.hint("merge")


def natural_join(left: DataFrame, right: DataFrame, how: str = "left",
                 on: Sequence[str] | None = None, **options: object) -> DataFrame:
    """Join on all common columns, or on those named; one copy of each key."""
    keys = list(on) if on is not None else [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("the frames have no column in common")
    return join_on(left, right, {k: k for k in keys}, how, **options)


def _match(left: DataFrame, right: DataFrame, key: str, right_key: str | None):
    keys = right.select(_col(right, right_key or key).alias("__key"))
    return keys, _col(left, key).eqNullSafe(keys["__key"])


def semi(df: DataFrame, keys: DataFrame, key: str, right_key: str | None = None) -> DataFrame:
    """Rows whose key occurs in ``keys``; a NULL key counts as a key."""
    keys, condition = _match(df, keys, key, right_key)
    return df.join(keys, condition, "left_semi")


def anti(df: DataFrame, keys: DataFrame, key: str, right_key: str | None = None,
         both_grow: bool = False) -> DataFrame:
    """Rows whose key does not occur in ``keys``."""
    keys, condition = _match(df, keys, key, right_key)
    return df.join(shuffled(keys) if both_grow else keys, condition, "left_anti")


def flag_in(df: DataFrame, keys: DataFrame, key: str, name: str,
            right_key: str | None = None) -> DataFrame:
    """Add a TRUE/FALSE column: does the key occur in ``keys``?  No row changes."""
    marked = (keys.select(_col(keys, right_key or key).alias("__key")).distinct()
              .withColumn("__found", F.lit(True)))
    joined = df.join(marked, _col(df, key).eqNullSafe(marked["__key"]), "left")
    return joined.withColumn(name, F.col("__found").isNotNull()).drop("__key", "__found")


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Fail if a key occurs twice (one aggregate, at most one row returned)."""
    repeated = (df.groupBy(*[f"`{k}`" for k in keys]).agg(F.count("*").alias("__n"))
                .filter("__n > 1").limit(1).collect())
    if repeated:
        raise ValueError(f"keys {list(keys)} are not unique: {repeated[0].asDict()}")
