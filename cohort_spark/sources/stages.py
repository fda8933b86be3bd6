"""Written stages: a small result computed once, read back with its true size.

A stage cuts lineage with a table in the shared folder, so a lost executor
loses nothing, and Catalyst sees the real file size when it decides whether
the result may be broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame

from cohort_spark.session import shared_folder
from cohort_spark.sources.tables import write_table


def stage(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """Write ``df`` to a fresh place in the shared folder and read it back.

    ``compact`` rebalances first, for few rows left over from a scan of very
    many splits, each of which would otherwise write its own small file.
    """
    spark = df.sparkSession
    if compact:
        df = df.hint("rebalance")
    path = f"{shared_folder(spark)}/stages/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_named(df: DataFrame, name: str, roots: Iterable[str], fmt: str = "csv",
               mode: str = "errorifexists") -> list[str]:
    """Write one result under its name to every root (any Hadoop file system)."""
    if not isinstance(df, DataFrame):
        raise TypeError(f"{name} is no DataFrame")
    targets = [f"{root.rstrip('/')}/{name}" for root in roots]
    if len(targets) > 1:
        df = stage(df, name)  # computed once, however many places it goes to
    for target in targets:
        if fmt == "csv":
            write_table(df, target, mode=mode)
        else:
            df.write.mode(mode).format(fmt).save(target)
    return targets
