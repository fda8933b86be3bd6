"""Gapless ranks within groups of any size.

A window per group would put a whole group into one task.  Rows are dealt to
buckets of a hash instead: buckets are counted (with partial counts on the map
side), a running sum over a group's buckets gives each its first rank, and a
window ranks within one bucket.  The rank is exact and equal in every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.llm.tables import mixed, spare


def ranked(df: DataFrame, groups: list[str], by: list[str], name: str = "slot",
           buckets: int = 1024) -> DataFrame:
    """``df`` with a rank from 0 in each group, in the order of a hash of ``by``.

    A missing group value is a group of its own.  Rows that agree in ``by`` take
    neighbouring ranks in any order, which leaves the result the same if they
    agree in the other columns too.
    """
    # keys without nulls, so that count, window and join share one partitioning
    p, kinds = spare(df), dict(df.dtypes)
    keys, mix, bucket, turn, first = [f"{p}g{i}" for i in range(len(groups))], f"{p}mix", f"{p}bucket", f"{p}turn", f"{p}first"
    held = df
    for key, g in zip(keys, groups):
        zero = F.lit("") if kinds[g] == "string" else F.lit(0).cast(kinds[g])
        held = held.withColumn(key, F.coalesce(F.col(g), zero)).withColumn(f"{key}n", F.col(g).isNull())
    keys += [f"{key}n" for key in keys]
    held = held.withColumn(mix, mixed(*by)).withColumn(bucket, F.shiftrightunsigned(mix, 40) % buckets)
    counts = held.groupBy(*keys, bucket).agg(F.count("*").alias(first))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, bucket, F.coalesce(F.sum(first).over(before), F.lit(0)).alias(first))
    within = Window.partitionBy(*keys, bucket).orderBy(mix, *by)
    return (held.withColumn(turn, F.row_number().over(within) - 1)
            .join(starts, [*keys, bucket])
            .withColumn(name, (F.col(first) + F.col(turn)).cast("long"))
            .drop(*keys, mix, bucket, turn, first))
