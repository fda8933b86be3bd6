"""Counts, summaries, quantiles and keep-first.

Every one aggregates before it shuffles, so one hot group costs one partial
row per task and never sits in a single task row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.functions.dates import round_half_even
from cohort_spark.operators.ranking import exact_quantiles


def count_by(df: DataFrame, *cols: str, name: str = "n") -> DataFrame:
    return df.groupBy(*[f"`{c}`" for c in cols]).agg(F.count("*").alias(name))


def null_aware(aggregate: Column, col: Column) -> Column:
    """``aggregate``, but NULL if any ``col`` of the group is NULL."""
    return F.when(F.count_if(col.isNull()) == 0, aggregate)


def mean_sd(col: Column, digits: int | None = None,
            propagate_null: bool = False) -> tuple[Column, Column]:
    """Mean and sample standard deviation, rounded to the even neighbour."""
    pair = []
    for value in (F.avg(col), F.stddev_samp(col)):
        if propagate_null:
            value = null_aware(value, col)
        pair.append(value if digits is None else round_half_even(value, digits))
    return pair[0], pair[1]


def distinct_per_key(df: DataFrame, key: str, col: str, name: str = "n") -> DataFrame:
    """Distinct values of ``col`` per key, NULL counted as one value."""
    return df.groupBy(key, col).agg(F.lit(1)).groupBy(key).agg(F.count("*").alias(name))


def collect_ids(df: DataFrame, group: Sequence[str], col: str, name: str = "ids") -> DataFrame:
    """Ids of each group as a sorted array.

    For small result groups only: an array is one row.  A group that grows
    takes :func:`cohort_spark.operators.ranking.id_pages`.
    """
    return df.groupBy(*group).agg(F.count("*").alias("n"),
                                  F.array_sort(F.collect_list(col)).alias(name))


def freq_of_freq(df: DataFrame, col: str) -> DataFrame:
    """How many values occur once, twice, and so on; NULL is no value."""
    per_value = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("times"))
    return count_by(per_value, "times", name="n_values")


def quantiles(df: DataFrame, col: str, probs: Sequence[float], group: Sequence[str] = (),
              names: Sequence[str] | None = None, approximate: bool = False,
              accuracy: int = 10_000) -> DataFrame:
    """Linearly interpolated quantiles, overall or per group.

    Rows become (group, value, count) first.  The exact quantiles are then
    selected by place from ranges of the counted values, so no task holds the
    values of a group; ``approximate`` saves the sort.
    """
    names = names or [f"q{round(100 * p)}" for p in probs]
    if approximate:
        picked = F.percentile_approx(col, list(map(float, probs)), accuracy)
        out = df.groupBy(*group).agg(picked.alias("__q"))
        return out.select(*group, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])
    counts = (df.filter(F.col(col).isNotNull()).groupBy(*group, col)
              .agg(F.count("*").alias("__times")))
    return exact_quantiles(counts, col, "__times", probs, group, names)


def commonest(df: DataFrame, group: Sequence[str], col: str, name: str) -> DataFrame:
    """Most frequent non-NULL value per group, the lowest one on a tie."""
    counted = (df.filter(F.col(col).isNotNull()).groupBy(*group, col)
               .agg(F.count("*").alias("__n")))
    return counted.groupBy(*group).agg(
        F.min_by(F.col(col), F.struct(-F.col("__n"), F.col(col))).alias(name))


def value_range(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("low"), F.max(col).alias("high"))


def coverage(df: DataFrame, population: DataFrame, person: str = "person_id") -> DataFrame:
    """Distinct persons with a row, and their percentage of the population."""
    persons = (df.groupBy(person).agg(F.lit(1)).agg(F.count("*").alias("n_persons")))
    total = population.agg(F.count("*").alias("n"))
    out = persons.withColumn("n_population", total.scalar())
    pct = round_half_even(100 * F.col("n_persons") / F.col("n_population")).cast("int")
    return out.select("n_persons", "n_population", pct.alias("pct"),
                      F.concat(F.col("n_persons"), F.lit(" ( "), pct, F.lit(" %)")).alias("text"))


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                  members: DataFrame | None = None) -> DataFrame:
    """The first row per key in the stated order, reduced before the shuffle.

    Ties in ``order_by`` are settled by the remaining columns, so the result
    does not depend on partitioning.  ``members`` keeps the first key's values
    that it lists; the semi join stands right on the aggregate, where Catalyst
    can move it below.
    """
    others = [c for c in df.columns if c not in keys]
    rest = [c for c in others if c not in order_by]
    order = F.struct(*[F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))
                       for c in (*order_by, *rest)])
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    picked = df.groupBy(*[f"`{k}`" for k in keys]).agg(F.min_by(row, order).alias("__row"))
    if members is not None:
        picked = picked.join(members.select(keys[0]), keys[0], "left_semi")
    return picked.select(*[F.col(f"`{c}`") if c in keys else F.col(f"__row.`{c}`")
                           for c in df.columns])
