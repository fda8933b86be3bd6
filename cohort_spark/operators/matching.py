"""Matched control draw: per stratum, a seeded sample without replacement.

Controls of a stratum are the ``ratio x cases`` pool members with the lowest
md5 of seed and id.  A stratum may hold most of the population, so ids are not
ranked in one window: the leading hash digits split each stratum into buckets,
bucket counts give the one bucket in which the quota runs out, and only within
buckets are ids ranked.  The draw is exact and equal for any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.fixed_values import CONTROLS_PER_CASE, MATCH_STRATA
from cohort_spark.operators.joins import anti, natural_join

_HASH_DIGITS = 3  # 4096 buckets per stratum


def control_demand(cases: DataFrame, strata: Sequence[str] = MATCH_STRATA,
                   ratio: int = CONTROLS_PER_CASE) -> DataFrame:
    """Case rows per stratum and the controls they call for."""
    return (cases.groupBy(*strata).agg(F.count("*").alias("num_cases"))
            .withColumn("num_controls_needed", F.col("num_cases") * ratio))


def _hashed_pool(population, excluded, person, strata, seed):
    pool = anti(population.select(person, *strata), excluded, person, both_grow=True)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(person).cast("string")))
    return (pool.withColumn("__hash", digest)
            .withColumn("__bucket", F.substring("__hash", 1, _HASH_DIGITS)))


def _bucket_quota(pool, demand, strata):
    """Per stratum and bucket: members in earlier buckets, and the quota."""
    counts = pool.groupBy(*strata, "__bucket").agg(F.count("*").alias("__members"))
    before = (Window.partitionBy(*strata).orderBy("__bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("__before", F.coalesce(F.sum("__members").over(before), F.lit(0)))
    return natural_join(counts, demand, "inner", on=strata)


def match_controls(cases: DataFrame, population: DataFrame, excluded: DataFrame,
                   strata: Sequence[str] = MATCH_STRATA, ratio: int = CONTROLS_PER_CASE,
                   seed: int = 1, person: str = "person_id") -> DataFrame:
    """Ids and strata of the drawn controls.

    ``excluded`` holds every person who may not serve as a control.  A stratum
    with too few members gives all it has; see :func:`match_deficit`.
    """
    strata = list(strata)
    demand = control_demand(cases, strata, ratio)
    pool = _hashed_pool(population, excluded, person, strata, seed)
    quota = (_bucket_quota(pool, demand, strata)
             .filter(F.col("__before") < F.col("num_controls_needed"))
             .select(*strata, "__bucket",
                     (F.col("num_controls_needed") - F.col("__before")).alias("__left")))
    offered = natural_join(pool, quota, "inner", on=[*strata, "__bucket"], both_grow=True)
    rank = F.row_number().over(
        Window.partitionBy(*strata, "__bucket").orderBy("__hash", person))
    return (offered.withColumn("__rank", rank).filter(F.col("__rank") <= F.col("__left"))
            .select(person, *strata))


def match_deficit(cases: DataFrame, population: DataFrame, excluded: DataFrame,
                  strata: Sequence[str] = MATCH_STRATA, ratio: int = CONTROLS_PER_CASE,
                  person: str = "person_id") -> DataFrame:
    """Demand, supply and shortfall of every stratum that has a case."""
    strata = list(strata)
    supply = (anti(population.select(person, *strata), excluded, person, both_grow=True)
              .groupBy(*strata).agg(F.count("*").alias("num_controls_avail")))
    joined = natural_join(control_demand(cases, strata, ratio), supply, "left", on=strata)
    avail = F.coalesce(F.col("num_controls_avail"), F.lit(0))
    return joined.select(*strata, "num_cases", "num_controls_needed",
                         avail.alias("num_controls_avail"),
                         F.greatest(F.col("num_controls_needed") - avail, F.lit(0))
                         .alias("deficit"))


def controls_frame(population: DataFrame, drawn: DataFrame,
                   person: str = "person_id") -> DataFrame:
    """Full population rows of the drawn controls."""
    return natural_join(population, drawn.select(person), "inner", on=[person], null_safe=False)
