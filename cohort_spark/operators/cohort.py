"""Cohort build: one row per person with ancestry, genomic metrics and age."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.functions.dates import exact_years, round_half_even
from cohort_spark.operators.joins import natural_join


def build_cohort(demographics: DataFrame, ancestry: DataFrame, metrics: DataFrame) -> DataFrame:
    """Left joins on the person, then persons with both dates, with their age.

    ``ancestry`` and ``metrics`` name the person ``research_id``.
    """
    ancestry = ancestry.select(F.col("research_id").alias("person_id"), "ancestry_pred")
    metrics = metrics.select(F.col("research_id").alias("person_id"),
                             "dragen_sex_ploidy", "biosample_collection_date")
    joined = natural_join(natural_join(demographics, ancestry, both_grow=True), metrics,
                          both_grow=True)
    known = joined.filter(F.col("date_of_birth").isNotNull()
                          & F.col("biosample_collection_date").isNotNull())
    age = round_half_even(exact_years(F.col("date_of_birth"),
                                      F.col("biosample_collection_date")), 0)
    return (known.withColumn("age_at_biosample", age.cast("double"))
            .withColumn("decade_at_biosample",
                        round_half_even(F.col("age_at_biosample"), -1).cast("double")))
