"""Study arms: who is a case, who a control, and the arm labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.fixed_values import ARM_ORDER, SINGLE_COPY_PLOIDY, TWO_COPY_PLOIDY
from cohort_spark.operators.joins import natural_join


def study_arms(cases: DataFrame, controls: DataFrame, person: str = "person_id") -> DataFrame:
    """One row per study person; a person in both sets is a case."""
    marked = (cases.select(person, F.lit(True).alias("is_case"))
              .union(controls.select(person, F.lit(False).alias("is_case"))))
    return marked.groupBy(person).agg(F.max("is_case").alias("is_case"))


def label_arms(cohort: DataFrame, arms: DataFrame, person: str = "person_id",
               ploidy: str = "dragen_sex_ploidy", name: str = "case_or_ctrl") -> DataFrame:
    """Study rows of the cohort with their arm; other ploidies are ``nomatch``."""
    study = natural_join(cohort, arms, "inner", on=[person])
    role = F.when(F.col("is_case"), "case_").otherwise("ctrl_")
    label = (F.when(F.col(ploidy) == SINGLE_COPY_PLOIDY, F.concat(role, F.lit("male")))
             .when(F.col(ploidy) == TWO_COPY_PLOIDY, F.concat(role, F.lit("female")))
             .otherwise("nomatch"))
    return study.withColumn(name, label).drop("is_case")


def arm_rank(label: Column) -> Column:
    """Position of an arm in the report order; other labels come last."""
    rank = None
    for i, arm in enumerate(ARM_ORDER):
        rank = F.when(label == arm, i) if rank is None else rank.when(label == arm, i)
    return rank.otherwise(len(ARM_ORDER))


def age_range(labelled: DataFrame, arm: str = "case_or_ctrl",
              age: str = "age_at_biosample") -> DataFrame:
    return labelled.groupBy(arm).agg(F.min(age).alias("youngest"), F.max(age).alias("oldest"))
