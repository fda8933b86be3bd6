"""Diagnosis and medication classes from ordered text rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark import fixed_values as fixed
from cohort_spark.functions.classify import with_dictionary_class
from cohort_spark.operators.aggregates import count_by, first_per_key

Rules = Sequence[tuple[str, str]]


def manifestation_rows(terms: DataFrame, rules: Rules = fixed.MANIFESTATION_RULES,
                       name: str = "manifestation") -> DataFrame:
    """Distinct person and diagnosis rows that fall into a class."""
    rows = terms.select("person_id", "case_or_control", "snomed_name", "snomed_code").distinct()
    return with_dictionary_class(rows, "snomed_name", rules, name, keep_default=False)


def class_dictionary(rows: DataFrame, name: str = "manifestation") -> DataFrame:
    """Diagnoses of each class with their row count, most frequent first."""
    keys = [name, "snomed_name", "snomed_code"]
    return count_by(rows, *keys).orderBy(
        F.asc_nulls_last(name), F.desc("n"), F.asc_nulls_last("snomed_name"),
        F.asc_nulls_last("snomed_code"))


def medication_rows(meds: DataFrame, order_by: Sequence[str],
                    rules: Rules = fixed.MEDICATION_RULES, name: str = "med_type",
                    members: DataFrame | None = None) -> DataFrame:
    """First medication row per person and class, in the stated order.

    ``members`` keeps the persons it lists.
    """
    classed = with_dictionary_class(meds, "standard_concept_name", rules, name, keep_default=False)
    return first_per_key(classed, ["person_id", name], order_by, members)
