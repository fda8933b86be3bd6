"""Lab values: naming, unit rules, per-person extremes, summary per arm.

All labs go through one scan: their rules are CASE branches, not six filters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark import fixed_values as fixed
from cohort_spark.fixed_values import LabRule
from cohort_spark.functions.classify import with_dictionary_class
from cohort_spark.functions.dates import round_half_even
from cohort_spark.functions.nulls import is_in, missing_to, not_in
from cohort_spark.operators.joins import natural_join


def name_labs(labs: DataFrame, rules: Sequence[tuple[str, str]] = fixed.LAB_NAME_RULES) -> DataFrame:
    """Named labs with sentinel and missing values removed."""
    value = F.col("value_as_number")
    kept = labs.filter(not_in(value, fixed.LAB_SENTINELS) & value.isNotNull())
    return (with_dictionary_class(kept, "standard_concept_name", rules, "lab_name")
            .select("person_id", "lab_name", value.alias("lab_val"), "standard_concept_name",
                    F.col("unit_concept_name").alias("units"), "measurement_datetime"))


def _scaled(rule: LabRule, units: Column) -> Column:
    value = F.col("lab_val")
    if rule.scale_unit is None:
        return value
    return (F.when(units == rule.scale_unit, value / rule.divide_by * rule.multiply_by)
            .otherwise(value))


def _kept(rule: LabRule, scaled: Column, units: Column) -> Column:
    test = scaled.isNotNull()
    if rule.units_kept is not None:
        test = test & is_in(units, rule.units_kept)
    for unit in rule.units_dropped:
        test = test & (units != unit)
    if rule.low is not None:
        test = test & scaled.between(rule.low, rule.high)
    return test


def normalise_labs(named: DataFrame, rules: Sequence[LabRule] = fixed.LAB_RULES) -> DataFrame:
    """Rows of the ruled labs in one unit each, out-of-range values removed.

    A value that is not kept explodes from a missing array, that is into no
    row; a later semi join on the person can still move below all the rules.
    """
    units = missing_to(F.col("units"), fixed.NO_UNIT)
    values = None
    for rule in rules:
        scaled = _scaled(rule, units)
        value = F.when(_kept(rule, scaled, units), F.array(scaled))
        here = F.col("lab_name") == rule.lab
        values = F.when(here, value) if values is None else values.when(here, value)
    replaced = {"lab_val": F.col("__value").alias("lab_val"), "units": units.alias("units")}
    return (named.withColumn("__value", F.explode(values))
            .select(*[replaced.get(c, F.col(c)) for c in named.columns]))


def normalise_lab(named: DataFrame, rule: LabRule) -> DataFrame:
    return normalise_labs(named, [rule])


def arm_summary(values: DataFrame, arms: DataFrame, rules: Sequence[LabRule] = fixed.LAB_RULES,
                arm: str = "case_or_ctrl", person: str = "person_id",
                members: DataFrame | None = None) -> DataFrame:
    """Per lab and arm: persons, mean and sd of each person's lowest or highest value.

    ``arms`` has one row per person.  ``members`` keeps the persons it lists;
    without it persons the arms lack form the NULL arm.
    """
    per_person = (values.groupBy(person, "lab_name")
                  .agg(F.min("lab_val").alias("__min"), F.max("lab_val").alias("__max")))
    if members is not None:  # after the aggregate, where Catalyst can move it below
        per_person = per_person.join(members.select(person), person, "left_semi")
    low_labs = [r.lab for r in rules if r.extreme == "min"]
    extreme = F.when(F.col("lab_name").isin(low_labs), F.col("__min")).otherwise(F.col("__max"))
    joined = natural_join(per_person.select(person, "lab_name", extreme.alias("extreme")),
                          arms.select(person, arm), "left", on=[person])
    raw = joined.groupBy("lab_name", arm).agg(
        F.count("*").alias("num_pts"), F.avg("extreme").alias("__mean"),
        F.stddev_samp("extreme").alias("__sd"))
    one_digit = F.col("lab_name").isin([r.lab for r in rules if r.digits == 1])

    def rounded(name: str) -> Column:
        return F.when(one_digit, round_half_even(F.col(name), 1)).otherwise(
            round_half_even(F.col(name), 0))

    return raw.select("lab_name", arm, "num_pts", rounded("__mean").alias("mean_extreme"),
                      rounded("__sd").alias("sd_extreme"))


def person_labs(values: DataFrame, person_id: int) -> DataFrame:
    """Dated values of one person over all labs."""
    return (values.filter(F.col("person_id") == person_id)
            .select(F.col("measurement_datetime").cast("date").alias("day"),
                    "lab_name", "lab_val", "units"))
