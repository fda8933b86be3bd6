"""Length and breadth of the diagnosis record, overall and per arm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.fixed_values import AS_OF_YEAR
from cohort_spark.functions.dates import round_half_even, year_of
from cohort_spark.operators.aggregates import mean_sd
from cohort_spark.operators.joins import natural_join

PROBS = (0.1, 0.5, 0.9)


def person_history(dx: DataFrame, code: str, when: str = "condition_start_datetime",
                   person: str = "person_id", propagate_null: bool = False) -> DataFrame:
    """First year and number of distinct codes per person, NULL code included."""
    year = year_of(F.col(when))
    per_code = dx.groupBy(person, code).agg(
        F.min(year).alias("__first"), F.count_if(year.isNull()).alias("__undated"))
    first: Column = F.min("__first")
    if propagate_null:
        first = F.when(F.sum("__undated") == 0, first)
    return per_code.groupBy(person).agg(first.alias("first_year"),
                                        F.count("*").alias("num_codes"))


def history_summary(dx: DataFrame, population: DataFrame, code: str = "standard_concept_name",
                    as_of_year: int = AS_OF_YEAR, propagate_null: bool = False,
                    probs: Sequence[float] = PROBS) -> DataFrame:
    """One row: coverage, record length and codes per person.

    Persons are first counted per (first year, codes), a small table that all
    figures then share.
    """
    persons = person_history(dx, code, propagate_null=propagate_null)
    shape = persons.groupBy("first_year", "num_codes").agg(F.count("*").alias("times"))
    years = as_of_year - F.col("first_year")
    total = population.agg(F.count("*").alias("n"))
    out = shape.agg(
        F.sum("times").alias("n_persons"),
        *_weighted("years", years), *_weighted("first", F.col("first_year")),
        *_weighted("codes", F.col("num_codes")),
        F.count_if(F.col("first_year").isNull()).alias("__undated"),
        F.percentile(F.col("num_codes"), F.array(*[F.lit(float(p)) for p in probs]),
                     F.col("times")).alias("__q"),
    ).withColumn("__total", total.scalar())
    dated = F.lit(True) if not propagate_null else F.col("__undated") == 0
    mean_years = F.when(dated, round_half_even(_mean("years"), 0))
    sd_years = F.when(dated, round_half_even(_sd("first"), 0))
    mean_codes, sd_codes = (round_half_even(v, 0) for v in (_mean("codes"), _sd("codes")))
    pct = round_half_even(100 * F.col("n_persons") / F.col("__total"), 0)
    return out.select(
        "n_persons", pct.alias("pct"), mean_years.alias("mean_years"),
        sd_years.alias("sd_years"), mean_codes.alias("mean_codes"), sd_codes.alias("sd_codes"),
        *[F.col("__q")[i].alias(f"num_codes_q{round(100 * p)}") for i, p in enumerate(probs)],
        _paired(F.col("n_persons"), pct, "%)").alias("coverage_text"),
        _paired(mean_years, sd_years).alias("years_text"),
        _paired(mean_codes, sd_codes).alias("codes_text"))


def _paired(first: Column, second: Column, close: str = ")") -> Column:
    """``first ( second )`` with whole numbers."""
    return F.concat(first.cast("bigint"), F.lit(" ( "), second.cast("bigint"), F.lit(" " + close))


def _weighted(name: str, col: Column) -> list[Column]:
    times = F.when(col.isNotNull(), F.col("times"))
    col = col.cast("double")
    return [F.sum(times).alias(f"__{name}_n"), F.sum(col * times).alias(f"__{name}_s"),
            F.sum(col * col * times).alias(f"__{name}_ss")]


def _mean(name: str) -> Column:
    return F.col(f"__{name}_s") / F.col(f"__{name}_n")


def _sd(name: str) -> Column:
    n, s, ss = (F.col(f"__{name}_{part}") for part in ("n", "s", "ss"))
    # whole-number inputs: both sums are exact well past 1e9 persons
    return F.when(n > 1, F.sqrt((ss - s * s / n) / (n - 1)))


def history_by_arm(dx: DataFrame, arms: DataFrame, code: str = "snomed_name",
                   arm: str = "case_or_ctrl", as_of_year: int = AS_OF_YEAR,
                   person: str = "person_id", propagate_null: bool = False,
                   members: DataFrame | None = None, probs: Sequence[float] = PROBS) -> DataFrame:
    """Record length and codes per person, summarised per arm.

    ``members`` keeps the persons it lists; without it persons the arms lack
    form the NULL arm.
    """
    persons = person_history(dx, code, person=person, propagate_null=propagate_null)
    if members is not None:  # after the aggregate, where Catalyst can move it below
        persons = persons.join(members.select(person), person, "left_semi")
    joined = natural_join(persons, arms.select(person, arm), "left", on=[person])
    years = as_of_year - F.col("first_year")
    mean_years, _ = mean_sd(years, 0, propagate_null)
    _, sd_years = mean_sd(F.col("first_year"), 0, propagate_null)
    mean_codes, sd_codes = mean_sd(F.col("num_codes"), 0)
    picked = F.percentile(F.col("num_codes"), F.array(*[F.lit(float(p)) for p in probs]))
    out = joined.groupBy(arm).agg(
        F.count("*").alias("num_pts"), mean_years.alias("emr_dur"), sd_years.alias("emr_dur_sd"),
        mean_codes.alias("mean_num_codes"), sd_codes.alias("sd_num_codes"), picked.alias("__q"))
    names = [f"num_codes_q{round(100 * p)}" for p in probs]
    return out.select(arm, "num_pts", "emr_dur", "emr_dur_sd", "mean_num_codes", "sd_num_codes",
                      *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])
