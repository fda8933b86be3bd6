"""A whole case-control study over its source tables.

Shared results (cohort, passing calls, arms, distinct diagnosis terms) are
written once as stages, so later steps read a small table of known size
instead of recomputing the scans above it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import cached_property, partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark import fixed_values as fixed
from cohort_spark.operators import (
    arms as arm_ops,
    calls as call_ops,
    classes,
    history,
    labs as lab_ops,
    matching,
    vocab,
)
from cohort_spark.operators.cohort import build_cohort
from cohort_spark.operators.joins import semi
from cohort_spark.operators.models import LogisticFit, case_flag, fit_logistic
from cohort_spark.operators.scan import association_scan, flag_study, forest_table, top_terms
from cohort_spark.operators.table_one import table_one, table_one_tests
from cohort_spark.sources.people import PersonTable, by_person
from cohort_spark.sources.stages import save_named, stage
from cohort_spark.sources.study_tables import LazySources, Sources
from cohort_spark.sources.variants import GENE_COLUMN


class Results(Mapping):
    """Tables by name; each is made when first asked for."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers, self._made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


class Study:
    def __init__(self, sources: Sources | LazySources, gene: str, site_pattern: str,
                 ratio: int = fixed.CONTROLS_PER_CASE, seed: int = 1,
                 strata: Sequence[str] = fixed.MATCH_STRATA,
                 as_of_year: int = fixed.AS_OF_YEAR,
                 medication_order: Sequence[str] = ("standard_concept_name",),
                 literal: bool = False):
        """``literal`` counts rows and (person, code) pairs where persons are the
        better unit, keeps each source's code spelling, matches SNOMED targets by
        code and name, and leaves mapped SNOMED rows without a person."""
        self.sources, self.gene, self.site_pattern = sources, gene, site_pattern
        self.ratio, self.seed, self.strata = ratio, seed, tuple(strata)
        self.as_of_year, self.medication_order = as_of_year, tuple(medication_order)
        self.literal = literal

    # --- calls to cases -----------------------------------------------------
    @cached_property
    def cohort(self) -> DataFrame:
        s = self.sources
        return stage(build_cohort(s.demographics, s.ancestry, s.metrics), "cohort")

    @cached_property
    def passing(self) -> DataFrame:
        calls = self.sources.calls.filter(F.col(f"`{GENE_COLUMN}`") == self.gene)
        return stage(call_ops.passing_calls(calls, self.cohort), "passing_calls", compact=True)

    @cached_property
    def cases(self) -> DataFrame:
        """Calls at the site; a person with two such calls has two rows."""
        return call_ops.calls_at_site(self.passing, self.site_pattern)

    # --- cases to arms ------------------------------------------------------
    @cached_property
    def controls(self) -> DataFrame:
        return matching.match_controls(self.cases, self.cohort, self.passing,
                                       self.strata, self.ratio, self.seed)

    @cached_property
    def arms(self) -> DataFrame:
        return stage(arm_ops.study_arms(self.cases, self.controls), "arms")

    @cached_property
    def labelled(self) -> DataFrame:
        return arm_ops.label_arms(self.cohort, self.arms)

    # --- labs ---------------------------------------------------------------
    @cached_property
    def lab_values(self) -> DataFrame:
        """Ruled lab values of all persons; study persons are picked after aggregation."""
        return lab_ops.normalise_labs(lab_ops.name_labs(self.sources.labs))

    def lab_summary(self) -> DataFrame:
        return lab_ops.arm_summary(self.lab_values, self.labelled, members=self.arms)

    # --- diagnoses ----------------------------------------------------------
    @cached_property
    def diagnoses(self) -> DataFrame:
        return vocab.study_dx(self.sources.diagnoses, self.arms)

    @cached_property
    def terms(self) -> DataFrame:
        return stage(vocab.study_terms(self.sources.diagnoses, self.arms), "diagnosis_terms")

    @cached_property
    def icd10_rows(self) -> DataFrame:
        return vocab.harmonise(
            self.terms, self.sources.gem, self.sources.snomed_map,
            normal_form=not self.literal, match_name=self.literal,
            keep_snomed_person=not self.literal)

    def history_summary(self) -> DataFrame:
        return history.history_summary(self.sources.diagnoses, self.cohort,
                                       as_of_year=self.as_of_year)

    def history_by_arm(self) -> DataFrame:
        return history.history_by_arm(self.sources.diagnoses, self.labelled,
                                      code="standard_concept_name", as_of_year=self.as_of_year,
                                      members=self.arms)

    def scan(self, rows: DataFrame, term: str | Sequence[str], **options: object) -> DataFrame:
        return association_scan(rows, self.arms, term, **options)

    def _unit(self) -> dict[str, object]:
        return {"unit": "rows"} if self.literal else {}

    def snomed_scan(self, **options: object) -> DataFrame:
        if self.literal:
            options.setdefault("unit_cols", ["standard_concept_code"])
        return self.scan(self.sources.diagnoses, "standard_concept_name", **options)

    def icd10_scan(self, **options: object) -> DataFrame:
        return self.scan(self.icd10_rows, ["icd10_name", "icd10_code"],
                         flag="case_or_control", **self._unit(), **options)

    def category_rows(self) -> DataFrame:
        code = vocab.icd10_category(F.col("icd10_code"), normal_form=not self.literal)
        return (self.icd10_rows.filter(F.col("icd10_name").isNotNull())
                .withColumn("icd10_base", code))

    def category_scan(self, **options: object) -> DataFrame:
        return self.scan(self.category_rows(), "icd10_base", label="icd10_name",
                         flag="case_or_control", **self._unit(), **options)

    def phecode_rows(self) -> DataFrame:
        """Distinct person and phecode; the literal study carries the arm along,
        as its mapped SNOMED rows have no person to look it up by."""
        keep = ("case_or_control",) if self.literal else ()
        return vocab.to_phecodes(self.icd10_rows, self.sources.phecodes,
                                 normal_form=not self.literal, keep=keep)

    def phecode_scan(self, **options: object) -> DataFrame:
        units = {"unit_cols": ["phecode"], "flag": "case_or_control"} if self.literal else {}
        return self.scan(self.phecode_rows(), "phecode_str", **units, **options)

    @cached_property
    def manifestation_rows(self) -> DataFrame:
        return classes.manifestation_rows(self.terms)

    def manifestation_scan(self, **options: object) -> DataFrame:
        return self.scan(self.manifestation_rows, "manifestation", flag="case_or_control",
                         **self._unit(), **options)

    # --- medications --------------------------------------------------------
    @cached_property
    def medication_rows(self) -> DataFrame:
        first = classes.medication_rows(self.sources.medications, self.medication_order,
                                        members=self.arms)
        return flag_study(first, self.arms)

    def medication_scan(self, **options: object) -> DataFrame:
        return self.scan(self.medication_rows, "med_type", label="standard_concept_name",
                         flag="case_or_control", **options)

    # --- models -------------------------------------------------------------
    def fit(self, covariates: Sequence[str]) -> LogisticFit:
        """Logistic regression of being a case over the whole cohort."""
        return fit_logistic(case_flag(self.cohort, self.cases), "is_case", covariates)

    @cached_property
    def demographic_fit(self) -> LogisticFit:
        return self.fit(fixed.DEMOGRAPHIC_COVARIATES)

    @cached_property
    def genomic_fit(self) -> LogisticFit:
        return self.fit(fixed.GENOMIC_COVARIATES)

    # --- rows of study persons ----------------------------------------------
    def study_labs(self) -> DataFrame:
        """All lab rows of the cases and controls, as they were given."""
        return semi(self.sources.labs, self.arms, "person_id")

    def case_rows(self, other: DataFrame, person: str = "person_id") -> DataFrame:
        """Rows of another study's table that belong to the cases."""
        return semi(other, self.cases, person, "person_id")

    @cached_property
    def people(self) -> dict[str, PersonTable]:
        """Diagnoses, labs and medications kept by person, for drill-downs."""
        return {name: by_person(rows, name, spread=[when]) for name, rows, when in (
            ("diagnoses", self.diagnoses, "condition_start_datetime"),
            ("labs", self.lab_values, "measurement_datetime"),
            ("medications", self.medication_rows, "standard_concept_name"))}

    # --- results ------------------------------------------------------------
    def top(self, scan: str) -> DataFrame:
        """The head of a scan, by p."""
        terms, k = {
            "snomed": ("standard_concept_name", fixed.TOP_SNOMED),
            "icd10": (["icd10_name", "icd10_code"], fixed.TOP_ICD),
            "category": ("icd10_base", fixed.TOP_ICD), "phecode": ("phecode_str", fixed.TOP_ICD),
            "manifestation": ("manifestation", fixed.TOP_MANIFESTATIONS)}[scan]
        return top_terms(getattr(self, f"{scan}_scan")(), k, terms)

    def forest(self, scan: str) -> DataFrame:
        limit = (fixed.FOREST_MAX_HIGH_MEDICATIONS if scan == "medication"
                 else fixed.FOREST_MAX_HIGH_DIAGNOSES)
        return forest_table(getattr(self, f"{scan}_scan")(), limit)

    def results(self) -> Results:
        """Every table of the study by name, each made when it is asked for."""
        scans = {f"{name}_scan": getattr(self, f"{name}_scan") for name in (
            "snomed", "icd10", "category", "phecode", "manifestation", "medication")}
        heads = {f"{name}_top": partial(self.top, name) for name in (
            "snomed", "icd10", "category", "phecode", "manifestation")}
        forests = {f"{name}_forest": partial(self.forest, name)
                   for name in ("manifestation", "medication")}
        return Results({
            "passing_calls": lambda: self.passing, "calls_at_site": lambda: self.cases,
            "variant_counts": lambda: call_ops.variant_counts(self.cases),
            "high_fraction_calls": lambda: call_ops.high_af(self.cases),
            "controls": lambda: matching.controls_frame(self.cohort, self.controls),
            "match_deficit": lambda: matching.match_deficit(
                self.cases, self.cohort, self.passing, self.strata, self.ratio),
            "arms": lambda: self.labelled, "age_range": lambda: arm_ops.age_range(self.labelled),
            "demographic_model": lambda: self.demographic_fit.coefficients,
            "demographic_model_statistics": lambda: self.demographic_fit.statistics,
            "genomic_model": lambda: self.genomic_fit.coefficients,
            "genomic_model_statistics": lambda: self.genomic_fit.statistics,
            "table_one": lambda: table_one(self.cohort, with_n=True),
            "table_one_arms": lambda: table_one(self.labelled, strata="case_or_ctrl", with_n=True),
            "table_one_tests": lambda: table_one_tests(self.labelled, "case_or_ctrl"),
            "study_labs": self.study_labs, "lab_summary": self.lab_summary,
            "history_summary": self.history_summary, "history_by_arm": self.history_by_arm,
            "study_diagnoses": lambda: self.diagnoses,
            "vocab_audit": lambda: vocab.vocab_audit(self.terms),
            "class_dictionary": lambda: classes.class_dictionary(self.manifestation_rows),
            **scans, **heads, **forests,
        })

    def save(self, roots: Sequence[str], names: Sequence[str] | None = None,
             fmt: str = "csv") -> dict[str, list[str]]:
        """Write results under their names to every root."""
        results = self.results()
        return {name: save_named(results[name], name, roots, fmt)
                for name in (names if names is not None else results)}
