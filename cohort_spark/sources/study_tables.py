"""The input tables of a study, and its delimited files under declared schemas."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from cohort_spark.sources.tables import as_schema, read_table
from cohort_spark.sources.variants import GENE_COLUMN, read_by_name

# Columns a study uses, bound by name; files may hold more.
SCHEMAS = {
    "demographics": "person_id bigint, date_of_birth date, sex_at_birth string, gender string, "
                    "race string, ethnicity string",
    "ancestry": "research_id bigint, ancestry_pred string",
    "metrics": "research_id bigint, dragen_sex_ploidy string, biosample_collection_date date",
    "calls": "Sample string, Chr string, Start int, Ref string, Alt string, "
             "`Func.refGene` string, `Gene.refGene` string, `AAChange.refGene` string, "
             "cosmic70 string, DP int, maxAD int, minAD int, AD string, F1R2 string, F2R1 string, "
             "SB string, AF string, F1R2_1 int, F1R2_2 int, F2R1_1 int, F2R1_2 int",
    "labs": "person_id bigint, standard_concept_name string, value_as_number double, "
            "unit_concept_name string, measurement_datetime timestamp",
    "diagnoses": "person_id bigint, standard_concept_name string, standard_concept_code bigint, "
                 "condition_start_datetime timestamp, source_vocabulary string, "
                 "source_concept_code string, source_concept_name string",
    "gem": "icd10cm string, icd9cm string",
    "snomed_map": "referencedComponentId bigint, referencedComponentName string, "
                  "mapTarget string, mapTargetName string, mapGroup int, mapPriority int",
    "phecodes": "icd10cm string, phecode string, phecode_str string",
    "medications": "person_id bigint, standard_concept_name string, "
                   "drug_exposure_start timestamp",
}
TAB_SEPARATED = ("ancestry", "metrics", "snomed_map")


@dataclass(frozen=True)
class Sources:
    """Input tables; a step touches only the ones it needs."""

    demographics: DataFrame
    ancestry: DataFrame
    metrics: DataFrame
    calls: DataFrame
    labs: DataFrame
    diagnoses: DataFrame
    gem: DataFrame
    snomed_map: DataFrame
    phecodes: DataFrame
    medications: DataFrame


class LazySources:
    """The same tables, each made by its function when first asked for."""

    def __init__(self, **makers: Callable[[], DataFrame]):
        self._makers = makers

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._makers:
            raise AttributeError(name)
        setattr(self, name, self._makers[name]())
        return self.__dict__[name]


def _read(spark: SparkSession, name: str, path: str | Sequence[str]) -> DataFrame:
    sep = "\t" if name in TAB_SEPARATED else ","
    if name == "calls":  # batches of many files, whose headers may differ
        return read_by_name(spark, path, as_schema(SCHEMAS[name]), sep, required=[GENE_COLUMN])
    return read_table(spark, path, SCHEMAS[name], sep=sep, by_name=True)


def read_sources(spark: SparkSession, paths: Mapping[str, str | Sequence[str]]) -> LazySources:
    """Sources of a study by name; a file is touched when a step asks for it.

    ``calls`` may list several batches, each file bound by its own header.
    """
    unknown = set(paths) - set(SCHEMAS)
    if unknown:
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    return LazySources(**{name: partial(_read, spark, name, path)
                          for name, path in paths.items()})
