"""Diagnosis vocabularies brought to one, by crosswalk joins.

Codes take one normal form, without dots, on both sides of every join, so a
code written ``A01.1`` in one source and ``A011`` in another is one code.
``normal_form=False`` keeps each source's own spelling instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.functions.text import first_field, remove_first, to_number
from cohort_spark.operators.aggregates import count_by, first_per_key
from cohort_spark.operators.joins import join_on
from cohort_spark.operators.scan import flag_study
from cohort_spark.operators.sets import bind_rows


def study_dx(dx: DataFrame, arms: DataFrame) -> DataFrame:
    """Diagnoses of study persons with the arm flag and SNOMED columns renamed."""
    flagged = flag_study(dx, arms)
    renamed = (flagged.withColumnRenamed("standard_concept_name", "snomed_name")
               .withColumnRenamed("standard_concept_code", "snomed_code"))
    return renamed.select(*[c for c in renamed.columns if not c.startswith("standard")])


def study_terms(dx: DataFrame, arms: DataFrame) -> DataFrame:
    """Distinct person, SNOMED and source code combinations of the study.

    Rows are made distinct before the arms are joined, so a person with very
    many rows is reduced to their codes first.
    """
    source = [c for c in dx.columns if c.startswith("source_")]
    distinct = dx.select("person_id", F.col("standard_concept_name").alias("snomed_name"),
                         F.col("standard_concept_code").alias("snomed_code"), *source).distinct()
    return flag_study(distinct, arms)


def vocab_audit(terms: DataFrame) -> DataFrame:
    """Rows per source vocabulary, most frequent first."""
    return (count_by(terms, "source_vocabulary")
            .orderBy(F.desc("n"), F.asc_nulls_last("source_vocabulary")))


def code_form(code: Column, normal_form: bool = True) -> Column:
    return remove_first(code, ".") if normal_form else code


def icd10_category(code: Column, normal_form: bool = True) -> Column:
    """Three-character category of a dot-free code, or the part before the dot."""
    return F.substring(remove_first(code, "."), 1, 3) if normal_form else first_field(code, ".")


def icd9_crosswalk(gem: DataFrame, order_by: tuple[str, ...] = ("icd10_code",)) -> DataFrame:
    """One ICD-10 code per ICD-9 code: the first in the stated order."""
    pairs = gem.select(F.col("icd10cm").alias("icd10_code"), F.col("icd9cm").alias("icd9_code"),
                       *[c for c in order_by if c not in ("icd10_code", "icd9_code")])
    return first_per_key(pairs, ["icd9_code"], order_by).select("icd9_code", "icd10_code")


def icd10_names(terms: DataFrame) -> DataFrame:
    """Distinct dot-free ICD-10 codes and names seen in the study."""
    return (terms.filter(F.col("source_vocabulary") == "ICD10CM")
            .select(remove_first(F.col("source_concept_code"), ".").alias("icd10_code"),
                    F.col("source_concept_name").alias("icd10_name"))
            .distinct())


def map_icd9(terms: DataFrame, gem: DataFrame, names: DataFrame | None = None,
             order_by: tuple[str, ...] = ("icd10_code",)) -> DataFrame:
    """ICD-9 rows carried to ICD-10 through the crosswalk and the names in use."""
    names = icd10_names(terms) if names is None else names
    icd9 = (terms.filter(F.col("source_vocabulary") == "ICD9CM")
            .withColumn("icd9_dot_removed", remove_first(F.col("source_concept_code"), ".")))
    mapped = join_on(icd9, icd9_crosswalk(gem, order_by), {"icd9_dot_removed": "icd9_code"})
    return join_on(mapped, names, {"icd10_code": "icd10_code"})


def snomed_crosswalk(mapping: DataFrame) -> DataFrame:
    """First-priority ICD-10 target of every SNOMED code."""
    return (mapping.filter((F.col("mapGroup") == 1) & (F.col("mapPriority") == 1))
            .select(F.col("referencedComponentId").alias("snomed_code"),
                    F.col("referencedComponentName").alias("snomed_name"),
                    F.col("mapTarget").alias("icd_code"),
                    F.col("mapTargetName").alias("icd_name")))


def map_snomed(terms: DataFrame, mapping: DataFrame, match_name: bool = False) -> DataFrame:
    """SNOMED rows carried to ICD-10 by code, and by name too if asked."""
    snomed = (terms.filter(F.col("source_vocabulary") == "SNOMED")
              .withColumn("source_concept_code", to_number(F.col("source_concept_code"))))
    crosswalk = snomed_crosswalk(mapping)
    keys = {"snomed_code": "snomed_code"}
    if match_name:
        keys["snomed_name"] = "snomed_name"
    else:
        crosswalk = crosswalk.drop("snomed_name")
    return join_on(snomed, crosswalk, keys)


def harmonise(terms: DataFrame, gem: DataFrame, mapping: DataFrame,
              normal_form: bool = True, match_name: bool = False,
              keep_snomed_person: bool = True,
              order_by: tuple[str, ...] = ("icd10_code",)) -> DataFrame:
    """Person, arm, ICD-10 code and name from all three vocabularies.

    ``keep_snomed_person=False`` leaves the person of SNOMED rows out, which
    makes all of them controls.
    """
    who = ["person_id", "case_or_control"]
    native = (terms.filter(F.col("source_vocabulary") == "ICD10CM")
              .select(*who, F.col("source_concept_code").alias("icd10_code"),
                      F.col("source_concept_name").alias("icd10_name")))
    from_icd9 = map_icd9(terms, gem, order_by=order_by).select(*who, "icd10_code", "icd10_name")
    from_snomed = map_snomed(terms, mapping, match_name).select(
        *who, F.col("icd_code").alias("icd10_code"), F.col("icd_name").alias("icd10_name"))
    if not keep_snomed_person:
        from_snomed = from_snomed.withColumn("case_or_control", F.lit("control")).drop("person_id")
    rows = bind_rows(native, from_icd9, from_snomed)
    return rows.withColumn("icd10_code", code_form(F.col("icd10_code"), normal_form))


def to_phecodes(icd10_rows: DataFrame, phecodes: DataFrame, normal_form: bool = True,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """Distinct person and phecode; a code may have several phecodes.

    ``keep`` names columns that go with the person, such as the arm of rows
    that have no person to find it by.

    Rows are made distinct before the fan-out, so a code that fills much of
    the table is multiplied per person, not per row.
    """
    keys = icd10_rows.select("person_id", *keep, "icd10_code").distinct()
    if normal_form:
        phecodes = phecodes.withColumn("icd10cm", code_form(F.col("icd10cm")))
    joined = join_on(keys, phecodes.select("icd10cm", "phecode", "phecode_str").distinct(),
                     {"icd10_code": "icd10cm"}, relationship="many-to-many")
    return joined.select("person_id", *keep, "phecode", "phecode_str").distinct()
