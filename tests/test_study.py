"""A whole study over the smallest tables: every result, saved and read back."""

import uuid

import pytest
from pyspark.sql import functions as F

from cohort_spark.plans import stand_in
from cohort_spark.plans.study import Study
from cohort_spark.session import shared_folder
from cohort_spark.sources import read_table
from cohort_spark.sources.study_tables import read_sources

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def study(spark):
    return stand_in.study(spark, SF_DIR)


def test_every_result_has_a_plan_and_saved_ones_read_back(spark, study):
    results = study.results()
    assert all(df.columns for df in results.values())
    root = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    names = ["arms", "lab_summary", "medication_forest", "table_one_tests"]
    paths = study.save([f"{root}/a", f"{root}/b"], names)
    for name in names:
        for path in paths[name]:
            back = read_table(spark, path, results[name].schema)
            assert sorted(map(str, back.collect())) == sorted(map(str, results[name].collect()))


def test_scan_cells_sum_to_the_arms(study):
    arms = {r["is_case"]: r["count"] for r in study.arms.groupBy("is_case").count().collect()}
    for row in study.icd10_scan().collect():
        assert row["case_w"] + row["case_wo"] == arms[True]
        assert row["control_w"] + row["control_wo"] == arms[False]


def test_literal_counting(spark):
    literal = Study(stand_in.sources(spark, SF_DIR), stand_in.GENE, stand_in.SITE_PATTERN,
                    ratio=stand_in.RATIO, literal=True)
    rows = literal.icd10_rows
    assert rows.filter("person_id is null and case_or_control <> 'control'").count() == 0
    assert rows.filter("person_id is null").count() > 0
    assert rows.filter("icd10_code like '%.%'").count() > 0
    assert literal.category_rows().filter("length(icd10_base) > 3").count() > 0


def test_unknown_source_is_refused(spark):
    with pytest.raises(ValueError, match="unknown sources"):
        read_sources(spark, {"surveys": "x"})
    with pytest.raises(AttributeError):
        read_sources(spark, {"labs": "x"}).calls


def test_every_result_has_a_table_and_is_made_on_demand(spark):
    study = stand_in.study(spark, "/root/testdata/sf0.001")
    results = study.results()
    assert {"demographic_model", "genomic_model", "study_labs", "snomed_top", "icd10_top", "category_top",
            "phecode_top", "manifestation_top", "medication_forest", "table_one_arms"} <= set(results)
    assert "arms" not in vars(study) and len(results) == len(list(results))
    assert results["arms"] is results["arms"]
    kept = study.people["labs"]
    person = kept.rows().where("person_id is not null").first().person_id
    assert kept.of(person).count() == study.lab_values.where(F.col("person_id") == person).count() > 0


def test_literal_study_keeps_rows_without_a_person(spark):
    study = stand_in.study(spark, "/root/testdata/sf0.001", literal=True)
    rows = study.phecode_rows()
    assert rows.where("person_id is null").count() > 0
    assert rows.where("person_id is null and case_or_control <> 'control'").count() == 0
