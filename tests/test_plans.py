"""Plans, not results: what is pushed down, what is never planned, both join regimes."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohort_spark.operators import matching
from cohort_spark.operators.cohort import build_cohort
from cohort_spark.operators.joins import natural_join
from cohort_spark.operators.scan import scan_counts
from cohort_spark.plans import queries_io, stand_in
from cohort_spark.plans.registry import shared_study
from conftest import values

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in (
    "stream_ingest", "stream_with_odd_files", "study_from_files", "study_from_mixed_batches")])
def test_no_query_plans_a_product(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_person_filter_reaches_the_scan(spark):
    text = plan(entry.queries()["one_person"](spark, SF_DIR))
    assert "EqualTo(o_custkey,7)" in text


def test_scan_reads_only_its_columns(spark):
    study = shared_study(spark, SF_DIR)
    text = plan(scan_counts(study.sources.diagnoses, study.arms, "standard_concept_name"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string>" in text


def test_semi_join_moves_below_the_aggregate_only_when_it_broadcasts(spark, request):
    study = shared_study(spark, SF_DIR)

    def first_of(df):
        lines = optimized(df).splitlines()
        return (min(i for i, line in enumerate(lines) if "LeftSemi" in line),
                max(i for i, line in enumerate(lines) if "Aggregate [person_id" in line))

    semi, aggregate = first_of(
        scan_counts(study.sources.diagnoses, study.arms, "standard_concept_name"))
    assert semi > aggregate
    request.getfixturevalue("no_broadcast")
    semi, aggregate = first_of(
        scan_counts(study.sources.diagnoses, study.arms, "standard_concept_name"))
    assert semi < aggregate


def test_study_rows_are_picked_before_they_are_classified(spark):
    study = shared_study(spark, SF_DIR)
    for df in (study.lab_summary(), study.medication_rows):
        lines = optimized(df).splitlines()
        semi = max(i for i, line in enumerate(lines) if "LeftSemi" in line)
        labels = max(i for i, line in enumerate(lines) if "<=> __text" in line)
        assert semi > labels


def test_rules_run_once_for_each_name(spark):
    """Every line of the plan with a rule stands on the count of a name, never on rows."""
    study = shared_study(spark, SF_DIR)
    for df in (study.lab_values, study.medication_rows, study.manifestation_rows):
        text = optimized(df)
        assert "RLIKE(" in text
        for line in text.splitlines():
            for column in re.findall(r"RLIKE\((\w+)#", line):
                assert column == "__text" or "Aggregate [" in line


def test_both_join_regimes_agree(spark, request):
    study = shared_study(spark, SF_DIR)

    def results():
        return [values(df) for df in (
            scan_counts(study.sources.diagnoses, study.arms, "standard_concept_name"),
            matching.match_controls(study.cases, study.cohort, study.passing,
                                    ratio=stand_in.RATIO),
            study.lab_summary(), study.history_by_arm(), study.medication_rows)]

    small = results()
    request.getfixturevalue("no_broadcast")
    assert results() == small


def test_labels_are_computed_once(spark):
    from cohort_spark.operators.labs import name_labs, normalise_labs
    text = optimized(normalise_labs(name_labs(stand_in.labs(spark, SF_DIR))))
    assert text.count("(?i)(?:lympho)") == 1


def test_hot_person_and_hot_term(spark, request):
    """A third of the rows in one person, a third in one term."""
    events = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997).alias("person_id"),
        F.when(F.col("id") % 3 == 1, "hot").otherwise(
            F.concat(F.lit("t"), F.col("id") % 13)).alias("term"))
    arms = spark.range(400).select(F.col("id").alias("person_id"),
                                   (F.col("id") % 5 == 0).alias("is_case"))
    expected = (events.join(arms, "person_id").groupBy("term")
                .agg(F.count_distinct(F.when(F.col("is_case"), F.col("person_id"))).alias("case_w"),
                     F.count_distinct(F.when(~F.col("is_case"), F.col("person_id")))
                     .alias("control_w")))
    want = values(expected)
    assert values(scan_counts(events, arms, "term"), "term", "case_w", "control_w") == want
    request.getfixturevalue("no_broadcast")
    assert values(scan_counts(events, arms, "term"), "term", "case_w", "control_w") == want


def test_call_files_grow_in_number(spark, tmp_path):
    calls = spark.range(400).select(F.concat(F.lit("s"), F.col("id") % 97).alias("Sample"), F.col("id").alias("Start"))
    given = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        queries_io._write_samples(calls, f"{tmp_path}/in")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", given)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "in").glob("*.csv"))) > 16


def test_calls_of_two_batches_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def depth(n):
        made.add(1)
        return n

    early, late = queries_io._in_two(spark.range(50).select(depth(F.col("id").cast("int")).alias("DP")), F.col("DP") < 25)
    assert (early.count(), late.count(), made.value) == (25, 25, 50)


def test_parts_are_joined_to_lines_last(spark):
    columns = stand_in.person_lines(spark, SF_DIR, ["p_name"], ["l_linenumber"]).columns
    assert columns.index("o_custkey") < columns.index("p_name")


def test_sides_that_grow_with_the_input_are_never_broadcast(spark):
    study = shared_study(spark, SF_DIR)
    s = study.sources
    ancestry = s.demographics.selectExpr("person_id AS research_id", "race AS ancestry_pred")
    pool = matching._hashed_pool(study.cohort, study.passing, "person_id", list(study.strata), 1)
    for made in (s.diagnoses, s.medications, build_cohort(s.demographics, ancestry, s.metrics), pool):
        assert "SortMergeJoin" in plan(made) and "Broadcast" not in plan(made)
    drawn = matching.match_controls(study.cases, study.cohort, study.passing, study.strata)
    assert not re.search(r"BroadcastHashJoin.*__bucket", plan(drawn))
    few = spark.range(9).withColumnRenamed("id", "k")
    assert "Broadcast" in plan(natural_join(few, few, on=["k"]))
    assert "Broadcast" not in plan(natural_join(few, few, on=["k"], both_grow=True))
