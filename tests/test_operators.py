import hashlib
import math
import random
from collections import Counter, defaultdict
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_spark import fixed_values as fixed
from cohort_spark.operators import aggregates as agg
from cohort_spark.operators import calls as call_ops
from cohort_spark.operators import classes, history, labs, matching, models, table_one, vocab
from cohort_spark.operators.arms import age_range, label_arms, study_arms
from cohort_spark.operators.cohort import build_cohort
from cohort_spark.operators.columns import drop_prefix, select_prefix
from cohort_spark.operators.joins import anti, flag_in, join_on, natural_join, semi
from cohort_spark.operators.scan import (
    association_scan,
    flag_study,
    forest_table,
    scan_counts,
    top_terms,
)
from cohort_spark.operators.sets import bind_rows, key_union
from conftest import values


# --- joins ---------------------------------------------------------------------
def test_missing_key_matches_missing_key(frame):
    left = frame([(1, "a"), (2, None), (3, "z")], "id int, k string")
    right = frame([("a", 10), (None, 20)], "k string, v int")
    assert values(natural_join(left, right), "id", "v") == [(1, 10), (2, 20), (3, None)]
    assert values(semi(left, right, "k"), "id") == [(1,), (2,)]
    assert values(anti(left, right, "k"), "id") == [(3,)]
    assert values(flag_in(left, right.union(right), "k", "f"), "id", "f") == [
        (1, True), (2, True), (3, False)]


def test_named_keys_keep_the_left_name_and_check_multiplicity(frame):
    left = frame([(1, "x"), (1, "y")], "a int, s string")
    right = frame([(1, "p"), (1, "q")], "b int, s string")
    joined = join_on(left, right, {"a": "b"}, relationship="many-to-many")
    assert joined.columns == ["a", "s_x", "s_y"] and joined.count() == 4
    with pytest.raises(ValueError, match="not unique"):
        join_on(left, right, {"a": "b"}, relationship="many-to-one")
    with pytest.raises(ValueError, match="no column"):
        natural_join(left.select("a"), right.select("b"))


def test_columns_with_dots_and_prefixes(frame):
    df = frame([(1, 2, 3, 4)], "`Gene.refGene` int, Otherinfo1 int, other2 int, x int")
    assert drop_prefix(df, "Other").columns == ["Gene.refGene", "x"]
    assert select_prefix(df, "gene", "x").columns == ["Gene.refGene", "x"]


def test_bind_rows_and_keys(frame):
    a, b = frame([(1, "u")], "id int, s string"), frame([("v", 2), ("w", 2)], "t string, id int")
    assert values(bind_rows(a, b), "id", "s", "t") == [(1, "u", None), (2, None, "v"),
                                                      (2, None, "w")]
    assert values(key_union("id", a, b)) == [(1,), (2,)]


# --- aggregates ----------------------------------------------------------------
def test_mean_sd_of_one_value_and_of_missing(frame):
    df = frame([("a", 1.0), ("b", 1.0), ("b", None), ("c", 1.0), ("c", 4.0)], "k string, v double")
    mean, sd = agg.mean_sd(F.col("v"), 1)
    strict, _ = agg.mean_sd(F.col("v"), 1, propagate_null=True)
    got = values(df.groupBy("k").agg(mean.alias("m"), sd.alias("s"), strict.alias("x")))
    assert got == [("a", 1.0, None, 1.0), ("b", 1.0, None, None), ("c", 2.5, 2.1, 2.5)]


def test_quantiles(frame):
    df = frame([(v,) for v in (10, 1, 4, 3, 2)], "v int")
    assert values(agg.quantiles(df, "v", [0.1, 0.5, 0.9]))[0] == pytest.approx((1.4, 3.0, 7.6))


def test_commonest_takes_the_lowest_on_a_tie(frame):
    df = frame([("k", "b"), ("k", "a"), ("k", "b"), ("k", "a"), ("k", None), ("k", None),
                ("k", None), ("j", None)], "g string, v string")
    assert values(agg.commonest(df, ["g"], "v", "top")) == [("k", "a")]


def test_first_per_key_ignores_partitioning(frame):
    rows = [(k, i * 37 % 101, f"v{i}") for i in range(300) for k in ("x", "y")]
    df = frame(rows, "k string, o int, v string")
    picks = {tuple(values(agg.first_per_key(df.repartition(n), ["k"], ["o"]))) for n in (1, 3, 7)}
    assert picks == {(("x", 0, "v0"), ("y", 0, "v0"))}


def test_small_summaries(frame):
    df = frame([(1, "a"), (1, "a"), (1, None), (2, "b"), (None, "c")], "p int, c string")
    assert values(agg.freq_of_freq(df, "p")) == [(1, 1), (3, 1)]
    assert values(agg.distinct_per_key(df, "p", "c")) == [(1, 2), (2, 1), (None, 1)]
    assert values(agg.value_range(df, "p")) == [(1, 2)]
    assert values(agg.collect_ids(df, ["p"], "c"), "p", "n", "ids")[0] == (1, 3, ["a", "a"])
    people = frame([(i,) for i in range(8)], "person_id int")
    seen = frame([(1,), (1,), (2,)], "person_id int")
    assert values(agg.coverage(seen, people)) == [(2, 8, 25, "2 ( 25 %)")]


# --- cohort and calls ----------------------------------------------------------
COHORT = ("person_id long, age_at_biosample double, dragen_sex_ploidy string, "
          "ancestry_pred string")


def test_cohort_keeps_persons_with_both_dates(frame):
    demographics = frame([(1, "1980-02-29"), (2, None), (3, "1990-01-01"), (4, "1978-08-29")],
                         "person_id long, date_of_birth string").withColumn(
        "date_of_birth", F.col("date_of_birth").cast("date"))
    ancestry = frame([(1, "eur")], "research_id long, ancestry_pred string")
    metrics = frame([(1, "XX", "2023-08-29"), (2, "XY", "2020-01-01"), (4, None, "2023-08-29")],
                    "research_id long, dragen_sex_ploidy string, biosample_collection_date string"
                    ).withColumn("biosample_collection_date",
                                 F.col("biosample_collection_date").cast("date"))
    got = values(build_cohort(demographics, ancestry, metrics), "person_id", "ancestry_pred",
                 "dragen_sex_ploidy", "age_at_biosample", "decade_at_biosample")
    assert got == [(1, "eur", "XX", 43.0, 40.0), (4, None, None, 45.0, 40.0)]


def call(sample, dp=30, minor=10, major=20, strands=(1, 1, 1, 1), af="0.3", aa="G:T:e:c:p.Q7V"):
    return (sample, "X", 1, "A", "G", "GENE", "exonic", aa, None, dp, major, minor, "", "", "", "",
            af, *strands, "drop")


CALLS = ("Sample string, Chr string, Start int, Ref string, Alt string, `Gene.refGene` string, "
         "`Func.refGene` string, `AAChange.refGene` string, cosmic70 string, DP int, maxAD int, "
         "minAD int, AD string, F1R2 string, F2R1 string, SB string, AF string, F1R2_1 int, "
         "F1R2_2 int, F2R1_1 int, F2R1_2 int, Otherinfo1 string")


def test_call_quality(frame):
    cohort = frame([(1, 50.0, "XY", "e"), (2, 50.0, "XX", "e"), (3, 50.0, None, "e")], COHORT)
    calls = frame([
        call("s1"), call("s1", dp=19), call("s1", minor=2), call("s1", strands=(1, 0, 1, 1)),
        call("s1", dp=20, minor=3, af="0.1,0.2"), call("s1", dp=None),
        call("s2", minor=3, major=23),   # p about 9e-5: passes
        call("s2", minor=10, major=12),  # p about 0.83: plain heterozygous
        call("s3", minor=10, major=12),  # ploidy missing and p high
        call("s3", minor=3, major=23),   # ploidy missing, p low
        call("s9"),                      # not in the cohort
    ], CALLS)
    got = values(call_ops.passing_calls(calls, cohort), "person_id", "DP", "AF")
    assert got == [(1, 20, None), (1, 30, 0.3), (2, 30, 0.3), (3, 30, 0.3)]
    assert "Otherinfo1" not in call_ops.supported_calls(calls).columns


def test_site_filter_and_table(frame):
    cohort = frame([(1, 50.0, "XY", "e")], COHORT).withColumn("sex_at_birth", F.lit("M"))
    calls = frame([call("s1", aa=aa) for aa in (
        None, "G", "G:T:e:c:p.Q7V", "G:T:e:c:p.Q7V,G:T2:e:c:p.Q7V", "G:T:e:c:p.R7V", "G:T:e:c:p.Q7")],
        CALLS)
    site = call_ops.calls_at_site(call_ops.passing_calls(calls, cohort), "Q7[A-Z]")
    assert values(site, "protein1", "protein2") == [("p.Q7V", "p.Q7V"), ("p.Q7V", None)]
    assert values(call_ops.variant_counts(site), "protein1", "n") == [("p.Q7V", 2)]
    assert values(call_ops.high_af(site), "AF") == []
    long = frame([call("s1", aa=":".join("abcdefghijk"))], CALLS)
    with pytest.raises(Exception, match="more than 10 fields"):
        call_ops.calls_at_site(call_ops.passing_calls(long, cohort), "Q7").collect()


# --- matching ------------------------------------------------------------------
def _draw(population, excluded, cases, ratio, seed):
    need = Counter(s for _, s in cases)
    pool = defaultdict(list)
    for person, stratum in population:
        if person not in excluded:
            key = hashlib.md5(f"{seed}:{person}".encode()).hexdigest()
            pool[stratum].append((key, person))
    return {p for s, n in need.items() for _, p in sorted(pool[s])[:ratio * n]}


@pytest.mark.parametrize("parts", [1, 5])
def test_matching_equals_brute_force_with_a_hot_stratum(frame, parts):
    rng = random.Random(5)
    strata = [(50.0, "XX", "a")] * 60 + [(51.0, "XY", None)] * 30 + [(52.0, "XX", "b")] * 10
    people = [(i, rng.choice(strata)) for i in range(6000)]
    people += [(9000, (60.0, "XY", "solo"))]
    cases = people[:25] + [people[0]] + [(9001, (60.0, "XY", "solo"))]
    excluded = {p for p, _ in people[:200]}
    schema = COHORT
    frame_of = lambda rows: frame([(p, *s) for p, s in rows], schema)
    drawn = matching.match_controls(
        frame_of(cases), frame_of(people).repartition(parts),
        frame([(p,) for p in excluded], "person_id long"), ratio=10, seed=4)
    ids = [r["person_id"] for r in drawn.collect()]
    assert len(ids) == len(set(ids)) and not excluded & set(ids)
    assert set(ids) == _draw(people, excluded, cases, 10, 4)


def test_deficit(frame):
    people = frame([(1, 50.0, "XX", "a"), (2, 50.0, "XX", "a"), (3, 51.0, "XX", None)], COHORT)
    cases = frame([(7, 50.0, "XX", "a"), (8, 52.0, "XY", "z")], COHORT)
    none = frame([], "person_id long")
    got = values(matching.match_deficit(cases, people, none, ratio=3), "age_at_biosample",
                 "num_controls_needed", "num_controls_avail", "deficit")
    assert got == [(50.0, 3, 2, 1), (52.0, 3, 0, 3)]


def test_arm_labels(frame):
    cohort = frame([(1, 40.0, "XY", "a"), (2, 50.0, "XX", "a"), (3, 60.0, "XY", "a"),
                    (4, 70.0, None, "a"), (5, 80.0, "XX", "a")], COHORT)
    ids = lambda *v: frame([(i,) for i in v], "person_id long")
    labelled = label_arms(cohort, study_arms(ids(1, 2, 1), ids(2, 3, 4)))
    assert values(labelled, "person_id", "case_or_ctrl") == [
        (1, "case_male"), (2, "case_female"), (3, "ctrl_male"), (4, "nomatch")]
    assert values(age_range(labelled))[0] == ("case_female", 50.0, 50.0)


# --- scans ---------------------------------------------------------------------
@pytest.fixture
def study(frame):
    arms = frame([(i, i < 4) for i in range(12)], "person_id int, is_case boolean")
    rng = random.Random(2)
    rows = [(rng.randrange(14), rng.choice("abcd"), rng.choice(["n1", "n2", None]))
            for _ in range(200)]
    return arms, rows, frame(rows, "person_id int, term string, name string")


def test_scan_counts_persons_and_rows(study):
    arms, rows, events = study
    for unit, count in (("persons", lambda ps: len(set(ps))), ("rows", len)):
        got = {r["term"]: (r["case_w"], r["control_w"], r["case_wo"], r["control_wo"])
               for r in scan_counts(events, arms, "term", unit=unit, label="name").collect()}
        for term in "abcd":
            a = count([p for p, t, _ in rows if t == term and p < 4])
            c = count([p for p, t, _ in rows if t == term and 4 <= p < 12])
            assert got[term] == (a, c, 4 - a, 8 - c)


def test_scan_by_flag_equals_scan_by_arms(study):
    arms, _, events = study
    flagged = flag_study(events, arms)
    by_flag = values(scan_counts(flagged, arms, "term", flag="case_or_control"))
    assert by_flag == values(scan_counts(events, arms, "term"))


def test_scan_with_codes_as_units(study):
    arms, rows, events = study
    got = dict(values(scan_counts(events, arms, "term", unit_cols=["name"]), "term", "case_w"))
    for term in "abcd":
        assert got[term] == len({(p, n) for p, t, n in rows if t == term and p < 4})


def test_row_counts_past_the_arm_are_refused(frame):
    arms = frame([(1, True), (2, False)], "person_id int, is_case boolean")
    events = frame([(1, "t"), (1, "t"), (2, "t")], "person_id int, term string")
    with pytest.raises(Exception, match="negative cell"):
        association_scan(events, arms, "term", unit="rows").collect()
    assert values(association_scan(events, arms, "term"), "term", "p_val") == [("t", 1.0)]


def test_forest_labels(frame):
    scan = frame([("a", 3, 4, 2.0, 1.25, 9.96, .1), ("b", 1, 0, 1.04, 0.0, 50.0, .2),
                  ("c", 1, 1, float("inf"), 0.3, float("inf"), .3)],
                 "t string, case_w long, control_w long, odds_ratio double, or_low double, "
                 "or_hi double, p_val double")
    assert values(forest_table(scan, 50), "t", "label") == [("a", "2.0, [1.2, 10], n = 7")]
    assert [r["t"] for r in top_terms(scan, 2, "t").collect()] == ["a", "b"]


# --- labs ----------------------------------------------------------------------
LABS = ("person_id int, standard_concept_name string, value_as_number double, "
        "unit_concept_name string, measurement_datetime timestamp")
NOW = datetime(2020, 5, 1, 12)


def lab(name, value, unit=None, person=1):
    return (person, name, value, unit, NOW)


def test_lab_naming_and_sentinels(frame):
    df = frame([lab("LEUKOCYTES lympho", 5.0), lab("x leuko", 5.0), lab("Lymphocytes", 0.0),
                lab("Lymphocytes", 1e7), lab("Lymphocytes", 1e8), lab("Platelet", None),
                lab(None, 2.0), lab("mean hemoglobin", 3.0), lab("mcv", 4.0)], LABS)
    assert values(labs.name_labs(df), "lab_name", "lab_val") == [
        ("hgb", 3.0), ("mcv", 4.0), ("nomatch", 2.0), ("nomatch", 5.0), ("wbc", 5.0)]


@pytest.mark.parametrize("name, value, unit, kept", [
    ("leukocytes", 100.0, "per cubic millimeter", 0.1),
    ("leukocytes", 50.0, None, 50.0), ("leukocytes", 50.01, None, None),
    ("leukocytes", 0.09, "x", None),
    ("lympho", 50.0, "percent", 50.0), ("lympho", 100.5, "percent", None),
    ("lympho", 50.0, None, None),            # missing becomes 'nounit', the list has 'nounits'
    ("lympho", 50.0, "nounits", 50.0), ("lympho", 50.0, "cells", None),
    ("hemoglobin", 150.0, "gram per liter", 15.0), ("hemoglobin", 9e5, None, 9e5),
    ("MCV", 90.0, "mmol/h", 90.0),
    ("sedimentation", 9.0, "mmol/h", None), ("sedimentation", 9.0, None, 9.0),
    ("reactive", 2.0, "milligram per deciliter", 20.0), ("reactive", 2.0, "mg/L", None),
    ("reactive", 2.0, None, 2.0), ("platelet", 2.0, None, None),
])
def test_lab_unit_rules(frame, name, value, unit, kept):
    got = values(labs.normalise_labs(labs.name_labs(frame([lab(name, value, unit)], LABS))),
                 "lab_val")
    assert got == ([] if kept is None else [(kept,)])


def test_lab_summary_takes_each_persons_extreme(frame):
    rows = [lab("leukocytes", v, None, p) for p, v in ((1, 5.0), (1, 3.0), (2, 4.0), (3, 9.0))]
    rows += [lab("MCV", v, None, p) for p, v in ((1, 80.0), (1, 95.0), (9, 70.0))]
    arms = frame([(1, "case_male"), (2, "case_male"), (3, "ctrl_male")],
                 "person_id int, case_or_ctrl string")
    named = labs.normalise_labs(labs.name_labs(frame(rows, LABS)))
    assert values(labs.arm_summary(named, arms)) == [
        ("mcv", "case_male", 1, 95.0, None), ("mcv", None, 1, 70.0, None),
        ("wbc", "case_male", 2, 3.5, 0.7), ("wbc", "ctrl_male", 1, 9.0, None)]
    assert len(values(labs.person_labs(named, 1))) == 4
    assert [r[1] for r in values(labs.arm_summary(named, arms, members=arms))] == [
        "case_male", "case_male", "ctrl_male"]


def test_labs_normalise_one_at_a_time_as_together(frame):
    rng = random.Random(1)
    rows = [lab(rng.choice(["leuko", "lympho", "hemoglobin", "mcv", "sedimentation", "reactive"]),
                rng.uniform(0, 200), rng.choice([None, "percent", "mg/L", "mmol/h",
                                                 "gram per liter"])) for _ in range(200)]
    named = labs.name_labs(frame(rows, LABS))
    apart = bind_rows(*[labs.normalise_lab(named, rule) for rule in fixed.LAB_RULES])
    assert values(apart) == values(labs.normalise_labs(named))


# --- history -------------------------------------------------------------------
DX = "person_id int, standard_concept_name string, condition_start_datetime timestamp"


def test_history(frame):
    year = lambda y: datetime(y, 3, 1)
    dx = frame([(1, "a", year(2001)), (1, "a", year(2000)), (1, None, year(2010)),
                (2, "b", None), (2, "c", year(2005))], DX)
    people = frame([(i,) for i in range(3)], "person_id int")
    row = history.history_summary(dx, people).first()
    assert (row["n_persons"], row["pct"], row["mean_years"], row["mean_codes"]) == (2, 67, 20, 2)
    assert row["coverage_text"] == "2 ( 67 %)" and row["years_text"] == "20 ( 4 )"
    strict = history.history_summary(dx, people, propagate_null=True).first()
    assert strict["mean_years"] is None and strict["mean_codes"] == 2
    arms = frame([(1, "case_male")], "person_id int, case_or_ctrl string")
    got = values(history.history_by_arm(dx, arms, "standard_concept_name"),
                 "case_or_ctrl", "num_pts", "emr_dur", "mean_num_codes", "num_codes_q50")
    assert got == [("case_male", 1, 23.0, 2.0, 2.0), (None, 1, 18.0, 2.0, 2.0)]


# --- vocabularies --------------------------------------------------------------
TERMS = ("person_id int, case_or_control string, snomed_name string, snomed_code long, "
         "source_vocabulary string, source_concept_code string, source_concept_name string")


@pytest.fixture
def vocabularies(frame):
    terms = frame([
        (1, "case", "s", 5, "ICD10CM", "A01.1", "alpha"),
        (2, "control", "s", 5, "ICD10CM", "B02", "beta"),
        (1, "case", "t", 6, "ICD9CM", "101.1", "old"),
        (3, "control", "t", 6, "ICD9CM", "999", "unmapped"),
        (1, "case", "u", 7, "SNOMED", "7", "u"),
        (2, "control", "v", 8, "SNOMED", "x8", "v"),
    ], TERMS)
    gem = frame([("A011", "1011"), ("B02", "1011"), ("Z00", "222")], "icd10cm string, icd9cm string")
    mapping = frame([(7, "u", "A01.1", "alpha", 1, 1), (7, "u", "C03", "other", 2, 1),
                     (8, "w", "D04", None, 1, 1)],
                    "referencedComponentId long, referencedComponentName string, "
                    "mapTarget string, mapTargetName string, mapGroup int, mapPriority int")
    return terms, gem, mapping


def test_harmonised_rows_share_one_code_form(vocabularies):
    got = values(vocab.harmonise(*vocabularies))
    assert got == [(1, "case", "A011", "alpha")] * 3 + [(2, "control", "B02", "beta"),
                                                       (2, "control", "D04", None)]


def test_harmonise_options(vocabularies):
    literal = values(vocab.harmonise(*vocabularies, normal_form=False), "person_id", "icd10_code")
    assert literal == [(1, "A01.1"), (1, "A01.1"), (1, "A011"), (2, "B02"), (2, "D04")]
    nobody = values(vocab.harmonise(*vocabularies, keep_snomed_person=False), "person_id",
                    "icd10_code", "case_or_control")
    assert nobody[-2:] == [(None, "A011", "control"), (None, "D04", "control")]
    named = vocab.map_snomed(vocabularies[0], vocabularies[2], match_name=True)
    assert values(named, "snomed_name", "source_concept_code") == [("u", 7.0)]


def test_category_forms(frame):
    df = frame([("A01.12",), ("A0112",), ("B2",)], "c string")
    assert values(df.select(vocab.icd10_category(F.col("c")).alias("k"))) == [
        ("A01",), ("A01",), ("B2",)]
    assert values(df.select(vocab.icd10_category(F.col("c"), False).alias("k"))) == [
        ("A01",), ("A0112",), ("B2",)]


def test_phecodes_count_a_person_once(frame):
    rows = frame([(1, "A011"), (1, "A012"), (2, "A011")], "person_id int, icd10_code string")
    phecodes = frame([("A01.1", "10", "p"), ("A01.2", "10", "p"), ("A01.1", "11", "q")],
                     "icd10cm string, phecode string, phecode_str string")
    assert values(vocab.to_phecodes(rows, phecodes)) == [
        (1, "10", "p"), (1, "11", "q"), (2, "10", "p"), (2, "11", "q")]


# --- classes -------------------------------------------------------------------
@pytest.mark.parametrize("text, label", [
    ("Fever with ANEMIA", "head and neck"), ("chondritis colitis", "head and neck"),
    ("Microscopic colitis", "abdomen"), ("giant cell arteritis", "vasculitis"),
    ("Systemic lupus", "inflammatory\narthritis"), ("Venous thrombosis", "thrombosis"),
    ("Gout", None), (None, None)])
def test_manifestations(frame, text, label):
    df = frame([(1, "case", text, 3)], "person_id int, case_or_control string, "
               "snomed_name string, snomed_code int")
    got = values(classes.manifestation_rows(df), "manifestation")
    assert got == ([] if label is None else [(label,)])


def test_medications_keep_the_first_row_of_a_class(frame):
    df = frame([(1, "hydrocortisone", 2), (1, "Betamethasone", 1), (1, "prednisone cortisone", 5),
                (1, "water", 0), (2, None, 0)], "person_id int, standard_concept_name string, day int")
    got = values(classes.medication_rows(df, ["day"]), "med_type", "standard_concept_name")
    assert got == [("systemic steroid", "prednisone cortisone"), ("topical steroid", "Betamethasone")]


# --- baseline tables and models -------------------------------------------------
def test_table_one_and_tests(frame):
    rows = [("a", 1.0, "x", "u"), ("a", 2.0, "x", "v"), ("a", 3.0, "y", "w"), ("b", 4.0, "y", "u"),
            ("b", 6.0, "y", None), ("b", None, "y", "u")]
    df = frame(rows, "arm string, age double, sex string, kind string")
    table = {(r["stratum"], r["variable"], r["level"]): r
             for r in table_one.table_one(df, ["age"], ["sex", "kind"], "arm").collect()}
    assert table[("b", "age", None)]["n"] == 2 and table[("b", "age", None)]["mean"] == 5.0
    assert table[("b", "kind", "u")]["pct"] == 100.0
    tests = {r["variable"]: r for r in
             table_one.table_one_tests(df, "arm", ["age"], ["sex", "kind"]).collect()}
    # by hand: F = 10.8 / (4 / 3); p from the closed t form with 3 degrees of freedom;
    # 2x2: every |O - E| is 1, so 0.25 (1 + 1/2 + 1 + 1/2)
    assert tests["age"]["statistic"] == pytest.approx(8.1)
    x = (8.1 / 3) ** 0.5
    share = 2 / math.pi * (math.atan(x) + x / (1 + x * x))
    assert tests["age"]["p_val"] == pytest.approx(1 - share, rel=1e-9)
    assert tests["sex"]["statistic"] == pytest.approx(0.75)
    assert tests["sex"]["p_val"] == pytest.approx(0.386476, abs=1e-6)
    assert tests["kind"]["df1"] == 2


def _newton(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        mu = 1 / (1 + np.exp(-x @ beta))
        info = (x.T * (mu * (1 - mu))) @ x
        beta = beta + np.linalg.solve(info, x.T @ (y - mu))
    return beta, np.sqrt(np.diag(np.linalg.inv(info)))


def test_logistic_against_newton_steps(frame):
    rng = random.Random(8)
    rows = []
    for _ in range(600):
        age, sex, race = rng.randint(40, 60), rng.choice(["F", "M"]), rng.choice(["a", "b", "c"])
        logit = -3 + 0.05 * age - 0.4 * (sex == "M") + 0.5 * (race == "c")
        rows.append((rng.random() < 1 / (1 + math.exp(-logit)), float(age), sex, race, "same"))
    df = frame(rows + [(True, None, "F", "a", "same")],
               "y boolean, age double, sex string, race string, flat string")
    got = {r["term"]: (r["estimate"], r["std_error"]) for r in models.logistic(
        df, "y", ["age", "sex", "race", "flat"]).collect()}
    x = np.array([[1, a, s == "M", r == "b", r == "c"] for _, a, s, r, _ in rows], float)
    beta, error = _newton(x, np.array([y for y, *_ in rows], float))
    for i, term in enumerate(["(Intercept)", "age", "sex_M", "race_b", "race_c"]):
        assert got[term] == pytest.approx((beta[i], error[i]), rel=1e-5)
    assert len(got) == 5


def test_logistic_reports_separation_and_aliased_terms(frame):
    kind = "y boolean, x double, g string, twin string"
    apart = [(i >= 20, float(i), "ab"[i % 2], "cd"[i % 2]) for i in range(40)]
    fit = models.fit_logistic(frame(apart, kind), "y", ["x", "g"])
    stats = fit.statistics.first()
    assert stats.separated and not stats.converged
    level = [(i % 3 == 0 or i % 4 == 3, float(i % 5), "abcc"[i % 4], "cd"[i % 2]) for i in range(60)]
    level = [(y if g != "b" else True, x, g, t) for y, x, g, t in level]  # one level holds cases only
    assert models.fit_logistic(frame(level, kind), "y", ["x", "g"]).statistics.first().separated
    mixed = [(i % 3 == 0, float(i % 7), "ab"[i % 2], "cd"[i % 2]) for i in range(84)]
    fit = models.fit_logistic(frame(mixed, kind), "y", ["x", "g", "twin"])
    terms = {r.term: r for r in fit.coefficients.collect()}
    stats = fit.statistics.first()
    assert stats.converged and not stats.separated and stats.residual_df == 84 - 3
    assert terms["twin_d"].estimate is None and terms["g_b"].estimate is not None
    one_sided = models.fit_logistic(frame([(True, 1.0, "a", "c"), (True, 2.0, "b", "d")], kind), "y", ["x"])
    assert one_sided.statistics.first().separated
    none = models.fit_logistic(frame([], kind), "y", ["x", "g"])
    assert none.statistics.first().n == 0 and none.coefficients.collect() == []


def test_logistic_far_from_its_start(frame):
    """Steps that overshoot are halved; the fit ends at zero gradient."""
    rows = [(x > 0 and i != 3, x, "a", "c") for i, x in enumerate([-90.0, -50.0, -1.0, 2.0, 40.0, 95.0, -2.0, 3.0])]
    rows += [(True, -60.0, "a", "c"), (False, 70.0, "a", "c")]
    fit = models.fit_logistic(frame(rows, "y boolean, x double, g string, twin string"), "y", ["x"])
    b = {r.term: r.estimate for r in fit.coefficients.collect()}
    gap = sum(y - 1 / (1 + math.exp(-(b["(Intercept)"] + b["x"] * x))) for y, x, *_ in rows)
    assert fit.statistics.first().converged and abs(gap) < 1e-6


def test_quantiles_and_pages_of_groups_over_many_ranges(frame):
    from cohort_spark.operators.ranking import id_pages, ranges
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), i) for i in range(3000)]
    df = frame(rows, "g string, v int, i long").repartition(5)
    got = {r.g: (r.q0, r.q25, r.q50, r.q99, r.q100) for r in agg.quantiles(
        df, "v", [0, 0.25, 0.5, 0.99, 1], ["g"]).collect()}
    for g in ("a", "b", None):
        v = [float(x) for h, x, _ in rows if h == g and x is not None]
        assert got[g] == pytest.approx(tuple(np.quantile(v, [0, 0.25, 0.5, 0.99, 1])))
    assert "percentile" not in agg.quantiles(df, "v", [0.5], ["g"])._jdf.queryExecution().toString()
    pages = {(r.g, r.page): r.ids for r in id_pages(df, ["g"], "i", 100).collect()}
    for g in ("a", "b", None):
        ids = sorted(i for h, _, i in rows if h == g)
        assert [i for p in range(-(-len(ids) // 100)) for i in pages[g, p]] == ids
    assert max(map(len, pages.values())) == 100
    before = {(r.g, r.i): r["__before"] for r in ranges(df, ["g"], ["i"], parts=7).with_before().collect()}
    assert all(sorted(b for (h, _), b in before.items() if h == g) == list(range(sum(h == g for h, *_ in rows)))
               for g in ("a", "b", None))
    assert agg.quantiles(df.limit(0), "v", [0.5], ["g"]).collect() == []
