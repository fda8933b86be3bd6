"""Labs, record history, diagnosis vocabularies, scans and medications."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort_spark import fixed_values as fixed
from cohort_spark.operators import labs as lab_ops, vocab
from cohort_spark.operators.classes import class_dictionary as class_dictionary_of
from cohort_spark.operators.joins import semi
from cohort_spark.operators.scan import forest_table, scan_counts, top_terms
from cohort_spark.plans import stand_in
from cohort_spark.plans.oracle import dotted_phecode, scan_sql, with_ctes
from cohort_spark.plans.registry import query, r6, rounded_tests, shared_study, shown_tests


# --- labs ------------------------------------------------------------------------
@query(with_ctes("""SELECT person_id, lab_name, round(lab_val, 6) AS lab_val,
    standard_concept_name, units FROM labs_named""", "labs_named"))
def lab_named(spark, sf_dir):
    return lab_ops.name_labs(stand_in.labs(spark, sf_dir)).select(
        "person_id", "lab_name", r6("lab_val"), "standard_concept_name", "units")


@query(with_ctes("SELECT person_id, lab_name, round(lab_val, 6) AS lab_val, units FROM lab_values",
                 "lab_values"))
def lab_normalised(spark, sf_dir):
    """All six unit rules in one scan."""
    named = lab_ops.name_labs(stand_in.labs(spark, sf_dir))
    return lab_ops.normalise_labs(named).select("person_id", "lab_name", r6("lab_val"), "units")


@query(with_ctes("""SELECT person_id, lab_name, round(lab_val, 6) AS lab_val, units
    FROM lab_values WHERE lab_name = 'wbc'""", "lab_values"))
def lab_one_rule(spark, sf_dir):
    named = lab_ops.name_labs(stand_in.labs(spark, sf_dir))
    return lab_ops.normalise_lab(named, fixed.LAB_RULES[0]).select(
        "person_id", "lab_name", r6("lab_val"), "units")


_LOW = ", ".join(f"'{r.lab}'" for r in fixed.LAB_RULES if r.extreme == "min")
_TENTHS = ", ".join(f"'{r.lab}'" for r in fixed.LAB_RULES if r.digits == 1)


@query(with_ctes(f"""
    SELECT lab_name, case_or_ctrl, count(*) AS num_pts,
      CASE WHEN lab_name IN ({_TENTHS}) THEN round_even(avg(extreme), 1)
        ELSE round_even(avg(extreme), 0) END AS mean_extreme,
      CASE WHEN lab_name IN ({_TENTHS}) THEN round_even(stddev_samp(extreme), 1)
        ELSE round_even(stddev_samp(extreme), 0) END AS sd_extreme
    FROM (SELECT person_id, lab_name, CASE WHEN lab_name IN ({_LOW}) THEN min(lab_val)
            ELSE max(lab_val) END AS extreme
          FROM lab_values JOIN arms USING (person_id) GROUP BY person_id, lab_name)
    LEFT JOIN (SELECT person_id, case_or_ctrl FROM labelled) USING (person_id)
    GROUP BY lab_name, case_or_ctrl""", "lab_values", "labelled"))
def lab_arm_summary(spark, sf_dir):
    return shared_study(spark, sf_dir).lab_summary()


@query(with_ctes("""SELECT CAST(CAST(measurement_datetime AS DATE) AS VARCHAR) AS day, lab_name,
    round(lab_val, 6) AS lab_val, units FROM lab_values WHERE person_id = 8""", "lab_values"))
def person_labs(spark, sf_dir):
    values = lab_ops.normalise_labs(lab_ops.name_labs(stand_in.labs(spark, sf_dir)))
    return lab_ops.person_labs(values, 8).select(
        F.col("day").cast("string").alias("day"), "lab_name", r6("lab_val"), "units")


# --- history ---------------------------------------------------------------------
_HISTORY = """SELECT person_id, min(year(condition_start_datetime)) AS first_year,
    count(DISTINCT standard_concept_name) AS num_codes FROM {} GROUP BY 1"""
_WHOLE = "CAST({} AS BIGINT)"


@query(with_ctes("""
    SELECT *, CAST(n_persons AS VARCHAR) || ' ( ' || CAST(pct AS BIGINT) || ' %)' AS coverage_text,
      CAST(mean_years AS BIGINT) || ' ( ' || CAST(sd_years AS BIGINT) || ' )' AS years_text,
      CAST(mean_codes AS BIGINT) || ' ( ' || CAST(sd_codes AS BIGINT) || ' )' AS codes_text
    FROM (SELECT count(*) AS n_persons,
        round_even(100 * count(*) / (SELECT count(*) FROM cohort), 0) AS pct,
        round_even(avg(2023 - first_year), 0) AS mean_years,
        round_even(stddev_samp(first_year), 0) AS sd_years,
        round_even(avg(num_codes), 0) AS mean_codes,
        round_even(stddev_samp(num_codes), 0) AS sd_codes,
        round(quantile_cont(num_codes, 0.1), 6) AS num_codes_q10,
        round(quantile_cont(num_codes, 0.5), 6) AS num_codes_q50,
        round(quantile_cont(num_codes, 0.9), 6) AS num_codes_q90
      FROM persons)""", "dx", "cohort", extra={"persons": _HISTORY.format("dx")}))
def history_summary(spark, sf_dir):
    out = shared_study(spark, sf_dir).history_summary()
    return out.withColumns({c: F.round(c, 6) for c in out.columns if "_q" in c})


@query(with_ctes("""
    SELECT case_or_ctrl, count(*) AS num_pts, round_even(avg(2023 - first_year), 0) AS emr_dur,
      round_even(stddev_samp(first_year), 0) AS emr_dur_sd,
      round_even(avg(num_codes), 0) AS mean_num_codes,
      round_even(stddev_samp(num_codes), 0) AS sd_num_codes,
      round(quantile_cont(num_codes, 0.1), 6) AS num_codes_q10,
      round(quantile_cont(num_codes, 0.5), 6) AS num_codes_q50,
      round(quantile_cont(num_codes, 0.9), 6) AS num_codes_q90
    FROM persons LEFT JOIN (SELECT person_id, case_or_ctrl FROM labelled) USING (person_id)
    GROUP BY 1""", "dx", "labelled",
    extra={"persons": _HISTORY.format("dx JOIN arms USING (person_id)")}))
def history_by_arm(spark, sf_dir):
    out = shared_study(spark, sf_dir).history_by_arm()
    return out.withColumns({c: F.round(c, 6) for c in out.columns if "_q" in c})


# --- diagnosis terms -------------------------------------------------------------
@query(with_ctes("""SELECT person_id, case_or_control, snomed_name, snomed_code,
    CAST(condition_start_datetime AS TIMESTAMP) AS condition_start_datetime, source_vocabulary,
    source_concept_code, source_concept_name FROM study_dx""", "study_dx"))
def study_diagnoses(spark, sf_dir):
    """Diagnoses of study persons with their arm flag."""
    return shared_study(spark, sf_dir).diagnoses.select(
        "person_id", "case_or_control", "snomed_name", "snomed_code", "condition_start_datetime",
        "source_vocabulary", "source_concept_code", "source_concept_name")


@query(with_ctes("SELECT source_vocabulary, count(*) AS n FROM terms GROUP BY 1", "terms"))
def vocab_audit(spark, sf_dir):
    return vocab.vocab_audit(shared_study(spark, sf_dir).terms)


@query(with_ctes("SELECT icd9_code, icd10_code FROM crosswalk", "crosswalk"))
def crosswalk_first(spark, sf_dir):
    """One ICD-10 code per ICD-9 code, in a stated order."""
    return vocab.icd9_crosswalk(stand_in.gem(spark, sf_dir))


@query(with_ctes("""SELECT person_id, case_or_control, source_concept_code, icd9_dot_removed,
    icd10_code, icd10_name FROM from_icd9""", "from_icd9"))
def icd9_mapped(spark, sf_dir):
    study = shared_study(spark, sf_dir)
    return vocab.map_icd9(study.terms, study.sources.gem).select(
        "person_id", "case_or_control", "source_concept_code", "icd9_dot_removed", "icd10_code",
        "icd10_name")


@query(with_ctes("""SELECT person_id, case_or_control, snomed_name, snomed_code,
    source_concept_code, icd_code, icd_name FROM from_snomed""", "from_snomed"))
def snomed_mapped(spark, sf_dir):
    study = shared_study(spark, sf_dir)
    return vocab.map_snomed(study.terms, study.sources.snomed_map).select(
        "person_id", "case_or_control", "snomed_name", "snomed_code", "source_concept_code",
        "icd_code", "icd_name")


@query(with_ctes("""SELECT person_id, snomed_name, snomed_code, icd_code FROM from_snomed
    WHERE snomed_name = map_name""", "from_snomed"))
def snomed_mapped_by_name(spark, sf_dir):
    """Two-key form: code and name must both match."""
    study = shared_study(spark, sf_dir)
    return vocab.map_snomed(study.terms, study.sources.snomed_map, match_name=True).select(
        "person_id", "snomed_name", "snomed_code", "icd_code")


@query(with_ctes("SELECT person_id, case_or_control, icd10_code, icd10_name FROM icd10_rows",
                 "icd10_rows"))
def vocab_union(spark, sf_dir):
    return shared_study(spark, sf_dir).icd10_rows.select(
        "person_id", "case_or_control", "icd10_code", "icd10_name")


# --- scans -----------------------------------------------------------------------
_PERSONS = """count(DISTINCT CASE WHEN {case} THEN person_id END) AS case_w,
    count(DISTINCT CASE WHEN NOT {case} THEN person_id END) AS control_w"""
_BY_ARM = _PERSONS.format(case="is_case")
_BY_FLAG = _PERSONS.format(case="(case_or_control = 'case')")
_SNOMED_SQL = (f"SELECT standard_concept_name, {_BY_ARM} FROM dx JOIN arms USING (person_id) "
               "GROUP BY 1")


@query(scan_sql(_SNOMED_SQL, "standard_concept_name", "dx", "arms", tests=False,
                wrap="SELECT * EXCLUDE (p_val) FROM scan"))
def term_scan_counts(spark, sf_dir):
    """The 2x2 cells of every term, distinct persons."""
    study = shared_study(spark, sf_dir)
    return scan_counts(study.sources.diagnoses, study.arms, "standard_concept_name")


@query(scan_sql("""SELECT standard_concept_name, CAST(count(*) FILTER (is_case) AS BIGINT) AS case_w,
    CAST(count(*) FILTER (NOT is_case) AS BIGINT) AS control_w
    FROM (SELECT DISTINCT person_id, is_case, standard_concept_name, standard_concept_code
      FROM dx JOIN arms USING (person_id)) GROUP BY 1""", "standard_concept_name", "dx", "arms",
                tests=False, wrap="SELECT * EXCLUDE (p_val) FROM scan"))
def term_scan_person_codes(spark, sf_dir):
    """Cells that count distinct (person, code) pairs per name."""
    study = shared_study(spark, sf_dir)
    return scan_counts(study.sources.diagnoses, study.arms, "standard_concept_name",
                       unit_cols=["standard_concept_code"])


@query(scan_sql(_SNOMED_SQL, "standard_concept_name", "dx", "arms"))
def term_scan_tests(spark, sf_dir):
    """Cells, odds ratio, exact limits and p of every term."""
    return rounded_tests(shared_study(spark, sf_dir).snomed_scan())


@query(scan_sql(_SNOMED_SQL, "standard_concept_name", "dx", "arms",
                top="standard_concept_name", limit=fixed.TOP_SNOMED))
def term_scan_top(spark, sf_dir):
    scan = shared_study(spark, sf_dir).snomed_scan()
    return shown_tests(top_terms(scan, fixed.TOP_SNOMED, "standard_concept_name"))


@query(scan_sql(f"""SELECT icd10_name, icd10_code, {_BY_FLAG} FROM icd10_rows GROUP BY 1, 2""",
                "icd10_name, icd10_code", "icd10_rows"))
def icd10_scan(spark, sf_dir):
    return rounded_tests(shared_study(spark, sf_dir).icd10_scan())


@query(with_ctes("""SELECT icd10_name, icd10_code, count(*) FILTER (case_or_control = 'case')
    AS case_w, count(*) FILTER (case_or_control <> 'case') AS control_w FROM icd10_rows
    GROUP BY 1, 2""", "icd10_rows"))
def icd10_row_counts(spark, sf_dir):
    """Cells that count rows instead of persons."""
    study = shared_study(spark, sf_dir)
    return scan_counts(study.icd10_rows, study.arms, ["icd10_name", "icd10_code"], unit="rows",
                       flag="case_or_control").drop("case_wo", "control_wo")


@query(with_ctes("""
    SELECT person_id, case_or_control, source_concept_code AS icd10_code,
      source_concept_name AS icd10_name FROM terms WHERE source_vocabulary = 'ICD10CM'
    UNION ALL SELECT person_id, case_or_control, icd10_code, icd10_name FROM from_icd9
    UNION ALL SELECT -1, 'control', icd_code, icd_name FROM from_snomed
      WHERE snomed_name = map_name""", "terms", "from_icd9", "from_snomed"))
def vocab_union_literal(spark, sf_dir):
    """Source spellings, two-key SNOMED match, mapped SNOMED rows without a person."""
    study = shared_study(spark, sf_dir)
    return vocab.harmonise(study.terms, study.sources.gem, study.sources.snomed_map,
                           normal_form=False, match_name=True, keep_snomed_person=False).select(
        F.coalesce("person_id", F.lit(-1)).alias("person_id"), "case_or_control", "icd10_code",
        "icd10_name")


_CATEGORY_SQL = f"""SELECT icd10_base, {_BY_FLAG}, any_value(commonest) AS commonest_icd10_name
    FROM (SELECT *, substr(icd10_code, 1, 3) AS icd10_base FROM icd10_rows
      WHERE icd10_name IS NOT NULL)
    JOIN (SELECT substr(icd10_code, 1, 3) AS icd10_base, icd10_name AS commonest,
        row_number() OVER (PARTITION BY substr(icd10_code, 1, 3)
          ORDER BY count(*) DESC, icd10_name) AS rn
      FROM icd10_rows WHERE icd10_name IS NOT NULL GROUP BY 1, 2) USING (icd10_base)
    WHERE rn = 1 GROUP BY 1"""


@query(scan_sql(_CATEGORY_SQL, "icd10_base, commonest_icd10_name", "icd10_rows"))
def category_commonest(spark, sf_dir):
    """Scan of three-character categories, each with its commonest name."""
    return rounded_tests(shared_study(spark, sf_dir).category_scan())


_PHECODE_SQL = f"""SELECT phecode_str, {_BY_ARM}
    FROM icd10_rows JOIN phecodes USING (icd10_code) JOIN arms USING (person_id) GROUP BY 1"""


@query(scan_sql(_PHECODE_SQL, "phecode_str", "icd10_rows", "phecodes"))
def phecode_scan(spark, sf_dir):
    """Many-to-many crosswalk, distinct persons per phenotype."""
    return rounded_tests(shared_study(spark, sf_dir).phecode_scan())


@query(with_ctes("""SELECT phecode_str, count(*) FILTER (case_or_control = 'case') AS case_w,
    count(*) FILTER (case_or_control <> 'case') AS control_w
    FROM (SELECT DISTINCT CASE WHEN source = 3 THEN NULL ELSE person_id END AS person_id, phecode, phecode_str,
        CASE WHEN source = 3 THEN 'control' ELSE case_or_control END AS case_or_control
      FROM (SELECT 1 AS source, person_id, case_or_control, source_concept_code AS code FROM terms
          WHERE source_vocabulary = 'ICD10CM'
        UNION ALL SELECT 2, person_id, case_or_control, icd10_code FROM from_icd9
        UNION ALL SELECT 3, person_id, case_or_control, icd_code FROM from_snomed
          WHERE snomed_name = map_name)
      JOIN (SELECT DISTINCT """ + dotted_phecode() + """ AS code, phecode, phecode_str FROM phecode_parts)
        USING (code)) GROUP BY 1""", "terms", "from_icd9", "from_snomed", "phecode_parts"))
def phecode_scan_literal(spark, sf_dir):
    """Source spellings; mapped SNOMED rows have no person and count as controls."""
    study = stand_in.study(spark, sf_dir, literal=True)
    return scan_counts(study.phecode_rows(), study.arms, "phecode_str", unit_cols=["phecode"],
                       flag="case_or_control").drop("case_wo", "control_wo")


# --- ranked heads ----------------------------------------------------------------
@query(scan_sql(f"""SELECT icd10_name, icd10_code, {_BY_FLAG} FROM icd10_rows GROUP BY 1, 2""",
                "icd10_name, icd10_code", "icd10_rows", top="icd10_name, icd10_code",
                limit=fixed.TOP_ICD))
def icd10_top(spark, sf_dir):
    return shown_tests(shared_study(spark, sf_dir).top("icd10"))


@query(scan_sql(_CATEGORY_SQL, "icd10_base, commonest_icd10_name", "icd10_rows", top="icd10_base",
                limit=fixed.TOP_ICD))
def category_top(spark, sf_dir):
    return shown_tests(shared_study(spark, sf_dir).top("category"))


@query(scan_sql(_PHECODE_SQL, "phecode_str", "icd10_rows", "phecodes", top="phecode_str",
                limit=fixed.TOP_ICD))
def phecode_top(spark, sf_dir):
    return shown_tests(shared_study(spark, sf_dir).top("phecode"))


# --- classes ---------------------------------------------------------------------
@query(with_ctes("""SELECT person_id, case_or_control, snomed_name, snomed_code, manifestation
    FROM manifestations""", "manifestations"))
def manifestation_rows(spark, sf_dir):
    return shared_study(spark, sf_dir).manifestation_rows


@query(with_ctes("""SELECT manifestation, snomed_name, snomed_code, count(*) AS n
    FROM manifestations GROUP BY ALL ORDER BY manifestation, n DESC""", "manifestations"))
def class_dictionary(spark, sf_dir):
    return class_dictionary_of(shared_study(spark, sf_dir).manifestation_rows)


_MANIFESTATION_SQL = f"SELECT manifestation, {_BY_FLAG} FROM manifestations GROUP BY 1"


@query(scan_sql(_MANIFESTATION_SQL, "manifestation", "manifestations",
                top="manifestation", limit=fixed.TOP_MANIFESTATIONS))
def class_scan(spark, sf_dir):
    scan = shared_study(spark, sf_dir).manifestation_scan()
    return shown_tests(top_terms(scan, fixed.TOP_MANIFESTATIONS, "manifestation"))


@query(with_ctes("""SELECT manifestation, count(*) FILTER (case_or_control = 'case') AS case_w,
    count(*) FILTER (case_or_control <> 'case') AS control_w FROM manifestations GROUP BY 1""",
                 "manifestations"))
def class_row_counts(spark, sf_dir):
    """Cells that count (person, diagnosis) rows of a class."""
    study = shared_study(spark, sf_dir)
    return scan_counts(study.manifestation_rows, study.arms, "manifestation", unit="rows",
                       flag="case_or_control").drop("case_wo", "control_wo")


def _shown(col: str) -> str:
    rounded = f"round_even({col}, 1)"
    return (f"CASE WHEN {rounded} = floor({rounded}) THEN printf('%.0f', {rounded}) "
            f"ELSE printf('%.1f', {rounded}) END")


def _forest_sql(limit: float) -> str:
    return f"""
    SELECT *, printf('%.1f', round_even(odds_ratio, 1)) || ', [' || {_shown("or_low")} || ', '
      || {_shown("or_hi")} || '], n = ' || (case_w + control_w) AS label
    FROM scan WHERE or_hi < {limit}"""


@query(scan_sql(_MANIFESTATION_SQL, "manifestation", "manifestations",
                wrap=_forest_sql(fixed.FOREST_MAX_HIGH_DIAGNOSES)))
def forest_rows(spark, sf_dir):
    """Rows of the forest plot with their labels."""
    scan = shared_study(spark, sf_dir).manifestation_scan()
    return rounded_tests(forest_table(scan, fixed.FOREST_MAX_HIGH_DIAGNOSES))


@query(with_ctes("""SELECT person_id, standard_concept_name, drug_exposure_start, case_or_control,
    med_type FROM med_rows""", "med_rows"))
def med_first_per_class(spark, sf_dir):
    return shared_study(spark, sf_dir).medication_rows.select(
        "person_id", "standard_concept_name", "drug_exposure_start", "case_or_control", "med_type")


_MEDICATION_SQL = f"""SELECT med_type, {_BY_FLAG}, any_value(commonest)
      AS commonest_standard_concept_name
    FROM med_rows JOIN (SELECT med_type, standard_concept_name AS commonest,
        row_number() OVER (PARTITION BY med_type
          ORDER BY count(*) DESC, standard_concept_name) AS rn
      FROM med_rows WHERE standard_concept_name IS NOT NULL GROUP BY 1, 2) USING (med_type)
    WHERE rn = 1 GROUP BY 1"""
_MEDICATION_KEYS = "med_type, commonest_standard_concept_name"


@query(scan_sql(_MEDICATION_SQL, _MEDICATION_KEYS, "med_rows"))
def medication_scan(spark, sf_dir):
    return rounded_tests(shared_study(spark, sf_dir).medication_scan())


@query(scan_sql(_MEDICATION_SQL, _MEDICATION_KEYS, "med_rows", wrap=_forest_sql(fixed.FOREST_MAX_HIGH_MEDICATIONS)))
def medication_forest(spark, sf_dir):
    """Rows of the medication forest plot, cut at its own limit."""
    return rounded_tests(shared_study(spark, sf_dir).forest("medication"))


@query(with_ctes("""SELECT event_id, user_id AS person_id, event_type, value FROM events
    WHERE user_id IN (SELECT person_id FROM arms)""", "arms"))
def study_events(spark, sf_dir):
    """All rows of study persons in another table."""
    events = stand_in.table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("person_id"), "event_type", "value")
    return semi(events, shared_study(spark, sf_dir).arms, "person_id")


@query(with_ctes("""SELECT person_id, standard_concept_name, round(value_as_number, 6) AS value_as_number,
    unit_concept_name FROM labs WHERE person_id IN (SELECT person_id FROM arms)""", "labs", "arms"))
def study_labs(spark, sf_dir):
    """Lab rows of the cases and controls as given."""
    return shared_study(spark, sf_dir).study_labs().select(
        "person_id", "standard_concept_name", r6("value_as_number"), "unit_concept_name")


@query(with_ctes("""SELECT * FROM med_rows WHERE person_id = (SELECT person_id FROM site
    ORDER BY af DESC NULLS LAST, person_id LIMIT 1)""", "med_rows", "site"))
def person_medications(spark, sf_dir):
    """Drill-down to the classed medications of the case with the highest allele fraction."""
    study = shared_study(spark, sf_dir)
    highest = study.cases.orderBy(F.desc_nulls_last("AF"), "person_id").select("person_id").limit(1)
    return semi(study.medication_rows, highest, "person_id")
