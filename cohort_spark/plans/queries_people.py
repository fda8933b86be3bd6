"""Cohort, calls, matching, arms, baseline tables and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort_spark import fixed_values as fixed
from cohort_spark.operators import arms as arm_ops
from cohort_spark.operators import calls as call_ops
from cohort_spark.operators import matching, models, table_one as tables
from cohort_spark.operators.cohort import build_cohort
from cohort_spark.operators.joins import semi
from cohort_spark.plans import stand_in
from cohort_spark.plans.oracle import logistic_ctes, tail_sql, with_ctes
from cohort_spark.plans.registry import query, r6, shared_study

_PERSON = """person_id, CAST(date_of_birth AS VARCHAR) AS date_of_birth, sex_at_birth, gender, race,
    ethnicity, ancestry_pred, dragen_sex_ploidy,
    CAST(biosample_collection_date AS VARCHAR) AS biosample_collection_date, age_at_biosample,
    decade_at_biosample"""


def _person(cohort):
    """Cohort columns, dates as text."""
    return cohort.select(
        "person_id", F.col("date_of_birth").cast("string").alias("date_of_birth"), "sex_at_birth",
        "gender", "race", "ethnicity", "ancestry_pred", "dragen_sex_ploidy",
        F.col("biosample_collection_date").cast("string").alias("biosample_collection_date"),
        "age_at_biosample", "decade_at_biosample")


@query(with_ctes(f"SELECT {_PERSON} FROM cohort", "cohort"))
def cohort_build(spark, sf_dir):
    return _person(build_cohort(stand_in.demographics(spark, sf_dir),
                                stand_in.ancestry(spark, sf_dir), stand_in.metrics(spark, sf_dir)))


# --- calls -----------------------------------------------------------------------
@query(with_ctes("""SELECT person_id, pos, alt, func, gene_name, aa_change, cosmic70, dp AS depth,
    af, round(binom_p_val, 6) AS binom_p_val FROM tested""", "tested"))
def call_support_binomial(spark, sf_dir):
    """Read-support filter and exact binomial p over the calls of all genes."""
    tested = call_ops.test_calls(call_ops.supported_calls(stand_in.calls(spark, sf_dir)))
    return tested.select("person_id", "pos", "alt", "func", "gene_name", "aa_change", "cosmic70",
                         F.col("DP").alias("depth"), F.col("AF").alias("af"), r6("binom_p_val"))


@query(with_ctes("""SELECT person_id, pos, alt, func, aa_change, cosmic70, dp AS depth, af,
    round(binom_p_val, 6) AS binom_p_val, dragen_sex_ploidy, age_at_biosample FROM passing""",
                 "passing"))
def call_qc_passing(spark, sf_dir):
    return shared_study(spark, sf_dir).passing.select(
        "person_id", "pos", "alt", "func", "aa_change", "cosmic70", F.col("DP").alias("depth"),
        F.col("AF").alias("af"), r6("binom_p_val"), "dragen_sex_ploidy", "age_at_biosample")


_FIELDS = ", ".join(fixed.AA_CHANGE_FIELDS)


@query(with_ctes(f"SELECT person_id, pos, func, {_FIELDS} FROM site", "site"))
def site_filter(spark, sf_dir):
    return shared_study(spark, sf_dir).cases.select(
        "person_id", "pos", "func", *fixed.AA_CHANGE_FIELDS)


@query(with_ctes("""SELECT count(*) AS n_calls, count(*) FILTER (af IS NULL) AS n_no_single_af,
    count(*) FILTER (protein1 IS NULL AND func <> 'splicing') AS n_unsplit_not_splicing,
    count(*) FILTER (protein1 <> protein2) AS n_protein_differs FROM split""", "split"))
def call_audit(spark, sf_dir):
    """Counts behind the data assumptions of the call filter."""
    from cohort_spark.functions.text import split_fields
    passing = shared_study(spark, sf_dir).passing
    return call_ops.call_audit(split_fields(passing, "aa_change", fixed.AA_CHANGE_SEPARATOR,
                                            fixed.AA_CHANGE_FIELDS))


@query(with_ctes("""SELECT gene_name, dragen_sex_ploidy, sex_at_birth, dna1, protein1,
    count(*) AS n FROM site GROUP BY ALL ORDER BY n DESC""", "site"))
def variant_counts(spark, sf_dir):
    return call_ops.variant_counts(shared_study(spark, sf_dir).cases)


@query(with_ctes("SELECT person_id, pos, af FROM site WHERE af > 0.1", "site"))
def high_fraction_calls(spark, sf_dir):
    high = call_ops.high_af(shared_study(spark, sf_dir).cases, above=0.1)
    return high.select("person_id", "pos", F.col("AF").alias("af"))


@query(with_ctes("""SELECT event_id, user_id AS person_id, event_type, value FROM events
    WHERE user_id IN (SELECT person_id FROM site)""", "site"))
def case_lookup(spark, sf_dir):
    """Rows of another table that belong to the cases."""
    events = stand_in.table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("person_id"), "event_type", "value")
    return call_ops.lookup(events, shared_study(spark, sf_dir).cases)


# --- matching and arms -------------------------------------------------------------
_STRATA = ", ".join(fixed.MATCH_STRATA)


@query(with_ctes(f"SELECT {_STRATA}, num_cases, num_controls_needed FROM demand", "demand"))
def control_demand(spark, sf_dir):
    return matching.control_demand(shared_study(spark, sf_dir).cases, ratio=stand_in.RATIO)


@query(with_ctes(f"SELECT person_id, {_STRATA} FROM controls", "controls"))
def match_controls(spark, sf_dir):
    """Seeded draw without replacement; a stratum gives its lowest hashes."""
    return shared_study(spark, sf_dir).controls


@query(with_ctes(f"""
    SELECT {", ".join("b." + c for c in fixed.MATCH_STRATA)}, num_cases, num_controls_needed,
      coalesce(n, 0) AS num_controls_avail,
      greatest(num_controls_needed - coalesce(n, 0), 0) AS deficit
    FROM demand b LEFT JOIN (SELECT {_STRATA}, count(*) AS n FROM pool GROUP BY ALL) a
    ON {" AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in fixed.MATCH_STRATA)}""",
                 "demand", "pool"))
def match_deficit(spark, sf_dir):
    study = shared_study(spark, sf_dir)
    return matching.match_deficit(study.cases, study.cohort, study.passing, study.strata,
                                  stand_in.RATIO)


@query(with_ctes(f"SELECT {_PERSON} FROM cohort JOIN (SELECT person_id FROM controls) "
                 "USING (person_id)", "controls"))
def controls_frame(spark, sf_dir):
    study = shared_study(spark, sf_dir)
    return _person(matching.controls_frame(study.cohort, study.controls))


@query(with_ctes("SELECT person_id, dragen_sex_ploidy, case_or_ctrl FROM labelled", "labelled"))
def arm_labels(spark, sf_dir):
    return shared_study(spark, sf_dir).labelled.select(
        "person_id", "dragen_sex_ploidy", "case_or_ctrl")


@query(with_ctes("""SELECT case_or_ctrl, min(age_at_biosample) AS youngest,
    max(age_at_biosample) AS oldest FROM labelled GROUP BY 1""", "labelled"))
def age_range(spark, sf_dir):
    return arm_ops.age_range(shared_study(spark, sf_dir).labelled)


@query(with_ctes(f"""SELECT case_or_ctrl, count(*) AS n, CASE case_or_ctrl
    {" ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(fixed.ARM_ORDER))} ELSE 4 END AS arm_rank
    FROM labelled GROUP BY 1""", "labelled"))
def arm_order(spark, sf_dir):
    """Arms in report order."""
    arm = F.col("case_or_ctrl")
    return (shared_study(spark, sf_dir).labelled.groupBy(arm).agg(F.count("*").alias("n"))
            .withColumn("arm_rank", arm_ops.arm_rank(arm))
            .orderBy("arm_rank"))


@query(with_ctes(f"""SELECT {_PERSON} FROM cohort WHERE person_id = (SELECT person_id FROM site
    ORDER BY af DESC NULLS LAST, person_id LIMIT 1)""", "cohort", "site"))
def person_record(spark, sf_dir):
    """Cohort row of the case with the highest allele fraction."""
    study = shared_study(spark, sf_dir)
    highest = study.cases.orderBy(F.desc_nulls_last("AF"), "person_id").select("person_id").limit(1)
    return _person(semi(study.cohort, highest, "person_id"))


# --- baseline tables ---------------------------------------------------------------
def _table_one_sql(source: str, stratum: str) -> str:
    pairs = " UNION ALL ".join(
        f"SELECT {stratum} AS stratum, '{c}' AS variable, {c} AS level FROM {source}"
        for c in tables.CATEGORICAL)
    return f"""
        SELECT {stratum} AS stratum, 'age_at_biosample' AS variable, NULL AS level,
          count(*) AS n, round(avg(age_at_biosample), 6) AS mean,
          round(stddev_samp(age_at_biosample), 6) AS sd, CAST(NULL AS DOUBLE) AS pct
        FROM {source} GROUP BY ALL
        UNION ALL
        SELECT stratum, variable, level, n, NULL, NULL,
          round(100 * n / sum(n) OVER (PARTITION BY stratum, variable), 6)
        FROM (SELECT stratum, variable, level, count(*) AS n FROM ({pairs})
          WHERE level IS NOT NULL GROUP BY ALL)"""


def _rounded_table(df):
    return df.select("stratum", "variable", "level", "n", r6("mean"), r6("sd"), r6("pct"))


@query(with_ctes(_table_one_sql("cohort", "'overall'"), "cohort"))
def table_one_overall(spark, sf_dir):
    return _rounded_table(tables.table_one(shared_study(spark, sf_dir).cohort))


@query(with_ctes(_table_one_sql("labelled", "case_or_ctrl"), "labelled"))
def table_one_arms(spark, sf_dir):
    return _rounded_table(tables.table_one(shared_study(spark, sf_dir).labelled,
                                           strata="case_or_ctrl"))


@query(with_ctes(f"""SELECT stratum, variable, level, CASE WHEN level IS NULL
    THEN printf('%.2f (%.2f)', round_even(mean, 2), round_even(sd, 2))
    ELSE printf('%d (%.1f)', n, round_even(pct, 1)) END AS text
    FROM ({_table_one_sql("labelled", "case_or_ctrl")})""", "labelled"))
def table_one_printed(spark, sf_dir):
    """The baseline table in its printed form."""
    table = tables.table_one(shared_study(spark, sf_dir).labelled, strata="case_or_ctrl")
    return tables.table_one_text(table).select("stratum", "variable", "level", "text")


@query(with_ctes(f"""SELECT stratum, variable, level, CASE WHEN variable = 'n' THEN CAST(n AS VARCHAR)
    WHEN level IS NULL THEN printf('%.2f (%.2f)', round_even(mean, 2), round_even(sd, 2))
    ELSE printf('%d (%.1f)', n, round_even(pct, 1)) END AS text
    FROM ({_table_one_sql("labelled", "case_or_ctrl")} UNION ALL
      SELECT case_or_ctrl, 'n', NULL, count(*), NULL, NULL, NULL FROM labelled GROUP BY 1)""", "labelled"))
def table_one_with_n(spark, sf_dir):
    """The printed baseline table with the persons of each stratum."""
    table = tables.table_one(shared_study(spark, sf_dir).labelled, strata="case_or_ctrl", with_n=True)
    return tables.table_one_text(table).select("stratum", "variable", "level", "text")


_TEST_PAIRS = " UNION ALL ".join(
    f"SELECT case_or_ctrl AS stratum, '{c}' AS variable, {c} AS level FROM labelled "
    f"WHERE {c} IS NOT NULL" for c in tables.CATEGORICAL)


_TESTS_SQL = """
    SELECT 'age_at_biosample' AS variable, 'anova' AS test,
      (between_ss / (g - 1)) / (within_ss / (n - g)) AS statistic,
      CAST(g - 1 AS DOUBLE) AS df1, CAST(n - g AS DOUBLE) AS df2
    FROM (SELECT sum(gn * (gm - m) * (gm - m)) AS between_ss, sum(ss) AS within_ss,
            count(*) AS g, sum(gn) AS n
          FROM (SELECT case_or_ctrl, count(*) AS gn, avg(age_at_biosample) AS gm,
                  var_pop(age_at_biosample) * count(*) AS ss FROM labelled GROUP BY 1),
               (SELECT avg(age_at_biosample) AS m FROM labelled))
    UNION ALL
    SELECT variable, 'chi-square', CASE WHEN r > 1 AND c > 1 THEN CASE WHEN r = 2 AND c = 2
        THEN corrected ELSE plain END END, CAST((r - 1) * (c - 1) AS DOUBLE), NULL
    FROM (SELECT variable, count(DISTINCT stratum) AS r, count(DISTINCT level) AS c,
            sum((o - e) * (o - e) / e) AS plain,
            sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) AS corrected
          FROM (SELECT r.variable, r.stratum, c.level, coalesce(k.o, 0) AS o,
                  r.n * c.n / a.n AS e
                FROM (SELECT variable, stratum, CAST(count(*) AS DOUBLE) AS n FROM pairs
                      GROUP BY ALL) r
                JOIN (SELECT variable, level, CAST(count(*) AS DOUBLE) AS n FROM pairs
                      GROUP BY ALL) c ON r.variable = c.variable
                JOIN (SELECT variable, CAST(count(*) AS DOUBLE) AS n FROM pairs GROUP BY ALL) a
                  ON r.variable = a.variable
                LEFT JOIN (SELECT variable, stratum, level, count(*) AS o FROM pairs
                      GROUP BY ALL) k
                  ON k.variable = r.variable AND k.stratum = r.stratum AND k.level = c.level)
          GROUP BY variable)"""


@query(with_ctes(f"SELECT * REPLACE (round(statistic, 6) AS statistic) FROM ({_TESTS_SQL})",
                 "labelled", extra={"pairs": _TEST_PAIRS}))
def table_one_statistics(spark, sf_dir):
    """F and chi-square statistics with their degrees of freedom."""
    labelled = shared_study(spark, sf_dir).labelled
    tests = tables.anova(labelled, tables.CONTINUOUS, "case_or_ctrl").unionByName(
        tables.chi_square(labelled, tables.CATEGORICAL, "case_or_ctrl"))
    return tests.select("variable", "test", r6("statistic"), "df1", "df2")


@query(with_ctes(f"""SELECT variable, test, round(statistic, 6) AS statistic, df1, df2,
    round(p, 6) AS p_val, CASE WHEN p < 0.001 THEN '<0.001' WHEN p IS NOT NULL THEN printf('%.3f', p) END
      AS p_text FROM (SELECT *, {tail_sql("statistic", "df1", "df2")} AS p FROM ({_TESTS_SQL}))""",
                 "labelled", extra={"pairs": _TEST_PAIRS}))
def table_one_p(spark, sf_dir):
    """The same tests with their p values."""
    tests = tables.table_one_tests(shared_study(spark, sf_dir).labelled, "case_or_ctrl")
    return tests.select("variable", "test", r6("statistic"), "df1", "df2", r6("p_val"), "p_text")


# --- models ------------------------------------------------------------------------
def _coefficients(model):
    return model.select("term", F.round("estimate", 4).alias("estimate"),
                        F.round("std_error", 4).alias("std_error"),
                        F.round("z_value", 3).alias("z_value"))


def _flagged(spark, sf_dir):
    study = shared_study(spark, sf_dir)
    return models.case_flag(study.cohort, study.cases)


_GROUPS = """
    SELECT ancestry_pred, CAST(count(*) AS DOUBLE) AS n,
      CAST(count(*) FILTER (person_id IN (SELECT person_id FROM site)) AS DOUBLE) AS y
    FROM cohort WHERE ancestry_pred IS NOT NULL GROUP BY 1"""


@query(with_ctes("""
    SELECT '(Intercept)' AS term, round(ln(y / (n - y)), 4) AS estimate,
      round(sqrt(1 / y + 1 / (n - y)), 4) AS std_error,
      round(ln(y / (n - y)) / sqrt(1 / y + 1 / (n - y)), 3) AS z_value
    FROM groups WHERE ancestry_pred = (SELECT min(ancestry_pred) FROM groups)
    UNION ALL
    SELECT 'ancestry_pred_' || g.ancestry_pred, round(beta, 4), round(se, 4), round(beta / se, 3)
    FROM (SELECT g.ancestry_pred, ln(g.y / (g.n - g.y)) - ln(b.y / (b.n - b.y)) AS beta,
            sqrt(1 / g.y + 1 / (g.n - g.y) + 1 / b.y + 1 / (b.n - b.y)) AS se
          FROM groups g, (SELECT * FROM groups WHERE ancestry_pred =
            (SELECT min(ancestry_pred) FROM groups)) b
          WHERE g.ancestry_pred <> b.ancestry_pred) g""", "cohort", "site", extra={"groups": _GROUPS}))
def logistic_factor(spark, sf_dir):
    """One factor: the fit has a closed form, the log odds of its levels."""
    return _coefficients(models.logistic(_flagged(spark, sf_dir), "is_case", ["ancestry_pred"]))


@query(with_ctes("""
    SELECT CAST(n AS BIGINT) AS n, round(null_dev, 4) AS null_deviance,
      CAST(n - 1 AS BIGINT) AS null_df, round(res_dev, 4) AS residual_deviance,
      CAST(n - g AS BIGINT) AS residual_df, round(res_dev + 2 * g, 4) AS aic,
      TRUE AS converged, FALSE AS separated
    FROM (SELECT sum(n) AS n, count(*) AS g,
        -2 * (sum(y) * ln(sum(y) / sum(n)) + sum(n - y) * ln(sum(n - y) / sum(n))) AS null_dev,
        -2 * sum(CASE WHEN y > 0 THEN y * ln(y / n) ELSE 0 END
          + CASE WHEN n > y THEN (n - y) * ln((n - y) / n) ELSE 0 END) AS res_dev
      FROM groups)""", "cohort", "site", extra={"groups": _GROUPS}))
def logistic_statistics(spark, sf_dir):
    """Deviances and AIC of the one-factor fit, which have a closed form."""
    stats = models.fit_logistic(_flagged(spark, sf_dir), "is_case", ["ancestry_pred"]).statistics.drop("steps")
    return stats.withColumns({c: F.round(c, 4)
                              for c in ("null_deviance", "residual_deviance", "aic")})


@query(with_ctes("""
    SELECT term, round(estimate, 4) AS estimate, round(std_error, 4) AS std_error,
      round(estimate / std_error, 3) AS z_value
    FROM (SELECT '(Intercept)' AS term, b0 AS estimate, sqrt(h11 / det) AS std_error FROM info
      UNION ALL SELECT 'age_at_biosample', b1, sqrt(h00 / det) FROM info)""",
    "cohort", "site", extra={
        "points": """SELECT age_at_biosample AS x, CAST(count(*) AS DOUBLE) AS n,
            CAST(count(*) FILTER (person_id IN (SELECT person_id FROM site)) AS DOUBLE) AS y
            FROM cohort GROUP BY 1""",
        "newton": """
            SELECT 0 AS i, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1
            UNION ALL
            SELECT i + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01),
              b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
            FROM (SELECT i, b0, b1, sum(y - n * mu) AS g0, sum(x * (y - n * mu)) AS g1,
                    sum(n * mu * (1 - mu)) AS h00, sum(x * n * mu * (1 - mu)) AS h01,
                    sum(x * x * n * mu * (1 - mu)) AS h11
                  FROM (SELECT i, b0, b1, x, n, y, 1 / (1 + exp(-(b0 + b1 * x))) AS mu
                        FROM newton, points WHERE i < 25) GROUP BY i, b0, b1)""",
        "info": """SELECT b0, b1, h00, h11, h00 * h11 - h01 * h01 AS det FROM (
            SELECT b0, b1, sum(n * mu * (1 - mu)) AS h00, sum(x * n * mu * (1 - mu)) AS h01,
              sum(x * x * n * mu * (1 - mu)) AS h11
            FROM (SELECT b0, b1, x, n, 1 / (1 + exp(-(b0 + b1 * x))) AS mu
                  FROM newton, points WHERE i = 25) GROUP BY b0, b1)"""}))
def logistic_age(spark, sf_dir):
    """One number: checked against Newton steps in recursive SQL."""
    return _coefficients(models.logistic(_flagged(spark, sf_dir), "is_case", ["age_at_biosample"]))


_FIT_SQL = """SELECT term, round(estimate, 4) AS estimate, round(std_error, 4) AS std_error,
    round(estimate / std_error, 3) AS z_value FROM fit"""
_DEMOGRAPHICS = (("age_at_biosample",), ("sex_at_birth", "race", "ethnicity"))
_GENOMICS = (("age_at_biosample",), ("dragen_sex_ploidy", "ancestry_pred"))


@query(with_ctes(_FIT_SQL, "cohort", "site", extra=logistic_ctes(*_DEMOGRAPHICS)))
def logistic_demographics(spark, sf_dir):
    """Case flag on age, sex, race and ethnicity."""
    numbers, factors = _DEMOGRAPHICS
    return _coefficients(models.logistic(_flagged(spark, sf_dir), "is_case", [*numbers, *factors]))


@query(with_ctes(_FIT_SQL, "cohort", "site", extra=logistic_ctes(*_GENOMICS)))
def logistic_genomics(spark, sf_dir):
    """Case flag on age, ploidy and ancestry."""
    numbers, factors = _GENOMICS
    return _coefficients(models.logistic(_flagged(spark, sf_dir), "is_case", [*numbers, *factors]))
