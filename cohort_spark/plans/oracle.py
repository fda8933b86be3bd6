"""SQL twins of the stand-in tables and study steps, as named CTEs for DuckDB.

They are written from the definitions, not generated from the Spark plans, so
that a query and its SQL check each other.
"""

from __future__ import annotations

from cohort_spark import fixed_values as fixed
from cohort_spark.plans.stand_in import DISEASES, DRUGS, GENE, RATIO, SITE_PATTERN, TYPES


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def case_rules(col: str, rules, default: str = "nomatch") -> str:
    whens = " ".join(
        f"WHEN regexp_matches({col}, '{pattern}', 'i') THEN '{label}'" for pattern, label in rules)
    return f"CASE {whens} ELSE '{default}' END"


_BRAND = "CAST(string_split(p_brand, '#')[2] AS INTEGER)"
_DISEASE = (f"{_list(DISEASES)}[CAST(p_partkey % {len(DISEASES)} AS INTEGER) + 1] "
            "|| ', ' || lower(p_type)")
_SNOMED = (f"CAST(p_partkey % {len(DISEASES)} * 12 + list_position({_list(TYPES)}, p_type) * 2 "
           "+ p_size % 2 AS BIGINT)")


def _icd10(last: str, dot: str = ".") -> str:
    return (f"chr(65 + {_BRAND} % 5) || lpad(CAST(p_size % 10 AS VARCHAR), 2, '0') || '{dot}' "
            f"|| CAST({last} AS VARCHAR)")


def _icd9(last: str, dot: str = ".") -> str:
    return (f"CAST(100 + {_BRAND} % 5 * 10 + p_size % 10 AS VARCHAR) || '{dot}' "
            f"|| CAST({last} AS VARCHAR)")


def dotted_phecode() -> str:
    """The code by which the crosswalk lists a part, in its source spelling."""
    return _icd10("p_partkey % 2")


_CHANGE = ("p_brand || ':{}_' || p_partkey || ':exon' || p_size || ':c.' || p_partkey % 300 "
           "|| 'A>G:p.' || substr(p_type, 1, 1) || p_size || upper(substr(p_name, 1, 1))")
_LINES = ("lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey")

BINOM = """CASE WHEN 2 * greatest({x}, {n} - {x}) = {n} THEN 1.0 ELSE least(1.0, 2 * list_sum(
    list_transform(range(greatest({x}, {n} - {x}), {n} + 1), lambda k:
    exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) - {n} * ln(2.0))))) END"""

_STRATA = ("age_at_biosample", "dragen_sex_ploidy", "ancestry_pred")
_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in _STRATA)
_KEYS = ", ".join(_STRATA)


def _lab_rule(rule: fixed.LabRule) -> str:
    value = "lab_val"
    if rule.scale_unit:
        value = (f"CASE WHEN units = '{rule.scale_unit}' THEN "
                 f"lab_val / {rule.divide_by} * {rule.multiply_by} ELSE lab_val END")
    tests = [f"lab_name = '{rule.lab}'"]
    if rule.units_kept:
        tests.append(f"list_contains({_list(rule.units_kept)}, units)")
    tests += [f"units <> '{u}'" for u in rule.units_dropped]
    inner = (f"SELECT person_id, lab_name, {value} AS lab_val, units, measurement_datetime "
             f"FROM labs_filled WHERE {' AND '.join(tests)}")
    if rule.low is None:
        return inner
    return f"SELECT * FROM ({inner}) WHERE lab_val BETWEEN {rule.low} AND {rule.high}"


# name: (CTEs it reads, SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "demographics": ((), """
        SELECT c_custkey AS person_id,
          CASE WHEN c_custkey % 97 <> 5 THEN
            DATE '1964-01-15' + CAST(c_custkey * 7919 % 2200 AS INTEGER) END AS date_of_birth,
          CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS sex_at_birth,
          CASE WHEN c_custkey % 50 = 7 THEN 'Other' WHEN c_custkey % 2 = 0 THEN 'Woman'
            ELSE 'Man' END AS gender,
          c_mktsegment AS race,
          CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_acctbal > 5000 THEN 'Group A'
            ELSE 'Group B' END AS ethnicity
        FROM customer"""),
    "ancestry": ((), """
        SELECT c_custkey AS person_id,
          CASE WHEN c_custkey % 53 <> 3 THEN r_name END AS ancestry_pred
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey"""),
    "metrics": ((), """
        SELECT o_custkey AS person_id,
          CASE WHEN o_custkey % 31 = 0 THEN NULL WHEN o_custkey % 29 = 0 THEN 'XXY'
            WHEN o_custkey % 2 = 0 THEN 'XX' ELSE 'XY' END AS dragen_sex_ploidy,
          CAST(min(o_orderdate) AS DATE) AS biosample_collection_date
        FROM orders GROUP BY o_custkey"""),
    "aged": (("demographics", "ancestry", "metrics"), """
        SELECT d.*, ancestry_pred, dragen_sex_ploidy, biosample_collection_date,
          year(biosample_collection_date) - year(date_of_birth)
            - CASE WHEN date_of_birth + to_years(CAST(year(biosample_collection_date)
              - year(date_of_birth) AS INTEGER)) > biosample_collection_date
              THEN 1 ELSE 0 END AS whole
        FROM demographics d LEFT JOIN ancestry USING (person_id) LEFT JOIN metrics USING (person_id)
        WHERE date_of_birth IS NOT NULL AND biosample_collection_date IS NOT NULL"""),
    "cohort": (("aged",), """
        SELECT * EXCLUDE (whole, age), age AS age_at_biosample,
          round_even(age, -1) AS decade_at_biosample
        FROM (SELECT *, round_even(whole
            + date_diff('day', date_of_birth + to_years(CAST(whole AS INTEGER)),
                CAST(biosample_collection_date AS TIMESTAMP))
            / date_diff('day', date_of_birth + to_years(CAST(whole AS INTEGER)),
                date_of_birth + to_years(CAST(whole + 1 AS INTEGER))), 0) AS age
          FROM aged)"""),
    "calls": ((), f"""
        SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS sample,
          CAST(p_partkey AS INTEGER) AS pos,
          CASE WHEN l_linestatus = 'O' THEN 'G' ELSE 'T' END AS alt,
          CASE WHEN l_linenumber = 7 THEN 'splicing' ELSE 'exonic' END AS func,
          p_brand AS gene,
          CASE WHEN l_linenumber <> 7 THEN {_CHANGE.format('NM')} || CASE WHEN p_partkey % 5 = 0
            THEN ',' || {_CHANGE.format('XM')} ELSE '' END END AS aa_change,
          CASE WHEN p_partkey % 3 = 0 THEN 'COSM' || p_partkey END AS cosmic70,
          CAST(trunc(l_quantity) AS INTEGER) AS dp, l_linenumber AS min_ad,
          CAST(trunc(l_quantity) AS INTEGER) - l_linenumber AS max_ad,
          CAST(round(l_discount * 100) AS INTEGER) AS f1, CAST(round(l_tax * 100) AS INTEGER) AS f2,
          CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE CAST('0.' || lpad(CAST(CAST(floor(
            100.0 * l_linenumber / trunc(l_quantity)) AS BIGINT) AS VARCHAR), 2, '0') AS DOUBLE)
            END AS af
        FROM {_LINES}"""),
    "tested": (("calls",), f"""
        SELECT CAST(regexp_extract(sample, '(\\d+)', 1) AS BIGINT) AS person_id, pos, alt, func,
          gene AS gene_name, aa_change, cosmic70, dp, max_ad, min_ad, af,
          {BINOM.format(x="max_ad", n="(max_ad + min_ad)")} AS binom_p_val
        FROM calls WHERE dp >= 20 AND min_ad >= 3 AND f1 > 0 AND min_ad > 0 AND f2 > 0"""),
    "passing": (("tested", "cohort"), f"""
        SELECT t.*, c.* EXCLUDE (person_id) FROM tested t JOIN cohort c USING (person_id)
        WHERE gene_name = '{GENE}' AND (dragen_sex_ploidy = 'XY' OR binom_p_val < 0.01)"""),
    "split": (("passing",), """
        SELECT * EXCLUDE (f), f[1] AS gene_name1, f[2] AS transcript1, f[3] AS exon1,
          f[4] AS dna1, f[5] AS protein1, f[6] AS gene_name2, f[7] AS transcript2,
          f[8] AS exon2, f[9] AS dna2, f[10] AS protein2
        FROM (SELECT *, string_split_regex(aa_change, ':|,') AS f FROM passing)"""),
    "site": (("split",), f"SELECT * FROM split WHERE regexp_matches(protein1, '{SITE_PATTERN}')"),
    "demand": (("site",), f"""
        SELECT {_KEYS}, count(*) AS num_cases, {RATIO} * count(*) AS num_controls_needed
        FROM site GROUP BY {_KEYS}"""),
    "pool": (("cohort", "passing"), f"""
        SELECT person_id, {_KEYS} FROM cohort
        WHERE person_id NOT IN (SELECT person_id FROM passing)"""),
    "controls": (("pool", "demand"), f"""
        SELECT a.person_id, {", ".join("a." + c for c in _STRATA)}
        FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS}
              ORDER BY md5('1:' || person_id), person_id) AS rank FROM pool) a
        JOIN demand b ON {_SAME} AND rank <= num_controls_needed"""),
    "arms": (("site", "controls"), """
        SELECT person_id, bool_or(is_case) AS is_case FROM (
          SELECT person_id, TRUE AS is_case FROM site
          UNION ALL SELECT person_id, FALSE FROM controls) GROUP BY person_id"""),
    "labelled": (("cohort", "arms"), """
        SELECT c.*, CASE
          WHEN is_case AND dragen_sex_ploidy = 'XY' THEN 'case_male'
          WHEN is_case AND dragen_sex_ploidy = 'XX' THEN 'case_female'
          WHEN NOT is_case AND dragen_sex_ploidy = 'XY' THEN 'ctrl_male'
          WHEN NOT is_case AND dragen_sex_ploidy = 'XX' THEN 'ctrl_female'
          ELSE 'nomatch' END AS case_or_ctrl
        FROM cohort c JOIN arms USING (person_id)"""),
    "arm_n": (("arms",), """
        SELECT count(*) FILTER (is_case) AS n_case, count(*) FILTER (NOT is_case) AS n_control
        FROM arms"""),
    # --- labs ---
    "labs": ((), """
        SELECT user_id AS person_id,
          CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'Leukocytes [#/volume] in Blood'
            WHEN event_type = 'click' THEN 'Lymphocytes/100 leukocytes in Blood'
            WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'Hemoglobin [Mass/volume] in Blood'
            WHEN event_type = 'error' THEN 'Platelets [#/volume] in Blood'
            WHEN event_type = 'purchase' THEN 'MCV [Entitic volume] by Automated count'
            WHEN event_type = 'signup' THEN 'Erythrocyte sedimentation rate'
            WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'C reactive protein [Mass/volume]'
            WHEN event_type = 'view' THEN 'Sodium [Moles/volume] in Serum' END
            AS standard_concept_name,
          CASE WHEN event_id % 101 = 0 THEN 1e7 WHEN event_id % 103 = 0 THEN NULL
            WHEN event_id % 107 = 0 THEN 0.0 ELSE value END AS value_as_number,
          CASE event_id % 8 WHEN 1 THEN 'per cubic millimeter' WHEN 2 THEN 'percent'
            WHEN 3 THEN 'gram per liter' WHEN 4 THEN 'mmol/h' WHEN 5 THEN 'milligram per deciliter'
            WHEN 6 THEN 'mg/L' WHEN 7 THEN 'Percent' END AS unit_concept_name,
          ts AS measurement_datetime
        FROM events"""),
    "labs_named": (("labs",), f"""
        SELECT person_id, {case_rules("standard_concept_name", fixed.LAB_NAME_RULES)} AS lab_name,
          value_as_number AS lab_val, standard_concept_name, unit_concept_name AS units,
          measurement_datetime
        FROM labs WHERE value_as_number IS NOT NULL AND value_as_number NOT IN (0, 1e7, 1e8)"""),
    "labs_filled": (("labs_named",), """
        SELECT * REPLACE (coalesce(units, 'nounit') AS units) FROM labs_named"""),
    "lab_values": (("labs_filled",), " UNION ALL ".join(map(_lab_rule, fixed.LAB_RULES))),
    # --- diagnoses ---
    "dx": ((), f"""
        SELECT o_custkey AS person_id, {_DISEASE} AS standard_concept_name,
          {_SNOMED} AS standard_concept_code, o_orderdate AS condition_start_datetime,
          ['ICD10CM', 'ICD9CM', 'SNOMED'][CAST(p_partkey % 3 AS INTEGER) + 1] AS source_vocabulary,
          CASE p_partkey % 3 WHEN 0 THEN {_icd10("p_partkey % 2")}
            WHEN 1 THEN {_icd9("p_partkey % 2")}
            ELSE CAST({_SNOMED} AS VARCHAR) END AS source_concept_code,
          CASE WHEN p_partkey % 101 = 0 THEN NULL
            WHEN p_partkey % 3 = 0 THEN 'Condition ' || {_icd10("p_partkey % 2")}
              || CASE WHEN p_partkey % 7 = 0 THEN ' NOS' ELSE '' END
            ELSE {_DISEASE} END AS source_concept_name
        FROM {_LINES}"""),
    "study_dx": (("dx", "arms"), """
        SELECT person_id, CASE WHEN is_case THEN 'case' ELSE 'control' END AS case_or_control,
          standard_concept_name AS snomed_name, standard_concept_code AS snomed_code,
          condition_start_datetime, source_vocabulary, source_concept_code, source_concept_name
        FROM dx JOIN arms USING (person_id)"""),
    "terms": (("study_dx",), "SELECT DISTINCT * EXCLUDE (condition_start_datetime) FROM study_dx"),
    "gem": ((), f"""
        SELECT DISTINCT {_icd10("(p_partkey + p_size) % 2", "")} AS icd10cm,
          {_icd9("p_partkey % 2", "")} AS icd9cm FROM part"""),
    "crosswalk": (("gem",), "SELECT icd9cm AS icd9_code, min(icd10cm) AS icd10_code FROM gem "
                            "GROUP BY icd9cm"),
    "snomed_map": ((), f"""
        SELECT id, map_group, map_priority, max(name) AS name, min(target) AS target
        FROM (SELECT {_SNOMED} AS id, 1 + {_BRAND} % 2 AS map_group, 1 + p_size % 2 AS map_priority,
          {_DISEASE} || CASE WHEN p_size % 9 = 0 THEN ' (disorder)' ELSE '' END AS name,
          {_icd10("p_partkey % 2")} AS target FROM part)
        GROUP BY ALL"""),
    "icd10_names": (("terms",), """
        SELECT DISTINCT regexp_replace(source_concept_code, '\\.', '') AS icd10_code,
          source_concept_name AS icd10_name
        FROM terms WHERE source_vocabulary = 'ICD10CM'"""),
    "from_icd9": (("terms", "crosswalk", "icd10_names"), """
        SELECT t.*, regexp_replace(source_concept_code, '\\.', '') AS icd9_dot_removed,
          x.icd10_code, icd10_name
        FROM terms t JOIN crosswalk x
          ON regexp_replace(source_concept_code, '\\.', '') = x.icd9_code
        JOIN icd10_names n ON n.icd10_code = x.icd10_code
        WHERE source_vocabulary = 'ICD9CM'"""),
    "from_snomed": (("terms", "snomed_map"), """
        SELECT t.* EXCLUDE (source_concept_code),
          CAST(source_concept_code AS DOUBLE) AS source_concept_code,
          target AS icd_code, 'Condition ' || target AS icd_name, m.name AS map_name
        FROM terms t JOIN snomed_map m ON t.snomed_code = m.id
        WHERE source_vocabulary = 'SNOMED' AND map_group = 1 AND map_priority = 1"""),
    "icd10_rows": (("terms", "from_icd9", "from_snomed"), """
        SELECT person_id, case_or_control, regexp_replace(icd10_code, '\\.', '') AS icd10_code,
          icd10_name
        FROM (SELECT person_id, case_or_control, source_concept_code AS icd10_code,
                source_concept_name AS icd10_name FROM terms WHERE source_vocabulary = 'ICD10CM'
          UNION ALL SELECT person_id, case_or_control, icd10_code, icd10_name FROM from_icd9
          UNION ALL SELECT person_id, case_or_control, icd_code, icd_name FROM from_snomed)"""),
    "phecode_parts": ((), f"""
          SELECT *, CAST({_BRAND} % 5 * 100 + p_size % 10 AS VARCHAR) AS phecode,
            'Phenotype ' || {_BRAND} % 5 || '-' || p_size % 10 AS phecode_str FROM part
          UNION ALL
          SELECT *, CAST({_BRAND} % 5 * 100 + 99 AS VARCHAR),
            'Phenotype group ' || {_BRAND} % 5 FROM part WHERE p_size % 10 < 4"""),
    "phecodes": (("phecode_parts",), f"""
        SELECT DISTINCT {_icd10("p_partkey % 2", "")} AS icd10_code, phecode, phecode_str
        FROM phecode_parts"""),
    "manifestations": (("study_dx",), f"""
        SELECT * FROM (SELECT DISTINCT person_id, case_or_control, snomed_name, snomed_code,
          {case_rules("snomed_name", fixed.MANIFESTATION_RULES)} AS manifestation FROM study_dx)
        WHERE manifestation <> 'nomatch'"""),
    "meds": ((), f"""
        SELECT o_custkey AS person_id,
          CASE WHEN p_partkey % 89 <> 0 THEN
            {_list(DRUGS)}[CAST(p_partkey % {len(DRUGS)} AS INTEGER) + 1] || ' ' || p_size || ' MG'
            END AS standard_concept_name,
          l_shipdate AS drug_exposure_start
        FROM {_LINES}"""),
    "med_rows": (("meds", "arms"), f"""
        SELECT * EXCLUDE (rn) FROM (
          SELECT *, row_number() OVER (PARTITION BY person_id, med_type
            ORDER BY drug_exposure_start NULLS LAST, standard_concept_name NULLS LAST) AS rn
          FROM (SELECT person_id, standard_concept_name, drug_exposure_start,
              CASE WHEN is_case THEN 'case' ELSE 'control' END AS case_or_control,
              {case_rules("standard_concept_name", fixed.MEDICATION_RULES)} AS med_type
            FROM meds JOIN arms USING (person_id)) WHERE med_type <> 'nomatch')
        WHERE rn = 1"""),
}


def with_ctes(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``body`` after the named CTEs and everything they read."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for parent in CTES[name][0]:
            visit(parent)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{name} AS ({CTES[name][1]})" for name in ordered]
    parts += [f"{name} AS ({sql})" for name, sql in (extra or {}).items()]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + body


# --- exact 2x2 tests ------------------------------------------------------------
_CELLS = """SELECT *, case_w + case_wo AS m, control_w + control_wo AS n,
    case_w + control_w AS k, row_number() OVER () AS id FROM counts"""
_SUPPORT = """SELECT *, greatest(0, k - n) AS lo, least(k, m) AS hi,
    list_transform(range(greatest(0, k - n), least(k, m) + 1), lambda v: CAST(v AS DOUBLE)) AS vs,
    list_transform(range(greatest(0, k - n), least(k, m) + 1), lambda v:
      lgamma(m + 1) - lgamma(v + 1) - lgamma(m - v + 1) + lgamma(n + 1) - lgamma(k - v + 1)
      - lgamma(n - k + v + 1) - lgamma(m + n + 1) + lgamma(k + 1) + lgamma(m + n - k + 1)) AS lw
    FROM cells"""
_P = """least(1.0, list_sum(list_transform(lw, lambda w:
    CASE WHEN w <= lw[CAST(case_w - lo + 1 AS INTEGER)] + ln(1 + 1e-7) THEN exp(w) ELSE 0 END)))"""

_STEPS = """
    SELECT 0 AS i, id, kind, CAST(-40 AS DOUBLE) AS a, CAST(40 AS DOUBLE) AS b FROM support, (VALUES (1), (2), (3)) t(kind)
    UNION ALL
    SELECT i + 1, id, kind, CASE WHEN gap < 0 THEN mid ELSE a END,
      CASE WHEN gap < 0 THEN b ELSE mid END
    FROM (SELECT i, id, kind, a, b, mid, CASE kind
            WHEN 1 THEN list_dot_product(ws, vs) / list_sum(ws) - case_w
            WHEN 2 THEN list_sum(list_transform(list_zip(vs, ws), lambda t:
              CASE WHEN t[1] >= case_w THEN t[2] ELSE 0 END)) / list_sum(ws) - 0.025
            ELSE 0.025 - list_sum(list_transform(list_zip(vs, ws), lambda t:
              CASE WHEN t[1] <= case_w THEN t[2] ELSE 0 END)) / list_sum(ws) END AS gap
          FROM (SELECT *, list_transform(ls, lambda w: exp(w - top)) AS ws
                FROM (SELECT *, list_max(ls) AS top
                      FROM (SELECT s.i, s.id, s.kind, s.a, s.b, (s.a + s.b) / 2 AS mid, vs, case_w,
                              list_transform(list_zip(vs, lw), lambda t:
                                t[2] + t[1] * (s.a + s.b) / 2) AS ls
                            FROM steps s JOIN support USING (id) WHERE s.i < 60))))"""


def scan_sql(counts: str, keys: str, *names: str, top: str = "", limit: int | None = None,
             tests: bool = True, digits: int = 6, wrap: str = "SELECT * FROM scan") -> str:
    """A scan over a ``counts`` query that gives ``keys``, case_w and control_w.

    With ``top``, the ``limit`` smallest p, unrounded, then in the order of those columns.
    """
    p = f"round({_P}, {digits}) AS p_val"
    if top:
        p = f"CAST(printf('%.6e', {_P}) AS DOUBLE) AS p_val, CAST(printf('%.9e', {_P}) AS DOUBLE) AS p_rank"
        wrap = "SELECT * EXCLUDE (p_rank) FROM scan"
    full = {
        "counted": counts,
        "counts": "SELECT c.*, n_case - case_w AS case_wo, n_control - control_w AS control_wo "
                  "FROM counted c, arm_n",
        "cells": _CELLS, "support": _SUPPORT,
    }
    cols = f"{keys}, case_w, control_w, case_wo, control_wo"
    if not tests:
        full["scan"] = f"SELECT {cols}, {p} FROM support"
    else:
        full["steps"] = _STEPS
        full["roots"] = """SELECT id, max(CASE WHEN kind = 1 THEN exp((a + b) / 2) END) AS r1,
            max(CASE WHEN kind = 2 THEN exp((a + b) / 2) END) AS r2,
            max(CASE WHEN kind = 3 THEN exp((a + b) / 2) END) AS r3
            FROM steps WHERE i = 60 GROUP BY id"""
        inf = "CAST('inf' AS DOUBLE)"
        full["scan"] = f"""SELECT {cols},
            round(CASE WHEN case_w = lo THEN 0 WHEN case_w = hi THEN {inf} ELSE r1 END, {digits})
              AS odds_ratio,
            round(CASE WHEN case_w = lo THEN 0 ELSE r2 END, {digits}) AS or_low,
            round(CASE WHEN case_w = hi THEN {inf} ELSE r3 END, {digits}) AS or_hi,
            {p}
            FROM support JOIN roots USING (id)"""
    tail = f" ORDER BY p_rank, {top} LIMIT {limit}" if top else ""
    return with_ctes(wrap + tail, "arm_n", *names, extra=full)


# --- logistic regression ------------------------------------------------------
_INVERSE = """list_reduce(
    list_prepend(h, list_transform(range(1, len(h) + 1), lambda k: [[CAST(k AS DOUBLE)]])),
    lambda m, e: list_transform(m, lambda r, i: CASE WHEN i = CAST(e[1][1] AS INTEGER)
      THEN list_transform(r, lambda v: v / r[CAST(e[1][1] AS INTEGER)])
      ELSE list_transform(r, lambda v, j: v - r[CAST(e[1][1] AS INTEGER)]
        * m[CAST(e[1][1] AS INTEGER)][j] / m[CAST(e[1][1] AS INTEGER)][CAST(e[1][1] AS INTEGER)])
      END))"""


def _sums(states: str) -> str:
    """Information (beside a unit matrix, for its inverse) and gradient at each state's beta."""
    return f"""
        SELECT i, beta, list(row ORDER BY a) AS h, list(g ORDER BY a) AS g FROM (
          SELECT i, beta, a, any_value(g) AS g,
            list(v ORDER BY b) || list(CAST(a = b AS DOUBLE) ORDER BY b) AS row FROM (
              SELECT i, beta, a, b, sum(x[a] * x[b] * n * mu * (1 - mu)) AS v,
                sum(x[a] * (y - n * mu)) AS g
              FROM (SELECT i, beta, x, n, y, 1 / (1 + exp(-list_dot_product(x, beta))) AS mu
                    FROM {states}, points) s, places pa(a), places pb(b)
              GROUP BY i, beta, a, b) GROUP BY i, beta, a) GROUP BY i, beta"""


def logistic_ctes(numbers: tuple[str, ...], factors: tuple[str, ...], steps: int = 15) -> dict[str, str]:
    """Newton steps for any number of terms in recursive SQL: the CTE ``fit`` (term, estimate, std_error)."""
    used = ", ".join((*numbers, *factors))
    there = " AND ".join(f"{c} IS NOT NULL" for c in (*numbers, *factors))
    levels = ", ".join(f"list(DISTINCT {c} ORDER BY {c})[2:] AS {c}_levels" for c in factors)
    coded = " || ".join(f"list_transform({c}_levels, lambda v: CAST(v = {c} AS DOUBLE))" for c in factors)
    named = " || ".join(f"list_transform({c}_levels, lambda v: '{c}_' || v)" for c in factors)
    ones = ", ".join(["CAST(1 AS DOUBLE)", *[f"CAST({c} AS DOUBLE)" for c in numbers]])
    words = ", ".join(f"'{c}'" for c in ("(Intercept)", *numbers))
    return {
        "whole": f"""SELECT {used}, person_id IN (SELECT person_id FROM site) AS is_case
            FROM cohort WHERE {there}""",
        "levels": f"SELECT {levels} FROM whole",
        "points": f"""SELECT x, CAST(count(*) AS DOUBLE) AS n,
            CAST(count(*) FILTER (is_case) AS DOUBLE) AS y
            FROM (SELECT [{ones}] || {coded} AS x, is_case FROM whole, levels) GROUP BY x""",
        "names": f"SELECT [{words}] || {named} AS names FROM levels",
        "places": "SELECT unnest(range(1, len(names) + 1)) AS p FROM names",
        "newton": f"""
            SELECT 0 AS i, list_transform(names, lambda w: CAST(0 AS DOUBLE)) AS beta FROM names
            UNION ALL
            SELECT i + 1, list_transform(beta, lambda v, k:
              v + list_dot_product(({_INVERSE})[k][len(beta) + 1:], g))
            FROM ({_sums(f"(SELECT * FROM newton WHERE i < {steps})")})""",
        "fit": f"""SELECT unnest(names) AS term, unnest(beta) AS estimate,
              unnest(list_transform(inverse, lambda r, k: sqrt(r[len(beta) + k]))) AS std_error
            FROM (SELECT beta, {_INVERSE} AS inverse
                  FROM ({_sums(f"(SELECT * FROM newton WHERE i = {steps})")})), names"""}


# --- tails of the chi-square and F distributions --------------------------------
def _inwards(terms: str, start: str, step: str) -> str:
    """``step`` of acc and j for j from ``terms`` down to 1."""
    return (f"list_reduce(list_prepend(CAST({start} AS DOUBLE), list_transform(range(CAST({terms} AS BIGINT), 0, -1), "
            f"lambda k: CAST(k AS DOUBLE))), lambda acc, j: {step})")


def _gamma_sql(s: str, x: str) -> str:
    terms = f"(ceil(10 * sqrt({s})) + 100)"
    front = f"exp({s} * ln({x}) - {x} - lgamma({s}))"
    series = _inwards(terms, "1", f"1 + acc * {x} / ({s} + j)")
    fraction = _inwards(terms, f"{x} + 2 * {terms} + 1 - {s}",
                        f"{x} + 2 * j - 1 - {s} - j * (j - {s}) / acc")
    return (f"CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} < {s} + 1 THEN 1 - {front} / {s} * {series} "
            f"ELSE {front} / {fraction} END")


def _beta_sql(a: str, b: str, x: str) -> str:
    step = (f"1 - ({a} + j - 1) * ({a} + {b} + j - 1) * {x} / (({a} + 2 * j - 2) * ({a} + 2 * j - 1)) "
            f"/ (1 + j * ({b} - j) * {x} / (({a} + 2 * j - 1) * ({a} + 2 * j)) / acc)")
    return (f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x})) / {a} / "
            + _inwards(f"(ceil(10 * sqrt(greatest({a}, {b}))) + 100)", "1", step))


def tail_sql(statistic: str, df1: str, df2: str) -> str:
    """P(F > statistic), or P(chi-square > statistic) where the second degrees of freedom are NULL."""
    a, b, x = f"({df2} / 2)", f"({df1} / 2)", f"({df2} / ({df2} + {df1} * {statistic}))"
    return (f"CASE WHEN {statistic} IS NULL OR {df1} <= 0 THEN NULL "
            f"WHEN {df2} IS NULL THEN {_gamma_sql(b, f'({statistic} / 2)')} "
            f"WHEN {x} >= 1 THEN 1.0 WHEN {x} > ({a} + 1) / ({a} + {b} + 2) THEN 1 - {_beta_sql(b, a, f'(1 - {x})')} "
            f"ELSE {_beta_sql(a, b, x)} END")
