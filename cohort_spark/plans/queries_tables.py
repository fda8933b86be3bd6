"""Projections, filters, joins, aggregates, sorts and text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort_spark import fixed_values as fixed
from cohort_spark.functions import (
    classify,
    first_field,
    first_integer,
    first_number,
    is_in,
    matches,
    matches_ci,
    missing_to,
    n_unique,
    not_in,
    remove_first,
    split_fields,
    to_number,
    year_of,
)
from cohort_spark.operators import aggregates as agg
from cohort_spark.operators.columns import drop_prefix, for_person, select_prefix
from cohort_spark.operators.joins import anti, flag_in, join_on, natural_join, semi
from cohort_spark.operators.ranking import id_pages
from cohort_spark.operators.sets import bind_rows, key_union
from cohort_spark.plans import stand_in
from cohort_spark.plans.oracle import case_rules, with_ctes
from cohort_spark.plans.registry import query, r6
from cohort_spark.plans.stand_in import table
from cohort_spark.sources.people import by_person


# --- projections and filters ---------------------------------------------------
@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority,
          year(o_orderdate) AS placed_year FROM orders""")
def prefix_columns(spark, sf_dir):
    """Columns kept and dropped by name prefix, plus the year of a date."""
    orders = drop_prefix(table(spark, sf_dir, "orders"), "o_total")
    return (select_prefix(orders, "o_order", "o_cust")
            .withColumn("placed_year", year_of(F.col("o_orderdate")).cast("bigint")))


@query("""SELECT l_orderkey AS order_id, l_linenumber AS line, round(l_quantity / 10, 6) AS tens,
          round(l_quantity / 10 * (1 - l_discount), 6) AS net_tens
          FROM lineitem WHERE l_quantity BETWEEN 10 AND 40 AND l_discount > 0
          AND l_returnflag = 'R'""")
def derived_filter(spark, sf_dir):
    """Derived columns in sequence under a filter in which all must hold."""
    lines = table(spark, sf_dir, "lineitem").filter(
        F.col("l_quantity").between(10, 40) & (F.col("l_discount") > 0)
        & (F.col("l_returnflag") == "R"))
    return (lines.withColumn("tens", F.col("l_quantity") / 10)
            .withColumn("net_tens", F.col("tens") * (1 - F.col("l_discount")))
            .select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
                    r6("tens"), r6("net_tens")))


_KNOWN_UNITS = ("percent", "Percent", "mg/L")


@query(with_ctes("""
    SELECT person_id, coalesce(unit_concept_name, 'nounit') AS units,
      coalesce(unit_concept_name IN ('percent', 'Percent', 'mg/L'), FALSE) AS known_unit,
      NOT coalesce(unit_concept_name IN ('percent', 'Percent', 'mg/L'), FALSE) AS other_unit,
      CASE WHEN value_as_number IS NULL THEN 'missing' ELSE 'given' END AS state,
      value_as_number
    FROM labs WHERE unit_concept_name = 'mmol/h' OR value_as_number < 10
      OR value_as_number IS NULL""", "labs"))
def null_rules(spark, sf_dir):
    """OR with missing operands, membership that is never NULL, missing to label."""
    unit, value = F.col("unit_concept_name"), F.col("value_as_number")
    return (stand_in.labs(spark, sf_dir)
            .filter((unit == "mmol/h") | (value < 10) | value.isNull())
            .select("person_id", missing_to(unit, "nounit").alias("units"),
                    is_in(unit, _KNOWN_UNITS).alias("known_unit"),
                    not_in(unit, _KNOWN_UNITS).alias("other_unit"),
                    F.when(value.isNull(), "missing").otherwise("given").alias("state"),
                    "value_as_number"))


_TEXT_RULES = (("license|copyright", "licence"), ("@[a-z]+", "contact"), ("https?://", "link"),
               (" the ", "english"), (" der | die ", "german"), ("[0-9]{3}", "figures"))


@query(f"""SELECT lang, label, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (
       SELECT lang, n_chars, {case_rules("text", _TEXT_RULES)} AS label FROM documents)
       GROUP BY ALL""")
def classify_documents(spark, sf_dir):
    """Ordered rules, case ignored, over whole document texts."""
    documents = table(spark, sf_dir, "documents")
    return (documents.select("lang", "n_chars", classify(F.col("text"), _TEXT_RULES).alias("label"))
            .groupBy("lang", "label")
            .agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")))


# --- text ----------------------------------------------------------------------
@query("""SELECT c_custkey, CAST(regexp_extract(c_name, '(\\d+)', 1) AS BIGINT) AS person_id,
          CAST(c_nationkey AS DOUBLE) / 10 AS first_num,
          TRY_CAST(c_mktsegment AS DOUBLE) AS no_number,
          CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE) AS balance,
          regexp_matches(c_name, '1[0-9]5') AS hit,
          regexp_matches(c_name, 'CUSTOMER', 'i') AS hit_any_case FROM customer""")
def parse_ids(spark, sf_dir):
    """Ids and numbers inside text, lenient where there is none."""
    name = F.col("c_name")
    tagged = F.concat(F.lit("n = "), (F.col("c_nationkey") / 10).cast("string"), F.lit(" (est.)"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", first_integer(name).alias("person_id"),
        first_number(tagged).alias("first_num"),
        to_number(F.col("c_mktsegment")).alias("no_number"),
        to_number(F.col("c_acctbal").cast("string")).alias("balance"),
        matches(name, "1[0-9]5").alias("hit"), matches_ci(name, "CUSTOMER").alias("hit_any_case"))


@query("""SELECT event_id, regexp_replace(kind, '\\.', '') AS dot_free,
          string_split(kind, '.')[1] AS base, kind || ' ( ' || user_id || ' )' AS label
          FROM (SELECT event_id, user_id, event_type || '.' || event_id % 7 || '.' || event_id % 3
          AS kind FROM events)""")
def code_text(spark, sf_dir):
    """First dot removed, text before it, and assembled labels."""
    kind = F.concat_ws(".", "event_type", F.col("event_id") % 7, F.col("event_id") % 3)
    return (table(spark, sf_dir, "events").withColumn("kind", kind)
            .select("event_id", remove_first(F.col("kind"), ".").alias("dot_free"),
                    first_field(F.col("kind")).alias("base"),
                    F.format_string("%s ( %d )", "kind", "user_id").alias("label")))


@query("""SELECT p_partkey, f[1] AS a, f[2] AS b, f[3] AS c, f[4] AS d FROM (
          SELECT p_partkey, string_split_regex(CASE WHEN p_size % 2 = 0
            THEN p_name || ':' || p_type ELSE p_name END, ' |:') AS f FROM part)""")
def split_names(spark, sf_dir):
    """One column split at a regex into fixed columns, short rows filled."""
    text = F.when(F.col("p_size") % 2 == 0, F.concat_ws(":", "p_name", "p_type")).otherwise(
        F.col("p_name"))
    return split_fields(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")),
                        "text", " |:", ["a", "b", "c", "d"])


# --- joins ---------------------------------------------------------------------
def _returners(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 48")
    orders = table(spark, sf_dir, "orders")
    return (semi(orders, lines, "o_orderkey", "l_orderkey").select("o_custkey"))


_RETURNERS = """(SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem
    WHERE l_returnflag = 'R' AND l_quantity >= 48))"""


@query(f"SELECT * FROM customer WHERE c_custkey IN {_RETURNERS}")
def semi_cases(spark, sf_dir):
    return semi(table(spark, sf_dir, "customer"), _returners(spark, sf_dir),
                "c_custkey", "o_custkey")


@query(f"SELECT * FROM customer WHERE c_custkey NOT IN {_RETURNERS}")
def anti_cases(spark, sf_dir):
    return anti(table(spark, sf_dir, "customer"), _returners(spark, sf_dir),
                "c_custkey", "o_custkey")


@query(f"SELECT c_custkey, c_mktsegment, c_custkey IN {_RETURNERS} AS is_case FROM customer")
def flag_cases(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return flag_in(people, _returners(spark, sf_dir), "c_custkey", "is_case", "o_custkey")


@query(with_ctes("""
    SELECT c.ancestry_pred, c.dragen_sex_ploidy, count(*) AS n, count(label) AS n_matched
    FROM (SELECT person_id, ancestry_pred, dragen_sex_ploidy FROM cohort) c
    LEFT JOIN (SELECT ancestry_pred, dragen_sex_ploidy, 'stratum ' || count(*) AS label
      FROM cohort WHERE race <> 'MACHINERY' GROUP BY ALL) s
    ON c.ancestry_pred IS NOT DISTINCT FROM s.ancestry_pred
      AND c.dragen_sex_ploidy IS NOT DISTINCT FROM s.dragen_sex_ploidy
    GROUP BY ALL""", "cohort"))
def natural_left_join(spark, sf_dir):
    """Left join on all common columns, a missing key matching a missing key."""
    from cohort_spark.operators.cohort import build_cohort
    cohort = build_cohort(stand_in.demographics(spark, sf_dir), stand_in.ancestry(spark, sf_dir),
                          stand_in.metrics(spark, sf_dir))
    keys = ["ancestry_pred", "dragen_sex_ploidy"]
    strata = (cohort.filter("race <> 'MACHINERY'").groupBy(*keys)
              .agg(F.concat(F.lit("stratum "), F.count("*")).alias("label")))
    return (natural_join(cohort.select("person_id", *keys), strata).groupBy(*keys)
            .agg(F.count("*").alias("n"), F.count("label").alias("n_matched")))


@query("""SELECT l_orderkey, l_linenumber, o_custkey, o_orderpriority, l_suppkey, s_name
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          JOIN supplier ON l_suppkey = s_suppkey""")
def named_key_join(spark, sf_dir):
    """Inner joins on differently named keys; the left name stays."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    joined = join_on(lines, orders, {"l_orderkey": "o_orderkey"}, null_safe=False)
    return join_on(joined, supplier, {"l_suppkey": "s_suppkey"}, null_safe=False,
                   relationship="many-to-one")


# --- aggregates ----------------------------------------------------------------
@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC")
def count_flags(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return (agg.count_by(lines, "l_returnflag", "l_linestatus")
            .orderBy(F.desc("n"), "l_returnflag", "l_linestatus"))


@query("""SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high,
          round_even(avg(value), 1) AS mean, round_even(stddev_samp(value), 1) AS sd,
          CAST(count(*) FILTER (value > 50) AS BIGINT) AS n_high,
          count(DISTINCT user_id) AS n_users FROM events GROUP BY 1""")
def event_summary(spark, sf_dir):
    mean, sd = agg.mean_sd(F.col("value"), 1)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        mean.alias("mean"), sd.alias("sd"), F.count_if(F.col("value") > 50).alias("n_high"),
        n_unique(F.col("user_id")).alias("n_users"))


@query(with_ctes("""
    SELECT count(DISTINCT ethnicity) + CAST(max(CASE WHEN ethnicity IS NULL THEN 1 ELSE 0 END)
      AS BIGINT) AS n_ethnicity, min(age_at_biosample) AS low, max(age_at_biosample) AS high
    FROM cohort""", "cohort"))
def cohort_range(spark, sf_dir):
    """Distinct values with missing as one, and the range of the age."""
    from cohort_spark.plans.registry import shared_study
    return shared_study(spark, sf_dir).cohort.agg(
        n_unique(F.col("ethnicity")).alias("n_ethnicity"),
        F.min("age_at_biosample").alias("low"), F.max("age_at_biosample").alias("high"))


@query("""SELECT o_custkey, count(DISTINCT p_name) AS n_names FROM lineitem
          JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def codes_per_person(spark, sf_dir):
    lines = stand_in.person_lines(spark, sf_dir, ["p_name"], [])
    return agg.distinct_per_key(lines, "o_custkey", "p_name", "n_names")


@query("""SELECT n_regionkey, page, count(*) AS n, list(n_nationkey ORDER BY n_nationkey) AS ids
          FROM (SELECT n_regionkey, n_nationkey, (row_number() OVER (PARTITION BY n_regionkey
            ORDER BY n_nationkey) - 1) // 2 AS page FROM nation) GROUP BY ALL""")
def nation_ids(spark, sf_dir):
    """Ids of each group as pages of two."""
    return id_pages(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_nationkey", 2)


@query("""SELECT l_returnflag, round(quantile_cont(l_quantity, 0.1), 6) AS q10,
          round(quantile_cont(l_quantity, 0.5), 6) AS q50,
          round(quantile_cont(l_quantity, 0.9), 6) AS q90 FROM lineitem GROUP BY 1""")
def quantity_quantiles(spark, sf_dir):
    out = agg.quantiles(table(spark, sf_dir, "lineitem"), "l_quantity", [0.1, 0.5, 0.9],
                        ["l_returnflag"])
    return out.select("l_returnflag", r6("q10"), r6("q50"), r6("q90"))


_PRICE_QUANTILES = ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS q{round(100 * p)}"
                             for p in (0, 0.1, 0.5, 0.9, 1))


@query(f"SELECT l_returnflag, l_linenumber, {_PRICE_QUANTILES} FROM lineitem GROUP BY 1, 2")
def price_quantiles(spark, sf_dir):
    """Quantiles of nearly distinct numbers, selected by place."""
    out = agg.quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0, 0.1, 0.5, 0.9, 1],
                        ["l_returnflag", "l_linenumber"])
    return out.select("l_returnflag", "l_linenumber", *[r6(f"q{p}") for p in (0, 10, 50, 90, 100)])


@query(f"SELECT {_PRICE_QUANTILES} FROM lineitem")
def price_quantiles_overall(spark, sf_dir):
    out = agg.quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0, 0.1, 0.5, 0.9, 1])
    return out.select(*[r6(f"q{p}") for p in (0, 10, 50, 90, 100)])


@query("""SELECT c_mktsegment, page, count(*) AS n, list(c_custkey ORDER BY c_custkey) AS ids
          FROM (SELECT c_mktsegment, c_custkey, (row_number() OVER (PARTITION BY c_mktsegment
            ORDER BY c_custkey) - 1) // 50 AS page FROM customer) GROUP BY ALL""")
def segment_id_pages(spark, sf_dir):
    """Ids of groups larger than a page, as arrays of bounded length."""
    return id_pages(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_custkey", 50)


@query("""SELECT p_brand, p_name AS commonest_name FROM (
          SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand
            ORDER BY count(*) DESC, p_name) AS rn FROM part GROUP BY p_brand, p_name)
          WHERE rn = 1""")
def commonest_name(spark, sf_dir):
    return agg.commonest(table(spark, sf_dir, "part"), ["p_brand"], "p_name", "commonest_name")


@query("""SELECT times, count(*) AS n_values FROM (SELECT count(*) AS times FROM orders
          GROUP BY o_custkey) GROUP BY 1""")
def order_freq_of_freq(spark, sf_dir):
    return agg.freq_of_freq(table(spark, sf_dir, "orders"), "o_custkey")


@query("""SELECT n_persons, n_population,
          CAST(round_even(100 * n_persons / n_population, 0) AS INTEGER) AS pct,
          n_persons || ' ( ' || CAST(round_even(100 * n_persons / n_population, 0) AS INTEGER)
            || ' %)' AS text
          FROM (SELECT (SELECT count(DISTINCT user_id) FROM events) AS n_persons,
            (SELECT count(*) FROM customer) AS n_population)""")
def event_coverage(spark, sf_dir):
    return agg.coverage(table(spark, sf_dir, "events"), table(spark, sf_dir, "customer"), "user_id")


@query("""SELECT * EXCLUDE (rn) FROM (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice,
          row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
          FROM orders) WHERE rn = 1""")
def first_order(spark, sf_dir):
    """First row per key in a stated order."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return agg.first_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_projection(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
          ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 30""")
def top_lines(spark, sf_dir):
    """A top-k report with a settled order on ties."""
    return (table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
            .orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
            .limit(fixed.TOP_SNOMED))


@query("""SELECT person_id, kind, amount, note FROM (
          SELECT o_custkey AS person_id, 'order' AS kind, o_totalprice AS amount, NULL AS note
          FROM orders UNION ALL
          SELECT user_id, 'event', value, event_type FROM events)""")
def bound_rows(spark, sf_dir):
    """Rows of two tables by column name, absent columns missing."""
    orders = table(spark, sf_dir, "orders").select(
        F.lit("order").alias("kind"), F.col("o_custkey").alias("person_id"),
        F.col("o_totalprice").alias("amount"))
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("person_id"), F.lit("event").alias("kind"),
        F.col("value").alias("amount"), F.col("event_type").alias("note"))
    return bind_rows(orders, events).select("person_id", "kind", "amount", "note")


@query("SELECT o_custkey AS person_id FROM orders UNION SELECT user_id FROM events")
def key_sets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person_id"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("person_id"))
    return key_union("person_id", orders, events)


@query("SELECT * FROM orders WHERE o_custkey = 7")
def one_person(spark, sf_dir):
    """All rows of one person; the id reaches the scan as a pushed filter."""
    return for_person(table(spark, sf_dir, "orders"), 7, "o_custkey")


@query("SELECT * FROM orders WHERE o_custkey = 7")
def one_person_by_folder(spark, sf_dir):
    """The same from a table kept by person: one folder is read."""
    kept = by_person(table(spark, sf_dir, "orders"), "orders", "o_custkey", 16, ["o_orderdate"])
    return kept.of(7)
