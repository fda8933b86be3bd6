"""Association scans: every term tested for enrichment among the cases.

Counting shuffles once on (person, term) and once on the term, both after a
map-side combine; the arms are a set of persons joined by their key.  The semi
join is written after the first aggregate on purpose: Catalyst moves it below
when the arms are small enough to broadcast, and otherwise only the reduced
rows are shuffled by person, so neither a hot person nor a hot term can fill
one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.functions.dates import round_half_even
from cohort_spark.functions.exact import fisher_tests
from cohort_spark.operators.joins import natural_join


def arm_totals(arms: DataFrame) -> DataFrame:
    return arms.agg(F.count_if("is_case").alias("n_case"),
                    F.count_if(~F.col("is_case")).alias("n_control"))


def in_study(rows: DataFrame, arms: DataFrame, person: str = "person_id",
             name: str = "__case") -> DataFrame:
    """Rows of study persons with their case flag.

    The semi join adds nothing to the result.  Over an aggregate Catalyst can
    move it, unlike the inner join, below the aggregate when the arms are small
    enough to broadcast; otherwise both joins share one partitioning.
    """
    rows = rows.join(arms.select(person), person, "left_semi")
    return rows.join(arms.select(person, F.col("is_case").alias(name)), person)


def flag_study(events: DataFrame, arms: DataFrame, person: str = "person_id",
               name: str = "case_or_control") -> DataFrame:
    """Rows of study persons with the text ``case`` or ``control``."""
    flagged = in_study(events, arms, person)
    return (flagged.withColumn(name, F.when(F.col("__case"), "case").otherwise("control"))
            .drop("__case"))


def scan_counts(events: DataFrame, arms: DataFrame, term: str | Sequence[str],
                unit: str = "persons", unit_cols: Sequence[str] = (),
                label: str | None = None, flag: str | None = None,
                person: str = "person_id") -> DataFrame:
    """The 2x2 cells of every term.

    ``unit='persons'`` counts distinct persons per term, or distinct
    (person, ``unit_cols``) combinations if those are named; ``unit='rows'``
    counts rows.  ``label`` adds the commonest non-missing value of that column
    per term.  ``flag`` names a text column that already says ``case`` or
    ``control``; without it the arm comes from ``arms``.
    """
    if unit not in ("persons", "rows"):
        raise ValueError("unit is 'persons' or 'rows'")
    terms = [term] if isinstance(term, str) else list(term)
    units = list(dict.fromkeys([person, *terms, *unit_cols]))
    known = [flag] if flag else []
    keys = list(dict.fromkeys([*units, *known, *([label] if label else [])]))
    if unit == "persons" and not label:
        rows = events.select(*keys).distinct().withColumn("__rows", F.lit(1).cast("bigint"))
    else:
        rows = events.groupBy(*keys).agg(F.count("*").alias("__rows"))
    if flag:
        rows = rows.withColumn("__case", F.col(flag) == "case")
    else:
        rows = in_study(rows, arms, person)

    # both branches of a labelled scan read the same columns of ``rows``, so that
    # they share its exchange
    counted = rows
    if label and label not in units:
        counted = rows.groupBy(*units, "__case").agg(F.sum("__rows").alias("__rows"))
    weight = F.col("__rows") if unit == "rows" else F.least(F.col("__rows"), F.lit(1))
    counts = counted.groupBy(*terms).agg(
        F.sum(F.when(F.col("__case"), weight).otherwise(0)).alias("case_w"),
        F.sum(F.when(~F.col("__case"), weight).otherwise(0)).alias("control_w"))
    if label:
        missing_last = F.struct(F.col(label).isNull(), -F.col("__n"), F.col(label))
        named = (rows.groupBy(*terms, label).agg(F.sum("__rows").alias("__n"))
                 .groupBy(*terms)
                 .agg(F.min_by(F.col(label), missing_last).alias(f"commonest_{label}")))
        counts = natural_join(counts, named, "left", on=terms)
    totals = arm_totals(arms)
    return (counts
            .withColumn("case_wo", totals.select("n_case").scalar() - F.col("case_w"))
            .withColumn("control_wo", totals.select("n_control").scalar() - F.col("control_w")))


def association_scan(events: DataFrame, arms: DataFrame, term: str | Sequence[str],
                     confidence: float = 0.95, test_partitions: int | None = None,
                     **options: object) -> DataFrame:
    """Cells, conditional odds ratio, exact limits and two-sided p of every term.

    The tests are dealt over ``test_partitions`` tasks, one a core of the cluster
    by default: a term is a few bytes but much work, so partitions chosen by
    size would leave all terms in one task.
    """
    counts = scan_counts(events, arms, term, **options)
    tasks = test_partitions or counts.sparkSession.sparkContext.defaultParallelism
    return fisher_tests(counts.repartition(tasks), confidence)


def top_terms(scan: DataFrame, k: int, term: str | Sequence[str]) -> DataFrame:
    """The k smallest p values, terms in order on a tie.

    p is compared unrounded but for the last digits: to ten significant ones, so
    that terms with equal cells tie.
    """
    terms = [term] if isinstance(term, str) else list(term)
    p = F.format_string("%.9e", F.col("p_val")).cast("double")
    return scan.orderBy(F.when(F.col("p_val").isNotNull(), p).asc_nulls_last(),
                        *[F.asc_nulls_last(t) for t in terms]).limit(k)


def _plain(col: Column) -> Column:
    """One decimal, none for a whole number."""
    rounded = round_half_even(col, 1)
    whole = rounded == F.floor(rounded)
    return F.when(whole, F.format_string("%.0f", rounded)).otherwise(
        F.format_string("%.1f", rounded))


def forest_table(scan: DataFrame, max_hi: float) -> DataFrame:
    """Rows with a usable interval and their label ``OR, [low, high], n = k``."""
    label = F.concat(F.format_string("%.1f", round_half_even(F.col("odds_ratio"), 1)),
                     F.lit(", ["), _plain(F.col("or_low")), F.lit(", "),
                     _plain(F.col("or_hi")), F.lit("], n = "),
                     (F.col("case_w") + F.col("control_w")).cast("string"))
    return scan.filter(F.col("or_hi") < max_hi).withColumn("label", label)
