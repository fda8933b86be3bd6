"""Baseline tables: means and shares, overall or by stratum, with tests.

All variables share one pass: each row is unpivoted to (variable, level) and
counted before the shuffle, so what moves is levels x strata per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.functions.dates import round_half_even
from cohort_spark.functions.tails import upper_tail

CONTINUOUS = ("age_at_biosample",)
CATEGORICAL = ("dragen_sex_ploidy", "sex_at_birth", "gender", "ancestry_pred", "race", "ethnicity")


def _strata(df: DataFrame, strata: str | None) -> Column:
    return F.lit("overall") if strata is None else F.col(f"`{strata}`")


def _pairs(df: DataFrame, names: Sequence[str], strata: str | None, kind: str) -> DataFrame:
    """Rows (stratum, variable, value), missing values left out."""
    return (df.select(_strata(df, strata).alias("stratum"),
                      F.explode(F.array(*[
                          F.struct(F.lit(n).alias("variable"), F.col(f"`{n}`").cast(kind).alias("value"))
                          for n in names])).alias("pair"))
            .select("stratum", "pair.variable", "pair.value")
            .filter(F.col("value").isNotNull() & F.col("stratum").isNotNull()))


def continuous_table(df: DataFrame, names: Sequence[str], strata: str | None = None) -> DataFrame:
    """n, mean and sample sd per stratum and variable."""
    return (_pairs(df, names, strata, "double").groupBy("stratum", "variable")
            .agg(F.count("*").alias("n"), F.avg("value").alias("mean"),
                 F.stddev_samp("value").alias("sd")))


def categorical_table(df: DataFrame, names: Sequence[str], strata: str | None = None) -> DataFrame:
    """n and percentage of every level per stratum and variable."""
    counts = (_pairs(df, names, strata, "string")
              .groupBy("stratum", "variable", F.col("value").alias("level"))
              .agg(F.count("*").alias("n")))
    whole = F.sum("n").over(Window.partitionBy("stratum", "variable"))
    return counts.withColumn("pct", 100 * F.col("n") / whole)


def sizes_table(df: DataFrame, strata: str | None = None) -> DataFrame:
    """Persons of each stratum, whatever they miss, as the row named ``n``."""
    stratum = _strata(df, strata).alias("stratum")
    return (df.select(stratum).where(F.col("stratum").isNotNull()).groupBy("stratum")
            .agg(F.count("*").alias("n")).withColumn("variable", F.lit("n")))


def table_one(df: DataFrame, continuous: Sequence[str] = CONTINUOUS,
              categorical: Sequence[str] = CATEGORICAL, strata: str | None = None,
              with_n: bool = False) -> DataFrame:
    """Both kinds of rows in one table; mean and sd, or level and percentage.

    ``with_n`` adds the row ``n`` of each stratum, which has neither.
    """
    numbers = continuous_table(df, continuous, strata).select(
        "stratum", "variable", F.lit(None).cast("string").alias("level"), "n",
        "mean", "sd", F.lit(None).cast("double").alias("pct"))
    shares = categorical_table(df, categorical, strata).select(
        "stratum", "variable", "level", "n", F.lit(None).cast("double").alias("mean"),
        F.lit(None).cast("double").alias("sd"), "pct")
    both = numbers.unionByName(shares)
    if not with_n:
        return both
    return both.unionByName(sizes_table(df, strata), allowMissingColumns=True)


def anova(df: DataFrame, names: Sequence[str], strata: str) -> DataFrame:
    """One-way F statistic with equal variances, from per-stratum moments."""
    groups = continuous_table(df, names, strata).withColumn(
        "grand", F.sum(F.col("n") * F.col("mean")).over(Window.partitionBy("variable"))
        / F.sum("n").over(Window.partitionBy("variable")))
    within = F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("sd") * F.col("sd")).otherwise(0.0)
    sums = groups.groupBy("variable").agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), F.lit(2))).alias("between"),
        F.sum(within).alias("within"),
        (F.count("*") - 1).cast("double").alias("df1"),
        (F.sum("n") - F.count("*")).cast("double").alias("df2"))
    statistic = F.try_divide(F.try_divide(F.col("between"), F.col("df1")),
                             F.try_divide(F.col("within"), F.col("df2")))
    return sums.select("variable", F.lit("anova").alias("test"), statistic.alias("statistic"),
                       "df1", "df2")


def chi_square(df: DataFrame, names: Sequence[str], strata: str) -> DataFrame:
    """Pearson statistic per variable, with continuity correction for 2x2.

    Empty cells need no row: with row and column totals R and C the statistic
    is N (sum O^2 / RC - 1), and in a 2x2 table all four deviations are equal.
    """
    counts = categorical_table(df, names, strata)
    by_row, by_col = (Window.partitionBy("variable", key) for key in ("stratum", "level"))
    cells = counts.select(
        "variable", F.col("n").cast("double").alias("o"),
        F.sum("n").over(by_row).cast("double").alias("row_n"),
        F.sum("n").over(by_col).cast("double").alias("col_n"),
        F.sum("n").over(Window.partitionBy("variable")).cast("double").alias("all_n"),
        F.count("*").over(by_row).alias("row_cells"), F.count("*").over(by_col).alias("col_cells"))
    expected = F.col("row_n") * F.col("col_n") / F.col("all_n")
    # a total occurs once per cell of its row or column, hence the shares
    sums = cells.groupBy("variable").agg(
        F.max("all_n").alias("all_n"), F.sum(F.col("o") * F.col("o") / expected).alias("ratio"),
        F.max(F.abs(F.col("o") - expected)).alias("gap"),
        F.round(F.sum(1 / F.col("row_cells"))).alias("r"),
        F.round(F.sum(1 / F.col("col_cells"))).alias("c"),
        F.sum(1 / (F.col("row_n") * F.col("row_cells"))).alias("r_inverse"),
        F.sum(1 / (F.col("col_n") * F.col("col_cells"))).alias("c_inverse"))
    plain = F.col("ratio") - F.col("all_n")
    # sum of 1 / expected over the cells is N sum(1/R) sum(1/C)
    corrected = (F.pow(F.col("gap") - F.least(F.lit(0.5), F.col("gap")), F.lit(2))
                 * F.col("all_n") * F.col("r_inverse") * F.col("c_inverse"))
    two_by_two = (F.col("r") == 2) & (F.col("c") == 2)
    df1 = (F.col("r") - 1) * (F.col("c") - 1)
    statistic = F.when(df1 > 0, F.when(two_by_two, corrected).otherwise(plain))
    return sums.select("variable", F.lit("chi-square").alias("test"),
                       statistic.alias("statistic"), df1.alias("df1"),
                       F.lit(None).cast("double").alias("df2"))


def table_one_tests(df: DataFrame, strata: str, continuous: Sequence[str] = CONTINUOUS,
                    categorical: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Statistic, degrees of freedom and p of every variable across strata."""
    tests = anova(df, continuous, strata).unionByName(chi_square(df, categorical, strata))
    tested = tests.withColumn("p_val", upper_tail("statistic", "df1", "df2"))
    return tested.withColumn("p_text", p_text(F.col("p_val")))


def table_one_text(table: DataFrame) -> DataFrame:
    """Add the printed form: ``mean (sd)``, ``n (percent)`` or a stratum's ``n``, ties to the even digit."""
    numbers = F.format_string("%.2f (%.2f)", round_half_even(F.col("mean"), 2),
                              round_half_even(F.col("sd"), 2))
    shares = F.format_string("%d (%.1f)", "n", round_half_even(F.col("pct"), 1))
    text = (F.when(F.col("level").isNotNull(), shares).when(F.col("mean").isNull() & (F.col("variable") == "n"),
                                                             F.col("n").cast("string")).otherwise(numbers))
    return table.withColumn("text", text)


def p_text(p_val: Column) -> Column:
    """Three decimals, or ``<0.001``."""
    return F.when(p_val < 0.001, "<0.001").when(p_val.isNotNull(),
                                                F.format_string("%.3f", p_val))
