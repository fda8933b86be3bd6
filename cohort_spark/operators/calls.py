"""Variant call quality, protein-site cases and call tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark import fixed_values as fixed
from cohort_spark.functions.exact import binom_p
from cohort_spark.functions.text import first_integer, matches, split_fields, to_number
from cohort_spark.operators.columns import drop_prefix
from cohort_spark.operators.joins import join_on, natural_join, semi
from cohort_spark.sources.stages import stage

CALL_NAMES = {
    "Chr": "chr", "Start": "pos", "Ref": "ref", "Alt": "alt",
    "Gene.refGene": "gene_name", "Func.refGene": "func", "AAChange.refGene": "aa_change",
    "cosmic70": "cosmic70", "DP": "DP", "AD": "AD", "F1R2": "F1R2", "F2R1": "F2R1",
    "SB": "SB", "AF": "AF",
}


def supported_calls(calls: DataFrame) -> DataFrame:
    """Calls with enough depth, minor reads and both strands of both alleles."""
    test = (F.col("DP") >= fixed.MIN_DEPTH) & (F.col("minAD") >= fixed.MIN_MINOR_READS)
    for count in fixed.STRAND_COUNTS:
        test = test & (F.col(count) > 0)
    return drop_prefix(calls, "Other").filter(test)


def read_counts(calls: DataFrame) -> DataFrame:
    """Person, renamed call columns, numeric allele fraction, and the counts to test."""
    renamed = [F.col(f"`{old}`").alias(new) for old, new in CALL_NAMES.items() if old != "AF"]
    return calls.select(
        first_integer(F.col("Sample")).alias("person_id"), *renamed,
        to_number(F.col("AF")).alias("AF"),
        F.col("maxAD").alias("__x"), (F.col("maxAD") + F.col("minAD")).alias("__n"),
    )


def with_binomial(counted: DataFrame, pairs: DataFrame | None = None,
                  name: str = "binom_p_val") -> DataFrame:
    """Add the exact p of ``__x`` out of ``__n`` and drop the two.

    Read counts repeat, so each distinct pair is tested once and written; calls
    then look their pair up.  ``pairs`` may be any frame that holds the pairs
    of ``counted``, such as the calls before a join that only removes some.
    """
    distinct = (counted if pairs is None else pairs).select("__x", "__n").distinct()
    memo = stage(distinct.withColumn(name, binom_p(F.col("__x"), F.col("__n"))), "binomial",
                 compact=True)
    return join_on(counted, memo, {"__x": "__x", "__n": "__n"}, "left").drop("__x", "__n")


def test_calls(calls: DataFrame) -> DataFrame:
    """Person, renamed call columns, numeric allele fraction and binomial p."""
    return with_binomial(read_counts(calls))


def passing_calls(calls: DataFrame, cohort: DataFrame) -> DataFrame:
    """Supported calls of cohort persons that are not plain heterozygous.

    One-copy persons pass outright; the others need a binomial p under 0.01.
    """
    counted = read_counts(supported_calls(calls))
    joined = natural_join(counted, cohort, "inner", on=["person_id"], both_grow=True)
    return with_binomial(joined, pairs=counted).filter((F.col("dragen_sex_ploidy") == fixed.SINGLE_COPY_PLOIDY)
                         | (F.col("binom_p_val") < fixed.MAX_BINOMIAL_P))


def calls_at_site(calls: DataFrame, pattern: str, too_many: str = "error") -> DataFrame:
    """Split the protein annotation and keep calls whose first protein matches."""
    split = split_fields(calls, "aa_change", fixed.AA_CHANGE_SEPARATOR,
                         fixed.AA_CHANGE_FIELDS, too_many)
    return split.filter(matches(F.col("protein1"), pattern))


def variant_counts(site_calls: DataFrame) -> DataFrame:
    """Calls per gene, ploidy, sex and change, most frequent first."""
    keys = ["gene_name", "dragen_sex_ploidy", "sex_at_birth", "dna1", "protein1"]
    return (site_calls.groupBy(*keys).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), *[F.asc_nulls_last(k) for k in keys]))


def high_af(site_calls: DataFrame, above: float = fixed.HIGH_AF) -> DataFrame:
    return site_calls.filter(F.col("AF") > above)


def lookup(df: DataFrame, cases: DataFrame, person: str = "person_id") -> DataFrame:
    """Rows of another study's table that belong to the cases."""
    return semi(df, cases, person)


def call_audit(split_calls: DataFrame) -> DataFrame:
    """Counts behind three data assumptions: one alternative allele per call,
    only splicing calls without fields, both protein fields equal."""
    return split_calls.agg(
        F.count("*").alias("n_calls"),
        F.count_if(F.col("AF").isNull()).alias("n_no_single_af"),
        F.count_if(F.col("protein1").isNull() & (F.col("func") != "splicing"))
        .alias("n_unsplit_not_splicing"),
        F.count_if(F.col("protein1") != F.col("protein2")).alias("n_protein_differs"),
    )

