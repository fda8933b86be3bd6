"""Ordered regex rules to labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.functions.text import matches_ci


def classify(col: Column, rules: Sequence[tuple[str, str]], default: str = "nomatch") -> Column:
    """Label of the first ``(pattern, label)`` that matches, case ignored.

    A NULL text matches no rule and takes the default.
    """
    label = None
    for pattern, name in rules:
        test = matches_ci(col, f"(?:{pattern})")
        label = F.when(test, name) if label is None else label.when(test, name)
    return F.lit(default) if label is None else label.otherwise(default)


def with_class(df: DataFrame, text: str, rules: Sequence[tuple[str, str]], name: str,
               default: str = "nomatch", keep_default: bool = True) -> DataFrame:
    """Add the label as a column that later filters read instead of recomputing.

    A plain column would be copied, regexes and all, into every predicate that
    Catalyst pushes below it.  Exploding a one-element array computes it once
    per row, while filters and semi joins on other columns still move to the
    scan.  Rows without a label are left out by ``keep_default=False``; their
    array is empty, so no filter stands in the way of such a semi join.
    """
    labels = F.array(classify(F.col(text), rules, default))
    if not keep_default:
        labels = F.array_remove(labels, default)
    return df.withColumn(name, F.explode(labels))


def with_dictionary_class(df: DataFrame, text: str, rules: Sequence[tuple[str, str]], name: str,
                          default: str = "nomatch", keep_default: bool = True) -> DataFrame:
    """The same label, found once for each distinct text and joined back.

    Names repeat over very many rows, so the rules run over a dictionary of
    them, which partial aggregation keeps small on the way.  Without the
    default the dictionary holds the named texts only, and the join is the
    filter.  Semi joins on other columns still move below it, to the rows.
    """
    names = df.groupBy(F.col(f"`{text}`").alias("__text")).agg(F.count("*").alias("__rows"))
    # a label that hangs on the count cannot move below it, to every row
    label = F.when(F.col("__rows") > 0, classify(F.col("__text"), rules, default))
    labelled = names.select("__text", label.alias(name))
    if not keep_default:
        labelled = labelled.where(F.col(name) != default)
    joined = df.join(labelled, F.col(f"`{text}`").eqNullSafe(F.col("__text")))
    return joined.drop("__text")
