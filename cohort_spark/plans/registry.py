"""Registered queries: a Spark function and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_spark.plans import stand_in
from cohort_spark.plans.study import Study

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_STUDIES: dict[tuple[str, str], Study] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def shared_study(spark: SparkSession, sf_dir: str) -> Study:
    """The study over one set of tables; its stages are written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STUDIES:
        _STUDIES[key] = stand_in.study(spark, sf_dir)
    return _STUDIES[key]


def r6(col: str | Column, name: str | None = None) -> Column:
    """A double rounded to six places, so both engines print the same."""
    rounded = F.round(F.col(col) if isinstance(col, str) else col, 6)
    return rounded.alias(name or col) if isinstance(col, str) or name else rounded


def shown_tests(scan: DataFrame) -> DataFrame:
    """Estimates to six places and p to seven significant digits, so that small p stay apart."""
    return rounded_tests(scan, "odds_ratio", "or_low", "or_hi").withColumn(
        "p_val", F.format_string("%.6e", F.col("p_val")).cast("double"))


def rounded_tests(scan: DataFrame, *cols: str) -> DataFrame:
    return scan.withColumns({c: F.round(c, 6)
                             for c in cols or ("odds_ratio", "or_low", "or_hi", "p_val")})
