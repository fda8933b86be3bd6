"""Reading the given tables and small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, return.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: str, modulus: int) -> Column:
    """crc32 of a number written as text, modulo; a missing id counts as empty text."""
    text = F.coalesce(F.col(col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def mixed(*cols: str | Column) -> Column:
    """A 64-bit hash that spreads rows, equal in every run."""
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols])


def spare(df: DataFrame) -> str:
    """A prefix that no column of ``df`` has, for columns that an operator adds and drops."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def most_frequent(counted: DataFrame, n: str, entries: int) -> DataFrame:
    """Rows of the largest counts, ``entries`` at most: all from a count on, or from one step above it.

    Counts are summed by eighths of an octave first, a few hundred rows, so no
    partition sends rows that do not belong to the result.
    """
    step = F.floor(F.log2(F.col(n)) * 8).cast("int")
    steps = sorted(((r.step, r.rows) for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()),
                   reverse=True)
    room, least = entries, None
    for at, rows in steps:
        if rows > room:
            break
        room, least = room - rows, at
    return counted.where(step >= least) if least is not None else counted.limit(0)


def tasks_for(spark: SparkSession) -> int:
    """Tasks that keep a whole cluster busy, at least the shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               2 * spark.sparkContext.defaultParallelism)
