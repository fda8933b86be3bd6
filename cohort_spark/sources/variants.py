"""Scans of many per-sample call files, keeping one gene."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort_spark.operators.sets import bind_rows
from cohort_spark.sources.stages import stage
from cohort_spark.sources.tables import delimited, read_table

GENE_COLUMN = "Gene.refGene"


def scan_variants(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
                  gene: str, gene_column: str = GENE_COLUMN, sep: str = ",",
                  by_name: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """One multi-file scan with the gene filter; Spark splits and packs the files.

    Columns bind by position and a file whose header differs is an error.
    ``by_name`` binds by header instead, filling absent columns with NULL.
    """
    if by_name:
        calls = read_by_name(spark, path, schema, sep)
    else:
        calls = read_table(spark, path, schema, sep=sep)
    calls = calls.filter(F.col(f"`{gene_column}`") == gene)
    return calls if keep is None else calls.select(*[f"`{name}`" for name in keep])


def header_catalogue(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, header): the first line with any text of each file, as it stands.

    Only rows of first blocks are considered, and a file's rows reduce to one
    before they are shuffled.
    """
    paths = [path] if isinstance(path, str) else list(path)
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    first = lines.where((F.col("block") == 0) & (F.length(F.trim("value")) > 0))
    return first.groupBy("file").agg(F.min_by("value", "at").alias("header"))


def read_by_name(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
                 sep: str = ",", required: Sequence[str] = ()) -> DataFrame:
    """Files whose headers differ, each row bound by the header of its own file.

    Files are read once, as columns numbered by place, and joined with the
    catalogue of their headers; a schema column is then the place its name has
    in that layout.  Only the distinct headers come to the driver.  A column
    that a file lacks is NULL; a file whose first line holds none of the
    schema's names, or lacks a ``required`` one, is an error.
    """
    paths = [path] if isinstance(path, str) else list(path)
    catalogue = stage(header_catalogue(spark, paths), "headers")
    found = catalogue.groupBy("header").agg(F.count("*").alias("files"), F.min("file").alias("example")).collect()
    names = [field.name for field in schema.fields]
    layouts = {row.header: _fields(row.header, sep) for row in found}
    for row in found:
        missing = [name for name in required if name not in layouts[row.header]]
        if missing or not set(names) & set(layouts[row.header]):
            what = f"{', '.join(missing)} missing" if missing else "no header line"
            raise ValueError(f"{what} in {row.files} files such as {row.example}")
    if not layouts:
        return spark.createDataFrame([], schema)
    width = max(map(len, layouts.values()))
    places = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    rows = (spark.read.schema(places).options(**delimited(sep)).csv(paths)
            .select("*", F.col("_metadata.file_path").alias("file")))
    named = rows.join(catalogue, "file")
    return named.select(*[_bound(field, layouts).alias(field.name) for field in schema.fields])


def _fields(header: str, sep: str) -> list[str]:
    return [name.strip() for name in next(csv.reader([header], delimiter=sep))]


def _bound(field: T.StructField, layouts: dict[str, list[str]]) -> Column:
    """The place of a column in the layout of the row's file, as the column's type."""
    by_place: dict[int, list[str]] = {}
    for header, names in layouts.items():
        if field.name in names:
            by_place.setdefault(names.index(field.name), []).append(header)
    if not by_place:
        return F.lit(None).cast(field.dataType)
    if len(by_place) == 1 and len(next(iter(by_place.values()))) == len(layouts):
        text = F.col(f"c{next(iter(by_place))}")
    else:
        text = None
        for place, headers in by_place.items():
            test, value = F.col("header").isin(headers), F.col(f"c{place}")
            text = F.when(test, value) if text is None else text.when(test, value)
    return text if isinstance(field.dataType, T.StringType) else text.try_cast(field.dataType)


def load_calls(spark: SparkSession, batches: Sequence[str | Sequence[str]],
               schema: T.StructType, gene: str, keep: Sequence[str] | None = None,
               **options: object) -> DataFrame:
    """All batches of call files under one schema, one gene."""
    return bind_rows(*[scan_variants(spark, batch, schema, gene, keep=keep, **options)
                       for batch in batches])


# --- landing ---------------------------------------------------------------------
def plain_name(name: str) -> str:
    """A column name without the dots that keep a filter from the scan."""
    return name.replace(".", "_")


def land_calls(calls: DataFrame, path: str, gene_column: str = GENE_COLUMN,
               order: Sequence[str] = ("Sample", "Start"), files: int | None = None,
               genes: int = 30_000, mode: str = "errorifexists") -> None:
    """Write calls so that a gene is found without reading the others.

    Rows are clustered by gene over the files and sorted by it within them, so
    the range of genes in a file or row group leaves most out; a Parquet Bloom
    filter leaves out the rest.  A gene with very many calls spreads over
    several files by ``order``.
    """
    given = [c for c in order if c in calls.columns]
    plain = calls.select(*[F.col(f"`{c}`").alias(plain_name(c)) for c in calls.columns])
    keys = [F.col(plain_name(c)) for c in (gene_column, *given)]
    dealt = plain.repartitionByRange(files, *keys) if files else plain.repartitionByRange(*keys)
    column = plain_name(gene_column)
    (dealt.sortWithinPartitions(*keys).write.mode(mode)
     .option(f"parquet.bloom.filter.enabled#{column}", "true")
     .option(f"parquet.bloom.filter.expected.ndv#{column}", str(genes)).parquet(path))


def landed_variants(spark: SparkSession, path: str, schema: T.StructType, gene: str,
                    gene_column: str = GENE_COLUMN) -> DataFrame:
    """One gene's calls from a landing, under the names of ``schema``; the filter reaches the scan."""
    plain = T.StructType([T.StructField(plain_name(f.name), f.dataType) for f in schema.fields])
    calls = spark.read.schema(plain).parquet(path).filter(F.col(plain_name(gene_column)) == gene)
    return calls.select(*[F.col(plain_name(f.name)).alias(f.name) for f in schema.fields])
