"""Delimited text with a given schema: header, ``NA`` and empty both missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CODE_TYPES = {"c": T.StringType(), "i": T.IntegerType(), "d": T.DoubleType(),
               "_": T.StringType()}


def schema_from_codes(names: Sequence[str], codes: str) -> tuple[T.StructType, list[str]]:
    """Schema for a file read by position, and the columns to keep.

    ``c`` text, ``i`` int, ``d`` double, ``_`` read past but not kept.
    """
    if len(names) != len(codes):
        raise ValueError(f"{len(names)} names for {len(codes)} type codes")
    unknown = set(codes) - set(_CODE_TYPES)
    if unknown:
        raise ValueError(f"unknown type codes: {sorted(unknown)}")
    schema = T.StructType([T.StructField(n, _CODE_TYPES[c]) for n, c in zip(names, codes)])
    return schema, [n for n, c in zip(names, codes) if c != "_"]


def read_table(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str,
               sep: str = ",", keep: Sequence[str] | None = None,
               by_name: bool = False, strict: bool = False) -> DataFrame:
    """Read delimited files with a header; a quote within a quoted field is doubled.

    Columns bind by position and a header in another order is an error.
    ``by_name`` takes the order from the header of the first file instead:
    columns the schema lacks are left out, columns the file lacks are NULL, and
    a later file with another header is still an error.  ``strict`` fails on a
    value that is not of its column's type or a row of another length, which
    otherwise read as missing.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if by_name:
        df = read_layout(spark, paths, header_of(spark, paths, sep), schema, sep, strict)
    else:
        df = _reader(spark, schema, sep, strict).csv(paths)
    return df if keep is None else df.select(*[f"`{name}`" for name in keep])


def header_of(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> list[str]:
    """Column names in the first line of the first file; reads no further."""
    return spark.read.options(**delimited(sep)).csv(path).columns


def read_positional(spark: SparkSession, path: str | Sequence[str], codes: str,
                    sep: str = ",") -> DataFrame:
    """Names from the header, types from one code per column position."""
    schema, keep = schema_from_codes(header_of(spark, path, sep), codes)
    return read_table(spark, path, schema, sep=sep, keep=keep)


def delimited(sep: str) -> dict[str, object]:
    """The one dialect of readers, sinks and streams: quotes inside a field are doubled."""
    return {"header": True, "sep": sep, "nullValue": "NA", "quote": '"', "escape": '"'}


def _reader(spark: SparkSession, schema: T.StructType | str, sep: str, strict: bool = False) -> DataFrameReader:
    return (spark.read.schema(schema).options(**delimited(sep)).option("enforceSchema", False)
            .option("mode", "FAILFAST" if strict else "PERMISSIVE"))


def as_schema(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_layout(spark: SparkSession, paths: Sequence[str], header: Sequence[str],
                schema: T.StructType | str, sep: str = ",", strict: bool = False) -> DataFrame:
    """Files that share one header, as the columns of ``schema``."""
    fields = as_schema(schema).fields
    types = {field.name: field.dataType for field in fields}
    layout = T.StructType([T.StructField(name, types.get(name, T.StringType()))
                           for name in header])
    return _reader(spark, layout, sep, strict).csv(list(paths)).select(*[
        F.col(f"`{f.name}`") if f.name in header else F.lit(None).cast(f.dataType).alias(f.name)
        for f in fields])


def write_table(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """Write delimited files with a header, missing values as ``NA``."""
    df.write.mode(mode).options(**delimited(sep)).csv(path)
