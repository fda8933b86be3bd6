"""Tables kept by person, so that one person's rows come from one folder."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_spark.session import shared_folder

BUCKET = "person_bucket"


def _bucket(person: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(person), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class PersonTable:
    """A written table in ``buckets`` folders by a hash of the person.

    Within a folder rows are sorted by person, so the ranges of its row groups
    leave out what else is in the folder.
    """

    spark: SparkSession
    path: str
    schema: str
    person: str
    buckets: int

    def rows(self) -> DataFrame:
        return (self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(self.path)
                .drop(BUCKET))

    def of(self, person_id: object) -> DataFrame:
        """One person's rows: the folder is picked when the query is planned."""
        rows = self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(self.path)
        given = F.lit(person_id).cast(rows.schema[self.person].dataType)
        return rows.where((F.col(BUCKET) == _bucket(given, self.buckets))
                          & F.col(f"`{self.person}`").eqNullSafe(given)).drop(BUCKET)


def by_person(df: DataFrame, name: str, person: str = "person_id", buckets: int = 64,
              spread: Sequence[str] = (), path: str | None = None) -> PersonTable:
    """Write ``df`` by person into the shared folder, or to ``path``.

    Folders are filled by ranges of (bucket, person), so a bucket may be written
    by several tasks; ``spread`` names columns by which a single person with
    very many rows is spread over tasks as well.  A missing person has a bucket
    like any other.
    """
    spark = df.sparkSession
    if BUCKET in df.columns:
        raise ValueError(f"the table has a column {BUCKET} of its own")
    path = path or f"{shared_folder(spark)}/people/{uuid.uuid4().hex}/{name}"
    keys = [F.col(BUCKET), F.col(f"`{person}`"), *[F.col(f"`{c}`") for c in spread]]
    dealt = df.withColumn(BUCKET, _bucket(F.col(f"`{person}`"), buckets)).repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.partitionBy(BUCKET).parquet(path)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return PersonTable(spark, path, ddl, person, buckets)
