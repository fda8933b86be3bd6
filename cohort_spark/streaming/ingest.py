"""New per-sample call files, filtered to one gene and appended as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cohort_spark.sources.tables import delimited
from cohort_spark.sources.variants import GENE_COLUMN


def read_line_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Lines of a growing directory with their file and place, ``max_files`` files per batch."""
    return (spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)
            .select("value", F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block")))


def ingest_batch(schema: T.StructType, gene: str, out: str, quarantine: str,
                 gene_column: str = GENE_COLUMN, sep: str = ",",
                 out_files: int | None = None) -> Callable[[DataFrame, int], None]:
    """What becomes of one batch of lines: calls of the gene, and files of another header.

    Both go to a folder named by the batch, which a repeated batch overwrites,
    so a batch that ran but was not recorded leaves no row twice.
    """
    header = sep.join(f.name for f in schema.fields)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {k: str(v) for k, v in delimited(sep).items() if k != "header"}

    def take(batch: DataFrame, number: int) -> None:
        lines = (batch.where(F.length(F.trim("value")) > 0)
                 .withColumn("at", F.monotonically_increasing_id()).persist())
        try:
            heads = (lines.where("block = 0").groupBy("file")
                     .agg(F.min(F.struct("at", "value")).alias("head"))
                     .select("file", F.col("head.at").alias("head_at"), F.col("head.value").alias("header")))
            known = F.regexp_replace("header", r'[" ]', "") == header.replace(" ", "")
            (heads.where(~known).select("file", "header")
             .write.mode("overwrite").parquet(f"{quarantine}/batch={number}"))
            rows = (lines.join(heads.where(known), "file").where("at <> head_at")
                    .select(F.from_csv("value", ddl, options).alias("row")).select("row.*")
                    .filter(F.col(f"`{gene_column}`") == gene))
            if out_files is not None:
                rows = rows.repartition(out_files)
            rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            lines.unpersist()

    return take


def stream_variants(spark: SparkSession, path: str, schema: T.StructType, gene: str,
                    out: str, checkpoint: str, quarantine: str | None = None,
                    max_files: int = 1000, out_files: int | None = None,
                    **options: object) -> StreamingQuery:
    """Append the gene's calls of all files not seen before, then stop.

    The checkpoint records the files done, so a restarted or repeated run
    neither loses nor repeats a file.  A file whose first line is not the header
    of ``schema`` stops nothing: its name and line are listed in ``quarantine``
    (``<out>-quarantine`` unless given) and the others go on.  ``out_files``
    bounds the files a batch writes; without it every split that kept a call
    writes one.
    """
    take = ingest_batch(schema, gene, out, quarantine or f"{out.rstrip('/')}-quarantine",
                        out_files=out_files, **options)
    return (read_line_stream(spark, path, max_files).writeStream.foreachBatch(take)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_ingested(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """All calls taken up so far."""
    columns = [f"`{f.name}`" for f in schema.fields]
    return spark.read.schema(schema).option("basePath", out).parquet(out).select(*columns)


def read_quarantine(spark: SparkSession, quarantine: str) -> DataFrame:
    """(file, header) of the files that were left out."""
    return spark.read.schema("file string, header string").parquet(quarantine).select("file", "header")
