"""Sources and sinks over the given tables: write, read back, stream."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_spark.operators.sets import bind_rows
from cohort_spark.plans import stand_in
from cohort_spark.plans.oracle import scan_sql
from cohort_spark.plans.registry import query, rounded_tests
from cohort_spark.plans.study import Study
from cohort_spark.session import shared_folder
from cohort_spark.sources import (
    land_calls,
    landed_variants as read_landed,
    load_calls,
    read_positional,
    read_table,
    save_named,
    scan_variants,
    stage,
    write_table,
)
from cohort_spark.sources import study_tables
from cohort_spark.streaming import read_ingested, stream_variants

_CALL_COLUMNS = ["Sample", "Start", "Gene.refGene", "AAChange.refGene", "DP", "minAD", "AF"]
_CALL_SQL = f"""
    SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS sample,
      CAST(p_partkey AS INTEGER) AS start, CAST(trunc(l_quantity) AS INTEGER) AS depth,
      l_linenumber AS minor_reads, CAST(CASE WHEN p_partkey % 40 = 0 THEN '0.1,0.2'
        ELSE '0.' || lpad(CAST(CAST(floor(100.0 * l_linenumber / trunc(l_quantity)) AS BIGINT)
        AS VARCHAR), 2, '0') END AS VARCHAR) AS af
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    WHERE p_brand = '{stand_in.GENE}'"""


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _call_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_in.calls(spark, sf_dir).select(*[f"`{c}`" for c in _CALL_COLUMNS])


def _write_samples(calls: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Call files that hold whole samples, more of them for more calls."""
    write_table(calls.repartition("Sample"), path, mode=mode)


def _in_two(calls: DataFrame, first: Column) -> tuple[DataFrame, DataFrame]:
    """The calls of a test and the others; what makes the calls runs once."""
    calls = stage(calls, "calls")
    return calls.filter(first), calls.filter(~first)


def _call_output(calls: DataFrame) -> DataFrame:
    return calls.select(F.col("Sample").alias("sample"), F.col("Start").alias("start"),
                        F.col("DP").alias("depth"), F.col("minAD").alias("minor_reads"),
                        F.col("AF").alias("af"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
       "CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, o_orderpriority FROM orders")
def csv_roundtrip(spark, sf_dir):
    df, path = stand_in.table(spark, sf_dir, "orders"), _fresh(spark, "orders-csv")
    write_table(df, path)
    return read_table(spark, path, df.schema)


@query("SELECT * FROM customer")
def tsv_roundtrip(spark, sf_dir):
    df, path = stand_in.table(spark, sf_dir, "customer"), _fresh(spark, "customer-tsv")
    write_table(df, path, sep="\t")
    return read_table(spark, path, df.schema, sep="\t")


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def bar_separated_scan(spark, sf_dir):
    df, path = stand_in.table(spark, sf_dir, "part"), _fresh(spark, "part-bar")
    write_table(df, path, sep="|")
    scan = read_table(spark, path, df.schema, sep="|")
    return scan.select("p_partkey", "p_name", "p_size", "p_retailprice")


@query("""SELECT l_returnflag AS flag, l_linenumber AS line, l_quantity AS quantity,
          CAST(l_partkey AS INTEGER) AS part FROM lineitem""")
def positional_scan(spark, sf_dir):
    """Columns typed by position codes, the last one left out."""
    path = _fresh(spark, "lines-by-position")
    write_table(stand_in.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("quantity"), F.col("l_partkey").alias("part"),
        F.col("l_linestatus").alias("unused")), path)
    return read_positional(spark, path, "cidi_")


@query(_CALL_SQL)
def variant_files(spark, sf_dir):
    """One scan over many call files with the gene filter."""
    calls, path = _call_files(spark, sf_dir), _fresh(spark, "call-files")
    _write_samples(calls, path)
    return _call_output(scan_variants(spark, path, calls.schema, stand_in.GENE))


@query(_CALL_SQL)
def variant_files_by_name(spark, sf_dir):
    """Files whose headers differ in order, bound by column name."""
    calls, path = _call_files(spark, sf_dir), _fresh(spark, "call-files-mixed")
    odd, even = _in_two(calls, F.col("Start") % 2 == 1)
    write_table(odd, f"{path}/a")
    write_table(even.select(*[f"`{c}`" for c in reversed(_CALL_COLUMNS)]),
                f"{path}/b")
    return _call_output(scan_variants(spark, [f"{path}/a", f"{path}/b"], calls.schema,
                                      stand_in.GENE, by_name=True))


@query(_CALL_SQL)
def variant_batches(spark, sf_dir):
    """Two batches of calls under one schema."""
    calls, path = _call_files(spark, sf_dir), _fresh(spark, "call-batches")
    early, late = _in_two(calls, F.col("DP") < 25)
    write_table(early, f"{path}/first")
    write_table(late, f"{path}/second")
    return _call_output(load_calls(spark, [f"{path}/first", f"{path}/second"], calls.schema,
                                   stand_in.GENE))


@query("""SELECT place, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance
          FROM customer, (VALUES ('one'), ('two')) t(place) GROUP BY ALL""")
def named_sinks(spark, sf_dir):
    """One result saved under its name at two roots, read back from both."""
    df, root = stand_in.table(spark, sf_dir, "customer"), _fresh(spark, "sinks")
    places = save_named(df, "customers", [f"{root}/one", f"{root}/two"])
    frames = [read_table(spark, path, df.schema).withColumn("place", F.lit(place))
              for place, path in zip(("one", "two"), places)]
    return bind_rows(*frames).groupBy("place", "c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def stage_roundtrip(spark, sf_dir):
    events = stand_in.table(spark, sf_dir, "events")
    return stage(events.select("event_id", "ts", "user_id", "event_type", "value"), "events")


@query(_CALL_SQL)
def stream_ingest(spark, sf_dir):
    """Call files taken up in batches by a stream that ends when all are read."""
    calls, path = _call_files(spark, sf_dir), _fresh(spark, "call-stream")
    _write_samples(calls, f"{path}/in")
    stream = stream_variants(spark, f"{path}/in", calls.schema, stand_in.GENE, f"{path}/out",
                             f"{path}/progress", max_files=4)
    stream.awaitTermination()
    return _call_output(read_ingested(spark, f"{path}/out", calls.schema))


@query(f"{_CALL_SQL} AND p_partkey % 3 > 0")
def stream_with_odd_files(spark, sf_dir):
    """Files of another header among the others: they are set aside, the stream goes on."""
    calls, path = _call_files(spark, sf_dir), _fresh(spark, "call-stream-odd")
    other, usual = _in_two(calls, F.col("Start") % 3 == 0)
    _write_samples(usual, f"{path}/in")
    _write_samples(other.select(*[f"`{c}`" for c in reversed(_CALL_COLUMNS)]), f"{path}/in", mode="append")
    stream_variants(spark, f"{path}/in", calls.schema, stand_in.GENE, f"{path}/out",
                    f"{path}/progress", max_files=3).awaitTermination()
    return _call_output(read_ingested(spark, f"{path}/out", calls.schema))


@query(_CALL_SQL)
def landed_variants(spark, sf_dir):
    """Calls clustered by gene when they land, then one gene read by range and Bloom filter."""
    calls, path = _call_files(spark, sf_dir), _fresh(spark, "call-landing")
    land_calls(calls, path)
    return _call_output(read_landed(spark, path, calls.schema, stand_in.GENE))


_STUDY_SQL = scan_sql("""SELECT standard_concept_name,
    count(DISTINCT CASE WHEN is_case THEN person_id END) AS case_w,
    count(DISTINCT CASE WHEN NOT is_case THEN person_id END) AS control_w
    FROM dx JOIN arms USING (person_id) GROUP BY 1""", "standard_concept_name", "dx", "arms")


def _study_files(spark, sf_dir, write_calls):
    """Paths of a study's delimited files; ``write_calls`` writes the calls and says where."""
    root, given = _fresh(spark, "study-files"), stand_in.sources(spark, sf_dir)
    paths = {name: f"{root}/{name}" for name in ("demographics", "ancestry", "metrics", "diagnoses")}
    for name, path in paths.items():
        write_table(getattr(given, name), path,
                    sep="\t" if name in study_tables.TAB_SEPARATED else ",")
    return {**paths, "calls": write_calls(given.calls, f"{root}/calls")}


def _scan_of_files(spark, paths):
    sources = study_tables.read_sources(spark, paths)
    study = Study(sources, stand_in.GENE, stand_in.SITE_PATTERN, ratio=stand_in.RATIO)
    return rounded_tests(study.snomed_scan())


@query(_STUDY_SQL)
def study_from_files(spark, sf_dir):
    """A whole study over delimited files: cases, controls and the diagnosis scan."""
    def write(calls, path):
        write_table(calls, path)
        return path

    return _scan_of_files(spark, _study_files(spark, sf_dir, write))


@query(_STUDY_SQL)
def study_from_mixed_batches(spark, sf_dir):
    """The same with two batches of calls whose columns stand in another order."""
    def write(calls, path):
        early, late = _in_two(calls, F.col("DP") < 25)
        write_table(early, f"{path}/first")
        write_table(late.select(*[f"`{c}`" for c in sorted(calls.columns)]),
                    f"{path}/second")
        return [f"{path}/first", f"{path}/second"]

    return _scan_of_files(spark, _study_files(spark, sf_dir, write))
