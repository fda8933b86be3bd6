import re
import uuid

import pytest
from pyspark.sql import types as T

from cohort_spark import fixed_values as fixed
from cohort_spark.session import shared_folder
from cohort_spark.sources import (
    read_positional,
    read_table,
    save_named,
    land_calls,
    landed_variants,
    scan_variants,
    schema_from_codes,
    stage,
    write_table,
)
from cohort_spark.sources.variants import header_catalogue, read_by_name
from cohort_spark.streaming import read_ingested, read_quarantine, stream_variants
from conftest import values

SCHEMA = T.StructType([T.StructField("Sample", T.StringType()),
                       T.StructField("Gene.refGene", T.StringType()),
                       T.StructField("AF", T.StringType()), T.StructField("DP", T.IntegerType())])
ROWS = [("s1", "G", "0.1,0.2", 20), ("s2", "H", "0.3", 21), ("s3", "G", None, None)]


@pytest.fixture
def place(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def test_missing_values_survive_text(spark, frame, place):
    df = frame(ROWS, SCHEMA)
    for sep in (",", "\t", "|"):
        write_table(df, f"{place}/{ord(sep)}", sep=sep)
        assert values(read_table(spark, f"{place}/{ord(sep)}", SCHEMA, sep=sep)) == values(df)


def test_na_and_empty_text_are_missing(spark, frame, place):
    frame([("Sample,Gene.refGene,AF,DP",), ("NA,G,,7",)], "value string").coalesce(1) \
        .write.text(place)
    assert values(read_table(spark, place, SCHEMA)) == [(None, "G", None, 7)]


def test_positional_codes(spark, frame, place):
    schema, keep = schema_from_codes(["a", "b", "c", "d"], "cid_")
    assert [f.dataType.simpleString() for f in schema.fields] == ["string", "int", "double", "string"]
    write_table(frame([("x", 1, 2.5, "y")], schema), place)
    assert values(read_table(spark, place, schema, keep=keep)) == [("x", 1, 2.5)]
    assert values(read_positional(spark, place, "cid_")) == [("x", 1, 2.5)]
    names = [f"c{i}" for i in range(44)]
    full, kept = schema_from_codes(names, fixed.CALL_TYPE_CODES)
    assert kept == names[:-1] and len(full.fields) == 44
    assert [full.fields[i].dataType for i in (28, 33, 35)] == [
        T.IntegerType(), T.IntegerType(), T.DoubleType()]
    with pytest.raises(ValueError):
        schema_from_codes(["a"], "cc")
    with pytest.raises(ValueError):
        schema_from_codes(["a"], "z")


def test_headers_in_another_order(spark, frame, place):
    df = frame(ROWS, SCHEMA)
    write_table(df, f"{place}/a")
    write_table(df.select("DP", "`Gene.refGene`", "Sample"), f"{place}/b")
    paths = [f"{place}/a", f"{place}/b"]
    with pytest.raises(Exception):
        scan_variants(spark, paths, SCHEMA, "G").collect()
    got = values(scan_variants(spark, paths, SCHEMA, "G", by_name=True))
    assert got == [("s1", "G", "0.1,0.2", 20), ("s1", "G", None, 20), ("s3", "G", None, None),
                   ("s3", "G", None, None)]


def test_a_file_without_its_first_column_is_kept_and_one_without_header_refused(spark, frame, place):
    df = frame(ROWS, SCHEMA)
    write_table(df.select("DP", "`Gene.refGene`"), f"{place}/a")
    got = values(scan_variants(spark, f"{place}/a", SCHEMA, "G", by_name=True))
    assert got == [(None, "G", None, 20), (None, "G", None, None)]
    frame([("s1,G,0.1,20",)], "value string").write.text(f"{place}/b")
    with pytest.raises(ValueError, match="no header line"):
        scan_variants(spark, [f"{place}/a", f"{place}/b"], SCHEMA, "G", by_name=True)


def test_a_row_of_column_names_is_no_header(spark, frame, place):
    """The header is the first line, whatever later lines hold."""
    lines = [("DP,AF,Gene.refGene,Sample",), ("20,0.5,G,S1",), ("21,AF,G,Sample",), ("S2,AF,Sample",),
             ('22,"0.1,0.2",G,"a ""quoted"" one"',)]
    frame(lines, "value string").coalesce(1).write.text(place)
    got = values(scan_variants(spark, place, SCHEMA, "G", by_name=True))
    assert got == [("S1", "G", "0.5", 20), ("Sample", "G", "AF", 21), ('a "quoted" one', "G", "0.1,0.2", 22)]
    whole = values(read_by_name(spark, place, SCHEMA))
    assert len(whole) == 4 and (None, "Sample", "AF", None) in whole
    assert [r.header for r in header_catalogue(spark, place).collect()] == [lines[0][0]]


def test_a_required_column(spark, frame, place):
    write_table(frame(ROWS, SCHEMA).select("Sample", "DP"), place)
    with pytest.raises(ValueError, match="Gene.refGene missing"):
        read_by_name(spark, place, SCHEMA, required=["Gene.refGene"])


def test_quotes_within_quotes_read_by_hand(spark, frame, place):
    frame([("Sample\tGene.refGene\tAF\tDP",), ('"say ""hi"" now"\tG\t"a\tb"\t3',), ('""""\t""\tNA\t4',)],
          "value string").coalesce(1).write.text(place)
    got = values(read_table(spark, place, SCHEMA, sep="\t"))
    assert got == [('"', "", None, 4), ('say "hi" now', "G", "a\tb", 3)]


def test_landing_lets_the_gene_reach_the_scan(spark, frame, place):
    import glob

    import pyarrow.parquet as pq
    rows = [(f"s{i}", f"G{i % 40:02d}", "0.5", i) for i in range(4000)]
    land_calls(frame(rows, SCHEMA), place, files=8)
    gene = landed_variants(spark, place, SCHEMA, "G07")
    assert values(gene) == sorted(r for r in rows if r[1] == "G07")
    plan = gene._jdf.queryExecution().toString()
    assert "EqualTo(Gene_refGene,G07)" in plan
    ranges = []
    for path in glob.glob(f"{place}/*.parquet"):
        group = pq.ParquetFile(path).metadata.row_group(0)
        stats = next(c for c in map(group.column, range(group.num_columns)) if c.path_in_schema == "Gene_refGene").statistics
        ranges.append((stats.min, stats.max))
    assert len(ranges) > 4 and sum(low <= "G07" <= high for low, high in ranges) <= 2


def test_named_sinks_and_stages(spark, frame, place):
    df = frame(ROWS, SCHEMA)
    for path in save_named(df, "calls", [f"{place}/x", f"{place}/y/"]):
        assert path.endswith("/calls") and values(read_table(spark, path, SCHEMA)) == values(df)
    assert values(stage(df, "calls")) == values(df)
    assert values(stage(df.repartition(3), "calls", compact=True)) == values(df)
    with pytest.raises(TypeError):
        save_named([1], "list", [place])
    with pytest.raises(Exception):
        save_named(df, "calls", [f"{place}/x"])  # nothing is overwritten unasked


def test_stream_takes_each_file_once(spark, frame, place):
    def run():
        stream_variants(spark, f"{place}/in", SCHEMA, "G", f"{place}/out", f"{place}/progress",
                        max_files=1, out_files=1).awaitTermination()
        return values(read_ingested(spark, f"{place}/out", SCHEMA), "Sample")

    df = frame(ROWS, SCHEMA)
    write_table(df.repartition(3), f"{place}/in")
    assert run() == [("s1",), ("s3",)]
    write_table(df.limit(1), f"{place}/in", mode="append")
    assert run() == [("s1",), ("s1",), ("s3",)]
    assert run() == [("s1",), ("s1",), ("s3",)]


def test_odd_files_are_listed_and_an_unrecorded_batch_leaves_nothing_twice(spark, frame, place):
    from pathlib import Path

    def run():
        stream_variants(spark, f"{place}/in", SCHEMA, "G", f"{place}/out", f"{place}/progress",
                        max_files=2).awaitTermination()
        return values(read_ingested(spark, f"{place}/out", SCHEMA), "Sample", "AF")

    df = frame(ROWS, SCHEMA)
    write_table(df.repartition(3), f"{place}/in")
    write_table(df.select("DP", "Sample", "`Gene.refGene`", "AF").coalesce(1), f"{place}/in", mode="append")
    want = [("s1", "0.1,0.2"), ("s3", None)]
    assert run() == want
    listed = read_quarantine(spark, f"{place}/out-quarantine").collect()
    assert [r.header for r in listed] == ["DP,Sample,Gene.refGene,AF"]
    # as if the driver was lost after the last batch was written and before it was recorded
    commits = sorted((p for p in Path(f"{place}/progress/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last = commits[-1].name
    for p in (commits[-1], commits[-1].with_name(f".{last}.crc")):
        p.unlink(missing_ok=True)
    assert run() == want
    assert len(read_quarantine(spark, f"{place}/out-quarantine").collect()) == 1


def test_a_person_comes_from_one_folder(spark, frame):
    from cohort_spark.sources.people import by_person
    rows = [(i % 50 if i % 7 else None, f"t{i % 5}", float(i)) for i in range(2000)] + [(3, "hot", float(i)) for i in range(1500)]
    df = frame(rows, "person_id long, term string, value double")
    kept = by_person(df, "rows", buckets=8, spread=["value"])
    assert values(kept.rows()) == values(df)
    for person in (3, 11, None, 999):
        assert values(kept.of(person)) == values(df.where(df.person_id.eqNullSafe(person)))
    plan = kept.of(11)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*person_bucket#\d+ = \d", plan)
    with pytest.raises(ValueError, match="of its own"):
        by_person(df.withColumnRenamed("value", "person_bucket"), "rows")
