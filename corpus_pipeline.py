"""A corpus pipeline over ``documents``, built from the operators of ``cohort_spark.llm``.

Language ID, near duplicates, decontamination, mixing and sharding, in this
order.  ``run`` writes each stage's rows to the shared folder and hands them to
the next, so a lost executor costs no finished stage.

Every stage takes documents with any further columns, whatever their names, and
gives them back as they came; only the last one adds (and replaces) ``size``,
``text_crc32``, ``shard`` and ``slot``.  An empty table gives an empty one.

Stages whose rows are computed when they are written lower the session's
``spark.sql.execution.arrow.maxRecordsPerBatch`` to ``TEXT_ROWS`` and leave it
so, as a batch holds whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_spark.llm import language
from cohort_spark.llm.decontamination import without_contaminated
from cohort_spark.llm.jaccard_join import one_of_each
from cohort_spark.llm.mixing import mix
from cohort_spark.llm.queries import PIECES, vocabulary
from cohort_spark.llm.sharding import shard
from cohort_spark.llm.tables import fold, spare, table
from cohort_spark.llm.worker import few_texts_from_now
from cohort_spark.sources.stages import stage

#: Words of a shingle and similarity (percent) of near duplicates; shards written.
WORDS, PERCENT, SHARDS = 5, 80, 24


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator gives a column of its own, and the new name of each."""
    names = {name: f"{spare(docs)}given_{i}" for i, name in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()]), names


def _back(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(new).alias(old) for old, new in names.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without text or letters go.

    A missing id or source stays as it is, repeated rows stay, a missing
    language label teaches nothing.  Without any label no document can be placed
    and none stays.
    """
    few_texts_from_now(spark)
    languages = language.learn(docs.where(fold("doc_id", 4) != 2), vocabulary(PIECES))
    given, names = _apart(docs)
    found = language.identify(given, languages, text=names["text"])
    return _back(found.where("lang_pred <> 'und'"), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    Of repeated rows one stays; a missing id is the smallest; documents without
    a word are in no group and all stay.
    """
    return one_of_each(docs, percent=PERCENT, k=WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark``.

    Items without words are in no document, a missing or empty text contains
    none, repeated rows are judged alike.
    """
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times or not at all.

    A document without words is taken once; a missing source is one of its own;
    repeated rows are mixed one by one.
    """
    few_texts_from_now(spark)
    given, names = _apart(docs)
    mixed = mix(given, text=names["text"], source=names["source"], doc_id=names["doc_id"]).where("copies > 0")
    times = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return _back(times, names)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and the place in it; rows of equal text stay together up to a shard's size."""
    return shard(docs, SHARDS)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Training and rounding have no SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
