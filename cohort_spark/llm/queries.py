"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_spark.llm import chat, language, language_model
from cohort_spark.llm.decontamination import CONTAINED_SQL, contained
from cohort_spark.llm.jaccard_join import jaccard_join, with_components
from cohort_spark.llm.lines import LINES_SQL, dedup_lines
from cohort_spark.llm.mixing import mix, word_count
from cohort_spark.llm.neighbours import neighbours
from cohort_spark.llm.phrases import COLLOCATIONS_SQL, collocations
from cohort_spark.llm.repair import REPAIR_SQL, damaged_and_repaired
from cohort_spark.llm.sharding import shard
from cohort_spark.llm.simhash import digits, simhash_groups
from cohort_spark.llm.tables import fold, table
from cohort_spark.llm.token_counts import count_tokens
from cohort_spark.sources.stages import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The model whose tokens op4 counts, and the tokens a document may have.
TOKEN_MODEL, TOKEN_LIMIT = "piece_bpe_32k.model", 4096
#: The vocabulary of the lattices of op8 and op10.
PIECES = "piece_bpe_32k.model"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_ngram_jaccard_join(spark, sf_dir):
    classes, _ = jaccard_join(table(spark, sf_dir, "documents"))
    return with_components(classes)


@query(CONTAINED_SQL)
def op2_decontamination(spark, sf_dir):
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(LINES_SQL)
def op3_line_dedup(spark, sf_dir):
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op4_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counted = count_tokens(docs, vocabulary(TOKEN_MODEL))
    return counted.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
                          "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query()
def op5_nearest_neighbours(spark, sf_dir):
    return neighbours(table(spark, sf_dir, "embeddings"))


@query()
def op6_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = stage(docs.select("doc_id", "source", word_count("text").alias("size")), "sized")
    mixed = mix(sized, size="size")
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies",
                        (F.col("copies") * F.col("size")).alias("taken"))


@query()
def op7_sharding(spark, sf_dir):
    sharded = shard(table(spark, sf_dir, "documents"), 24)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))


@query()
def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    languages = language.learn(docs.where(~held_out), vocabulary(PIECES))
    return language.identify(docs.select("doc_id", "text", held_out.alias("held_out")), languages).drop("text")


@query()
def op9_chat_formatting(spark, sf_dir):
    """Roles from lines and markers alone; the given ones teach part of the conversations and stand beside."""
    turns = table(spark, sf_dir, "conversations")
    model = chat.learn(turns.where(fold("conv_id", 4) != 2))
    found = chat.parse(turns, model, speaker=None).drop("speaker")
    given = (turns.groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
             .agg(F.min("role").alias("given_role")))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
    return found.join(given, same, "left").drop("c", "t").withColumn("held_out", fold("conv_id", 4) == 2)


@query()
def op10_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 10) == 0
    model = language_model.learn(docs.where(~held_out), vocabulary(PIECES))
    return language_model.score(docs.select("doc_id", "text", held_out.alias("held_out")), model)


@query(COLLOCATIONS_SQL)
def op11_phrase_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


@query(REPAIR_SQL)
def op12_conversation_repair(spark, sf_dir):
    return damaged_and_repaired(table(spark, sf_dir, "conversations"))


@query()
def op13_simhash_near_dedup(spark, sf_dir):
    groups, _ = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", digits("fp").alias("fingerprint"), "component_id")
