"""Each stage against a plain version, on a small table with hot groups."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohort_spark.llm import mixing, worker
from cohort_spark.sources.stages import stage
from llm.test_llm_operators import classes_by_hand, grams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = corpus_pipeline.table(spark, SF, "documents"), []
    out.append(docs.toPandas())
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF), name)
        out.append(docs.toPandas())
    return out


def test_columns(steps):
    assert all(list(x.columns) == list(steps[0].columns) for x in steps[:-1])


def test_language(steps):
    letters = [i for i, t in zip(steps[0].doc_id, steps[0].text) if any(c.isalpha() for c in t or "")]
    assert sorted(steps[1].doc_id) == sorted(letters)


def test_near_duplicates(steps):
    classes, _ = classes_by_hand(list(zip(steps[1].doc_id, steps[1].text)), 5, 80)
    assert sorted(steps[2].doc_id) == sorted(set(classes.values()))


def test_decontamination(spark, steps):
    items = [grams(r.text, 5) for r in corpus_pipeline.table(spark, SF, "benchmark").collect()]
    clean = [i for i, t in zip(steps[2].doc_id, steps[2].text)
             if not any(len(x & grams(t, 5)) >= 0.8 * len(x) for x in items if x)]
    assert sorted(steps[3].doc_id) == sorted(clean)


def test_mixing(steps):
    before, after = steps[3], Counter(steps[4].doc_id)
    size = before.text.map(lambda t: len(t.encode().split()))
    per = before.assign(size=size, taken=[after[i] * n for i, n in zip(before.doc_id, size)]).groupby("source")[["size", "taken"]].sum()
    targets = mixing.fair_shares(list(per["size"]), [(5, 2, 1)[i % 3] for i in range(len(per))])
    assert max(after.values()) <= 3 and set(after) <= set(before.doc_id)
    assert (abs(per.taken - targets) <= 0.02 * per["size"] + 20).all()


def test_sharding(steps):
    assert Counter(steps[5].doc_id) == Counter(steps[4].doc_id)
    for _, part in steps[5].groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_stages_keep_columns_of_any_name_and_odd_rows(spark, hard):
    """Nulls, empty texts, repeated rows, and columns named as those that operators make."""
    names = ("col", "copies", "target", "source_size", "lang_pred", "score", "_given_0", "label", "vid", "th", "n")
    docs = hard.withColumns({name: F.concat(F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for name in names})
    docs = stage(docs.withColumn("size", F.lit("x")), "docs")
    given = {str(tuple(r)) for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), name)
        rows = docs.collect()
        assert rows and {str(tuple(r)) for r in rows} <= given and docs.columns[-1] == "size"
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert set(docs.columns) | {"shard", "slot"} <= set(last.columns) and last.count() == len(rows)


def test_stages_of_an_empty_table(spark, documents):
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, documents([]), SF)
        assert docs.collect() == []


def test_run_is_the_stages_in_turn(spark, steps):
    got = corpus_pipeline.run(spark, SF).toPandas()
    columns = ["doc_id", "text", "shard"]
    assert Counter(map(tuple, got[columns].values.tolist())) == Counter(map(tuple, steps[5][columns].values.tolist()))


@pytest.mark.parametrize("step", [corpus_pipeline.language_id, corpus_pipeline.mixing])
def test_stages_written_later_send_workers_few_texts_at_once(spark, documents, step):
    docs = documents([(1, "the text of one", "en", "a"), (2, "le texte de deux", "fr", "b")])
    try:
        for own, most in (("10000", worker.TEXT_ROWS), ("7", 7)):
            spark.conf.set(worker.BATCH_ROWS, own)
            rows = step(spark, docs, SF)
            assert int(spark.conf.get(worker.BATCH_ROWS)) == most and rows.count() >= 2
    finally:
        spark.conf.unset(worker.BATCH_ROWS)
