"""Every operator on hard rows, on empty tables and with clashing column names."""

import sys
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohort_spark.llm import chat, decontamination, jaccard_join, language, language_model, lines
from cohort_spark.llm import mixing, neighbours, sharding, token_counts

ITEMS = "item_id long, text string"
NO_TOKENS = SimpleNamespace(value=(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))


def count_tokens(docs, pieces):
    return token_counts.count_tokens(docs, pieces)


def identify(docs, pieces):
    return language.identify(docs, language.learn(docs, pieces))


def lm_score(docs, pieces):
    return language_model.score(docs, language_model.learn(docs, pieces))


def join(docs, pieces):
    return jaccard_join.with_components(jaccard_join.jaccard_join(docs)[0])


def dedup(docs, pieces):
    return lines.dedup_lines(docs)


def mix(docs, pieces):
    return mixing.mix(docs)


def shard(docs, pieces):
    return sharding.shard(docs, 5)


ALL = [count_tokens, identify, lm_score, join, dedup, mix, shard]


@pytest.mark.parametrize("work", ALL)
def test_hard_rows(hard, pieces, work):
    out = work(hard, pieces)
    assert out.count() == hard.count()
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(map(str, (r.doc_id for r in hard.collect())))


@pytest.mark.parametrize("work", ALL)
def test_empty_table(documents, pieces, work):
    assert work(documents([]), pieces).collect() == []


@pytest.mark.parametrize("work", ALL)
def test_clashing_columns(documents, pieces, work):
    docs = documents([(1, "the thing and more of it", "en", "a"), (2, "le du et la", "fr", "b")])
    for name in ("size", "score", "n_tokens", "key", "n", "_gone", "vid", "label", "row", "slot", "shard", "copies",
                 "target", "word", "token", "value", "base", "lang_pred", "uid", "th", "bucket", "part"):
        docs = docs.withColumn(name, F.lit("x"))
    assert work(docs, pieces).count() == 2


def test_contained_cases(spark, hard, documents):
    items = spark.createDataFrame([(1, "the same text as the other one is here twice"), (2, None), (3, ""), (None, "w1 the tion w2 the tion w3"),
                                   (4, "last")], ITEMS)
    found = {(r.doc_id, r.item_id) for r in decontamination.contained(hard, items).collect()}
    assert found == {(7, 1), (8, 1), (5, None)}
    assert decontamination.contained(documents([]), items).collect() == []
    assert decontamination.contained(hard, items.limit(0)).collect() == []


def test_neighbour_cases(spark):
    kind = "vec_id long, embedding array<float>, vec string, mix string"
    rows = [(0, [1.0, 0.0], "x", "y"), (1, [1.0, 0.0], None, None), (2, [1.0, 0.0], None, None), (3, None, None, None),
            (4, [0.0, 0.0], None, None), (5, [None, 1.0], None, None), (6, [float("nan"), 1.0], None, None),
            (7, [float("inf"), 1.0], None, None), (8, [0.5, 0.5], None, None), (None, [1.0, 0.0], None, None),
            (9, [1.0], None, None), (2, [1.0, 0.0], None, None), (20, [0.0, 1.0], None, None)]
    got = [tuple(r) for r in neighbours.neighbours(spark.createDataFrame(rows, kind)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 8, 0.5), (0, 4, 20, 0.0),
                   (20, 1, 8, 0.5), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    assert neighbours.neighbours(spark.createDataFrame([], kind)).collect() == []


def test_chat_cases(spark):
    kind = "conv_id long, turn long, role string, text string, content string"
    rows = [(1, 0, "user", "hi\nthere?", "x"), (1, 1, None, None, None), (None, None, None, "Assistant: yes", None),
            (1, 0, "user", "hi\nthere?", "x"), (2, 0, "bot", "", None), (2, None, "odd", "Q: a\nA: b", None)]
    turns = spark.createDataFrame(rows, kind)
    out = chat.parse(turns, chat.learn(turns)).collect()
    assert {(r.conv_id, r.turn, r.part, r.role, r.content, r.copies) for r in out} >= {
        (1, 0, 0, "user", "hi\nthere?", 2), (None, None, 0, "assistant", "yes", 1),
        (2, None, 0, "user", "a", 1), (2, None, 1, "assistant", "b", 1)}
    empty = spark.createDataFrame([], kind)
    assert chat.parse(empty, chat.learn(empty)).collect() == []


@pytest.mark.parametrize("task", [language._count_words, jaccard_join._frequent(3), jaccard_join._signatures(NO_TOKENS, 3, 90)])
def test_tasks_hold_few_texts_as_objects(task):
    """A batch of texts takes several times its size as strings, so tasks make them a few at a time."""
    text = " ".join(["漢字 the word"] * 600)
    two = pa.array([text] * 200, pa.string())
    batch = pa.RecordBatch.from_arrays([two, two, two], names=["a", "b", "c"])
    tracemalloc.start()
    for _ in task(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.5 * 200 * sys.getsizeof(text)


def test_verified_pairs_keep_few_tokens(monkeypatch):
    """Links are the same however few of the texts' tokens a task keeps."""
    texts = [" ".join(f"w{j}" for j in range(i, i + 80)) for i in range(12)]
    pairs = [(i, j) for i in range(12) for j in range(i + 1, 12)]
    batch = pa.RecordBatch.from_pydict({"a": [i for i, _ in pairs], "b": [j for _, j in pairs],
                                        "left": [texts[i] for i, _ in pairs], "right": [texts[j] for _, j in pairs]})
    linked = lambda: [r for b in jaccard_join._links(90, 3)(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns))]
    want = [(i, j) for i, j in pairs if 100 * (78 - (j - i)) >= 90 * (78 + (j - i))]
    assert linked() == want
    monkeypatch.setattr(jaccard_join, "MOST_TOKENS", 100)
    assert linked() == want
