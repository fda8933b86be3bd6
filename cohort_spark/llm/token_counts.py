"""Token counts by a two-tier lookup, without a shuffle of pre-tokens.

A piece model whose pieces hold the space mark only at their start never joins
text across the end of a word, so the tokens of a text are the sum over its
pre-tokens: a run of blanks and the characters up to the next blank.

Tier one: the token lengths of frequent pre-tokens, in one table of a bounded
number of entries that every task gets.  They are those of a sample of about
``SAMPLE_DOCS`` documents, drawn by a seed: the table decides speed only, so a
sample is enough.  Tier two: a pre-token not in the table is encoded once and kept in a
bounded cache of the Python worker.  The table and the cache decide speed only;
every count is the library's.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.llm.tables import most_frequent
from cohort_spark.llm.worker import held

#: Entries of the broadcast table, documents of the sample it comes from, entries of a worker's cache.
TABLE, SAMPLE_DOCS, CACHED = 1 << 16, 8000, 1 << 18
#: Longer pre-tokens are encoded each time they occur and never kept.
LONGEST = 48
_LOADED: dict[str, object] = {}


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without their first blank; the model puts one before a text."""
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [run[1:] for run in re.findall(" +[^ ]*|[^ ]+", " " + text)]


def model(path: str):
    """The piece model, loaded once in each worker, and checked for the rule above."""
    if path not in _LOADED:
        import sentencepiece

        loaded = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(re.search("[^▁]▁", loaded.id_to_piece(i)) for i in range(loaded.vocab_size())):
            raise ValueError("a piece of this model reaches over the end of a word")
        _LOADED[path] = loaded
    return _LOADED[path]


class Lengths(dict):
    """Token counts of pre-tokens; unknown ones are encoded and kept up to a bound."""

    def __init__(self, path: str, table: dict[str, int], kept: int = CACHED):
        super().__init__(table)
        self.encode, self.table, self.most = model(path).encode, table, len(table) + kept
        self[""] = 1  # a blank that ends the text is a token

    def __missing__(self, key: str) -> int:
        n = len(self.encode(key))
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
                self.update(self.table)
                self[""] = 1
            self[key] = n
        return n

    def of(self, text: str | None) -> int:
        return sum(map(self.__getitem__, pre_tokens(text))) if text else 0


def _worker_lengths(key: tuple[str, str, int], table) -> Lengths:
    """Both tiers of this worker; they outlive a task and go with the next call's table."""
    return held(key, lambda: Lengths(key[0], table.value, key[2]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                seen.update(pre_tokens(text))
    kept = [(k, n) for k, n in seen.items() if len(k) <= LONGEST]
    yield pa.RecordBatch.from_pydict({"piece": pa.array([k for k, _ in kept], pa.string()),
                                      "n": pa.array([n for _, n in kept], pa.int64())})


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", entries: int = TABLE) -> dict[str, int]:
    """Token counts of the pre-tokens that occur most often in a sample of the texts, ``entries`` at most."""
    share = SAMPLE_DOCS / max(1, docs.count())
    picked = docs.select(text).where(F.rand(7) <= share)
    counted = (picked.mapInArrow(_counted, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
               .where("n > 1"))
    words = [row.piece for row in most_frequent(counted, "n", entries).select("piece").collect()]
    encode = model(path).encode
    return dict(zip(words, map(len, encode(words, num_threads=1)))) if words else {}


def count_tokens(docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens",
                 entries: int = TABLE, kept: int = CACHED) -> DataFrame:
    """``docs`` with the tokens of each whole text as the model at ``path`` gives them.

    No begin, end or other special tokens; their strings in a text are ordinary
    text.  A missing or empty text has 0 tokens.  Repeated rows are counted one
    by one, an empty table gives an empty result, and a column of the result's
    name is replaced.  A very long text or word is encoded whole.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text, entries))
    key = (path, uuid.uuid4().hex, kept)

    @F.pandas_udf("long")
    def lengths(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tier = _worker_lengths(key, table)
        for part in parts:
            yield pd.Series([tier.of(x) for x in part], dtype="int64")

    return docs.withColumn(name, lengths(F.col(text)))
