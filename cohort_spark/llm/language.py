"""Language by unigrams over a fixed public vocabulary, summed over segmentations.

Each language has a probability for every piece of the vocabulary.  A word's
likelihood is the sum over all its segmentations (``lattice``), a text's the
product over its words, and the language of the greatest likelihood wins.

Training is expectation maximisation on word counts of labelled texts, of
``SAMPLE_DOCS`` documents a language at most, the first in the order of a hash
of the id.  Each round is a pass over the counted words whose expected piece
uses are summed by Spark; the driver holds one number a piece and language.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.llm.lattice import Lattice, Weights
from cohort_spark.llm.tables import mixed, spare
from cohort_spark.llm.worker import held, one_by_one
from cohort_spark.sources.stages import stage

#: Bound of the training sample and the rounds of training.
SAMPLE_DOCS, ROUNDS = 4000, 2
#: Words a worker keeps, longest word kept.
CACHED, LONGEST = 300_000, 48
_WORDS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORDS.findall(text.lower())


@dataclass
class Languages:
    """Names and, in the same order, log probabilities of pieces."""

    vocabulary: str
    names: list[str]
    logp: list[np.ndarray]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(one_by_one(batch.column(0)), one_by_one(batch.column(1))):
            seen.setdefault(lang, Counter()).update(letters(text or ""))
    for lang, words in seen.items():
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(words), pa.string()),
                                          "word": pa.array(list(words), pa.string()),
                                          "n": pa.array(list(words.values()), pa.int64())})


def piece_uses(words: DataFrame, vocabulary: str, models: dict[str | None, np.ndarray], lower: bool) -> dict[str, np.ndarray]:
    """Expected uses of each piece by language over (lang, word, n) rows, one row a piece from each task."""
    tables = words.sparkSession.sparkContext.broadcast(models)

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice.of_model(vocabulary, lower)
        weights = {lang: Weights(p) for lang, p in tables.value.items()}
        out = {lang: [0.0] * len(lattice) for lang in weights}
        for batch in batches:
            for lang, word, n in zip(*[c.to_pylist() for c in batch.columns]):
                lattice.expect(word, n, weights[lang], out[lang])
        for lang, counts in out.items():
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(found), pa.string()),
                                              "piece": pa.array(found, pa.int32()),
                                              "uses": pa.array(np.array(counts)[found], pa.float64())})

    rows = (words.select("lang", "word", "n").mapInArrow(uses, "lang string, piece int, uses double")
            .groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas())
    size = len(next(iter(models.values()))) if models else 0
    out = {lang: np.zeros(size) for lang in models}
    for lang, part in rows.groupby("lang", dropna=False):
        out[None if pd.isna(lang) else lang][part["piece"]] = part["uses"]
    return out


def learn(docs: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
          sample: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> Languages:
    """Fits one unigram a language on labelled ``docs``; rows without a label or text teach nothing."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), mixed(doc_id).alias("_mix"))
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    names = sorted(sizes)
    lattice = Lattice.of_model(vocabulary)
    if not names:
        return Languages(vocabulary, [], [])
    # a share somewhat above the bound first, so that the exact bound sorts few rows
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, 1.3 * sample / n + 50.0 / n))).otherwise(share)
    place = F.shiftrightunsigned("_mix", 11) / float(1 << 53)
    first = Window.partitionBy("lang").orderBy("_mix", "text")
    chosen = labelled.where(place <= share).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= sample)
    words = stage(chosen.repartition(chosen.sparkSession.sparkContext.defaultParallelism).select("lang", "text")
                  .mapInArrow(_count_words, "lang string, word string, n long")
                  .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    models = {name: np.log(lattice.prior) for name in names}
    for _ in range(rounds):
        found = piece_uses(words, vocabulary, models, False)
        models = {name: lattice.fitted(found[name]) for name in names}
    return Languages(vocabulary, names, [models[name] for name in names])


class _Scores(dict):
    """The row of each word in a table of its log likelihoods, a row a word, a column a language."""

    def __init__(self, languages: Languages, most: int):
        super().__init__()
        self.lattice = Lattice.of_model(languages.vocabulary)
        self.weights = [Weights(p) for p in languages.logp]
        self.table, self.most = np.zeros((most, len(self.weights))), most

    def __missing__(self, word: str) -> int:
        row = len(self)
        self.table[row] = self.lattice.score(word, self.weights)
        self[word] = row
        return row

    def of(self, words: list[str]) -> np.ndarray:
        """Sums of the words' likelihoods."""
        total = np.zeros(len(self.weights))
        for at in range(0, len(words), self.most):
            part = words[at:at + self.most]
            if len(self) + len(part) > self.most:  # rows must stand until they are summed
                self.clear()
            kept = [w for w in part if len(w) <= LONGEST]
            if len(kept) < len(part):
                total += np.sum([self.lattice.score(w, self.weights) for w in part if len(w) > LONGEST], axis=0)
            total += self.table[[self[w] for w in kept]].sum(axis=0)
        return total


def has_letter(text: str | Column) -> Column:
    whole = F.col(text) if isinstance(text, str) else text
    return F.coalesce(whole.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, languages: Languages, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the winner's share of the likelihood (0 to 1).

    A missing or empty text, one without letters, or a model without languages
    gives ``und`` and 0.  Equal likelihoods go to the first name.  Texts of any
    length are read whole; repeated rows are rows; an empty table gives an empty
    result; columns of the results' names are replaced.
    """
    known = docs.sparkSession.sparkContext.broadcast(languages)
    key = uuid.uuid4().hex

    @F.arrow_udf("lang_pred string, score double")
    def winner(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = known.value
        likelihoods = held(key, lambda: _Scores(model, CACHED))
        for part in parts:
            names, scores = [], []
            for whole in one_by_one(part):
                words = letters(whole) if whole and model.names else []
                if not words:
                    names.append("und")
                    scores.append(0.0)
                    continue
                sums = likelihoods.of(words)
                best = sums.max()
                names.append(model.names[int(sums.argmax())])
                scores.append(1.0 / float(np.exp(sums - best).sum()))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["lang_pred", "score"])

    rest = docs.drop("lang_pred", "score")
    found = f"{spare(rest)}found"
    return (rest.withColumn(found, winner(F.col(text)))
            .select(*rest.columns, F.when(has_letter(text), F.col(f"{found}.lang_pred")).otherwise("und").alias("lang_pred"),
                    F.when(has_letter(text), F.col(f"{found}.score")).otherwise(0.0).alias("score")))
