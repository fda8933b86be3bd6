"""Scores of texts under a subword lattice model and a word unigram base.

Lattice: the scores of a public vocabulary weigh all segmentations of a word,
and the forward recursion gives the marginal probability of the word.  The
weights start from those scores, and a round of expectation maximisation over
the words of all training texts, as often as they occur, fits them.  A text is
its words and an end, which comes after a word with the training texts' share:

    p(text) = prod (1 - e) lattice(word) * e,  e = (ends + 1) / (N + 2)

No count of a whole word enters it, so a word that training lacks is judged by
its pieces like any other.

Base: add-one-tenth unigrams over the training tokens, exact.  Counts of the
most frequent words, of a bounded number of entries, go to every task.  Other
words of a document meet their counts in a join on the word, a few rows a
document, whose sums return by row.  The join sorts by word, so such a word's
lattice is worked out behind it, once for all documents.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import e, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.llm.language import piece_uses
from cohort_spark.llm.lattice import Lattice, Weights
from cohort_spark.llm.tables import most_frequent
from cohort_spark.llm.worker import held, one_by_one
from cohort_spark.operators.joins import shuffled
from cohort_spark.sources.stages import stage

#: Entries of the broadcast table of frequent words; other words a worker keeps, longest one kept.
FREQUENT, CACHED, LONGEST = 1 << 17, 200_000, 48
#: Words of a task's counter before its rows are sent on.
COUNTED = 400_000


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in seen], pa.string()),
                                           "n": pa.array(list(seen.values()), pa.int64())})

    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(words_of(text))
            if len(seen) > COUNTED:
                yield rows(seen)
                seen = Counter()
    yield rows(seen)


@dataclass
class Model:
    """What scoring needs of the training texts; ``counts`` (word, n) stays a table."""

    vocabulary: str
    counts: DataFrame
    logp: np.ndarray
    ends: int
    tokens: int
    distinct: int

    def base(self, count: Column | int) -> Column:
        """log10 of the base's probability of a token seen ``count`` times."""
        seen = F.lit(count) if isinstance(count, int) else count
        return F.log10((seen + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))

    @property
    def end(self) -> float:
        """The model's probability that a text ends after a word, or before the first."""
        return (self.ends + 1) / (self.tokens + 2)


def learn(docs: DataFrame, vocabulary: str, text: str = "text", rounds: int = 1) -> Model:
    """Counts the words of all texts of ``docs`` and fits piece weights to them.

    A missing text counts as empty: it has the end mark only.
    """
    counts = stage(docs.select(text).mapInArrow(_count_words, "word string, n long")
                   .groupBy("word").agg(F.sum("n").alias("n")), "counts")
    ends = docs.count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    lattice = Lattice.of_model(vocabulary, lower=True)
    logp = np.log(lattice.prior)
    for _ in range(rounds if total else 0):
        logp = lattice.fitted(piece_uses(counts.select(F.lit("").alias("lang"), "word", "n"), vocabulary, {"": logp}, True)[""])
    return Model(vocabulary, counts, logp, ends, total + ends, distinct + (1 if ends else 0))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Scores are log10 probabilities of the whole text: its words and one end
    mark, which a missing or empty text has alone.  Ids play no part, so missing
    and repeated ones are scored as rows; an empty table gives an empty result;
    columns of the results' names are replaced.
    """
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    frequent = {r.word.encode(): r.n for r in most_frequent(model.counts, "n", FREQUENT).collect()}
    n = model.tokens
    context = docs.sparkSession.sparkContext
    fitted, table = context.broadcast((model.vocabulary, model.logp)), context.broadcast(frequent)
    end_base = log10((model.ends + 0.1) / (n + 0.1 * (model.distinct + 1)))
    end_model, go_on = log10(model.end), log10(1 - model.end) if model.end < 1 else 0.0
    base_total, nat = log10(n + 0.1 * (model.distinct + 1)), log10(e)
    ends_known = 1 if model.ends else 0
    key, rest = uuid.uuid4().hex, docs.drop(*made)
    names = [c for c in rest.columns if c != text]
    given = rest.select(F.struct(*(names or [F.lit(0).alias("none")])).alias("row"), F.col(text).alias("text"))

    def scorer():
        vocabulary, logp = fitted.value
        lattice, weights = Lattice.of_model(vocabulary, lower=True), [Weights(logp)]
        return lambda word: lattice.score(word, weights)[0] * nat + go_on

    def known_words() -> dict[bytes, tuple[float, float]]:
        """The base's score and the lattice's of each frequent word."""
        score_of = scorer()
        return {word: (log10(c + 0.1) - base_total, score_of(word.decode("utf-8", "surrogatepass")))
                for word, c in table.value.items()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held(key, known_words).get
        for batch in batches:
            out = {k: [] for k in ("n_tokens", "n_known", "base", "score")}
            rare, times, ends = [], [], [0]
            for whole in one_by_one(batch.column(1)):
                words = words_of(whole)
                total, plain, hits = end_model, end_base, ends_known
                for word, m in Counter(words).items():
                    found = known(word)
                    if found is None:
                        rare.append(word)
                        times.append(m)
                    else:
                        hits += m
                        plain += m * found[0]
                        total += m * found[1]
                ends.append(len(rare))
                for k, value in zip(out, (len(words) + 1, hits, plain, total)):
                    out[k].append(value)
            others = pa.StructArray.from_arrays([pa.array(rare, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())],
                                                names=["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex for _ in range(len(batch))], pa.string()), batch.column(0),
                 pa.array(out["n_tokens"], pa.int64()), pa.array(out["n_known"], pa.int64()),
                 pa.array(out["base"], pa.float64()), pa.array(out["score"], pa.float64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), others)],
                names=["uid", "row", "n_tokens", "n_known", "base", "score", "rare"])

    @F.arrow_udf("double")
    def by_lattice(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score_of, kept = held(f"{key} rare", lambda: (scorer(), {}))
        for part in parts:
            coded = part.dictionary_encode()
            scores = []
            for word in coded.dictionary.to_pylist():
                x = kept.get(word)
                if x is None:
                    x = score_of(word)
                    if len(word) <= LONGEST:
                        if len(kept) >= CACHED:
                            kept.clear()
                        kept[word] = x
                scores.append(x)
            yield pa.array(scores, pa.float64()).take(coded.indices)

    kinds = given.schema["row"].dataType.simpleString()
    # written, so that a row's uid is the same wherever the table is read
    first = stage(given.mapInArrow(read, f"uid string, row {kinds}, n_tokens long, n_known long, base double, "
                                        "score double, rare array<struct<word:string,n:bigint>>"), "first")
    rare = first.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.n")
    counts, c = model.counts.select("word", F.col("n").alias("c")), F.coalesce("c", F.lit(0))
    found = (rare.join(shuffled(counts), "word", "left").withColumn("y", by_lattice("word"))
             .groupBy("uid").agg(F.sum(F.col("n") * model.base(c)).alias("more_base"),
                                 F.sum(F.col("n") * F.col("y")).alias("more_score"),
                                 F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known")))
    return first.join(found, "uid", "left").select(
        *[F.col(f"row.`{name}`").alias(name) for name in names], "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))
