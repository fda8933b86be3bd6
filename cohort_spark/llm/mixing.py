"""Mixing sources to target weights by entropy balancing.

Every document gets a rate: how often the mix takes it, ``MOST_COPIES`` times at
most.  Among all rates within that bound that meet each source's constraint on
words, the balanced ones are nearest to 1 in relative entropy.  The convex dual
has one multiplier a source, and its solution tilts documents exponentially in
their size up to the bound, ``rate = min(3, exp(b * size / mean))``: a source
that is to give less gives fewer of its long documents.  Newton steps solve
it, kept between bounds that each step narrows; an iteration is one aggregate
over (source, size, documents) rows, grouped by source.

Rates become whole copies in two steps.  Documents of one source and one size
have one rate, so a source needs copies per size only: whole numbers that carry
the rounding error from the largest size down to the smallest, where it ends as
a few words.  Then the copies of a size are dealt to its documents by the rank
of a hash; ranks are gapless (see ``ranks``), so a size that holds a third of
all documents is no single task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.llm.ranks import ranked
from cohort_spark.llm.tables import spare
from cohort_spark.sources.stages import stage

#: A document is taken so many times at most.
MOST_COPIES = 3
#: Steps before an error is raised (halving alone ends sooner), and the relative miss that ends them.
STEPS, MISS = 200, 1e-9


def _count_words(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([len(x.encode("utf-8", "surrogatepass").split()) if x else 0 for x in part], dtype="int64")


def word_count(text: str | Column) -> Column:
    """Runs of characters other than blank, tab, line feed, vertical tab, form feed, return."""
    return F.pandas_udf(_count_words, "long")(F.col(text) if isinstance(text, str) else text)


def fair_shares(sizes: list[float], weights: list[float], most: float = MOST_COPIES) -> list[float]:
    """Targets by weight that stop at ``most`` times a size; the excess goes by weight to the rest."""
    total, targets = math.fsum(sizes), [0.0] * len(sizes)
    left, capped = total, [False] * len(sizes)
    while True:
        weight = math.fsum(w for w, done in zip(weights, capped) if not done)
        if weight <= 0:
            return targets
        above = False
        for i, size in enumerate(sizes):
            if not capped[i]:
                targets[i] = left * weights[i] / weight
        for i, size in enumerate(sizes):
            if not capped[i] and targets[i] > most * size:
                targets[i], capped[i], above = most * size, True, True
        if not above:
            return targets
        left = total - math.fsum(t for t, done in zip(targets, capped) if done)


def source_targets(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """(source, source_size, n_docs, target): one row a source, the repeating weights by name, null last.

    The list of sources is read to the driver: it is a list of names, one row
    each, not of documents.
    """
    rows = (sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"),
                                        F.sum("n").alias("n_docs")).collect())
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    targets = fair_shares([float(r.source_size) for r in rows],
                          [weights[i % len(weights)] for i in range(len(rows))])
    return sizes.sparkSession.createDataFrame(
        [(r.source, r.source_size, r.n_docs, t) for r, t in zip(rows, targets)],
        "source string, source_size long, n_docs long, target double")


def balance(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, mean, b): the dual's solution for every source with words.

    ``sizes`` holds (source, size, n).  The words taken grow with ``b``: a step
    of Newton's that leaves the bracket found so far is replaced by its middle,
    or by a doubling where one side is still open.  A target of
    ``MOST_COPIES`` times all words is met once every rate is at the bound, one
    of none only in the limit, where it counts as met when no word is left.
    """
    spark = sizes.sparkSession
    goals = {r.source: (r.source_size / r.n_docs, r.target) for r in targets.collect() if r.source_size > 0}
    found = {source: 0.0 for source in goals}
    bracket = {source: [-math.inf, math.inf] for source in goals}
    schema = "source string, mean double, b double"
    for _ in range(STEPS):
        now = spark.createDataFrame([(s, goals[s][0], found[s]) for s in goals], schema)
        x, most = F.col("size") / F.col("mean"), float(MOST_COPIES)
        # beyond the bound a rate no longer moves
        tilt = F.exp(F.least(F.col("b") * x, F.lit(math.log(most))))
        free = F.when(F.col("b") * x < math.log(most), F.col("n") * F.col("size") * x * tilt).otherwise(0.0)
        sums = (sizes.withColumnRenamed("source", "_s").join(now, F.col("_s").eqNullSafe(F.col("source")))
                .groupBy("source").agg(F.sum(F.col("n") * F.col("size") * tilt).alias("words"), F.sum(free).alias("slope"))
                .collect())
        met = True
        for row in sums:
            target, b, sides = goals[row.source][1], found[row.source], bracket[row.source]
            gap = row.words - target
            if abs(gap) <= MISS * max(target, 1.0):
                continue
            met = False
            sides[gap > 0] = b
            step = b - gap / row.slope if row.slope > 0 else math.nan
            if not sides[0] < step < sides[1]:
                if math.isinf(sides[0]) or math.isinf(sides[1]):
                    step = 2 * b + (1.0 if gap < 0 else -1.0)
                else:
                    step = (sides[0] + sides[1]) / 2
            found[row.source] = step
        if met:
            return now
    raise RuntimeError(f"entropy balancing has not met its constraints after {STEPS} steps")


def whole_copies(cells: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
    """Copies for each size of one source, largest size first, the error carried on.

    One row a distinct size: a source of W words has fewer than sqrt(2 W) + 1.
    """
    cells = cells.sort_values("size", ascending=False)
    owed, out = 0.0, np.zeros(len(cells), dtype=np.int64)
    for i, (size, n, rate) in enumerate(zip(cells["size"].to_numpy(), cells["n"].to_numpy(), cells["rate"].to_numpy())):
        want = n * rate + (owed / size if size else 0.0)
        out[i] = min(max(round(want), 0), MOST_COPIES * n)
        owed += (n * rate - out[i]) * size
    return cells.assign(copies=out)[["source", "size", "n", "copies"]]


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), size: str | Column | None = None,
        text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (0 to 3).

    ``size`` is the given column, or else the number of words of the whole
    text, 0 for a missing or empty one.  Sources take the repeating ``weights`` in the order of their names,
    a missing source last.  A document without words is taken once.  Repeated
    rows count one by one; those that agree in id and text share their copies
    in any order.  An empty table gives an empty result.  Columns of the
    results' names are replaced.
    """
    sized = word_count(text) if size is None else F.col(size) if isinstance(size, str) else size
    base = docs.withColumn("size", sized.cast("long")).drop("source_size", "target", "copies")
    sizes = stage(base.groupBy(F.col(source).alias("source"), "size").agg(F.count("*").alias("n")), "sizes")
    targets = source_targets(sizes, weights)
    solved = balance(sizes, targets)
    rates = (sizes.withColumnRenamed("source", "_s").join(solved, F.col("_s").eqNullSafe(F.col("source")), "left")
             .select(F.col("_s").alias("source"), "size", "n",
                     F.when(F.col("b").isNull() | (F.col("size") == 0), F.lit(1.0))
                     .otherwise(F.exp(F.least(F.col("b") * F.col("size") / F.col("mean"), F.lit(math.log(MOST_COPIES)))))
                     .alias("rate")))
    planned = rates.groupBy("source").applyInPandas(whole_copies, "source string, size long, n long, copies long")
    p = spare(base)
    plan = stage(planned.withColumnRenamed("source", "_s").join(targets, F.col("_s").eqNullSafe(F.col("source")))
                 .select(F.col("_s").alias(f"{p}s"), F.col("size").alias(f"{p}size"), F.col("n").alias(f"{p}n"),
                         F.col("copies").alias(f"{p}copies"), "source_size", "target"), "plan")
    dealt = ranked(base, [source, "size"], [doc_id], f"{p}at")
    fair = F.expr(f"{p}copies div {p}n") + (F.col(f"{p}at") < F.col(f"{p}copies") % F.col(f"{p}n")).cast("long")
    return (dealt.join(plan, F.col(source).eqNullSafe(F.col(f"{p}s")) & (F.col("size") == F.col(f"{p}size")))
            .withColumn("copies", fair.cast("int"))
            .drop(f"{p}s", f"{p}size", f"{p}n", f"{p}copies", f"{p}at"))
