"""Logistic regression of the case flag on cohort covariates.

Persons with equal covariates are counted first, so each pass reads covariate
patterns with their persons and cases.  A pass sums deviance, gradient and
information over the patterns in Spark; the Newton step is solved on these few
sums.  Steps that raise the deviance are halved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort_spark.operators.joins import flag_in
from cohort_spark.sources.stages import stage

#: Pivots below this share of a term's own information mark it as a mix of earlier terms.
_ALIASED = 1e-9
#: A pattern's log odds that still move by this much at a settled deviance run off to infinity.
_RUNNING = 0.1


def case_flag(cohort: DataFrame, cases: DataFrame, name: str = "is_case",
              person: str = "person_id") -> DataFrame:
    return flag_in(cohort, cases, person, name)


def _patterns(df: DataFrame, outcome: str, covariates: Sequence[str]) -> DataFrame:
    complete = df.select(outcome, *covariates).na.drop()
    return complete.groupBy(*covariates).agg(
        F.count("*").cast("double").alias("__n"),
        F.sum(F.col(outcome).cast("double")).alias("__y"))


def _terms(patterns: DataFrame, covariates: Sequence[str]) -> list[tuple[str, Column]]:
    """Name and value of every term but the intercept.

    Text is coded against its first level; a covariate with one value has no term.
    """
    kinds = {f.name: f.dataType for f in patterns.schema.fields}
    text = [c for c in covariates if isinstance(kinds[c], T.StringType)]
    seen = patterns.agg(*[(F.array_sort(F.collect_set(c)) if c in text else F.min(c) != F.max(c)).alias(c)
                          for c in covariates]).first()
    out: list[tuple[str, Column]] = []
    for c in covariates:
        if c in text:
            out += [(f"{c}_{level}", F.col(c) == level) for level in (seen[c] or [])[1:]]
        elif seen[c]:
            out.append((c, F.col(c)))
    return out


@dataclass(frozen=True)
class LogisticFit:
    """``coefficients``: term, estimate, standard error, z and p, NULL for a term
    that earlier ones determine.  ``statistics``: one row with persons,
    deviances, their degrees of freedom, AIC, the steps taken, whether the fit
    ``converged`` and whether the outcome is ``separated``, in which case some
    estimates have no finite value and those given mean nothing."""

    coefficients: DataFrame
    statistics: DataFrame


@dataclass(frozen=True)
class _Sums:
    deviance: float
    gradient: np.ndarray
    information: np.ndarray
    moved: float


def _pass(design: DataFrame, beta: np.ndarray, last: np.ndarray) -> _Sums:
    """Sums over the patterns at ``beta``, and the most that any log odds differ from ``last``."""
    size = len(beta)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            n, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            eta = x @ beta
            mu = 1 / (1 + np.exp(-np.abs(eta)))
            mu = np.where(eta >= 0, mu, 1 - mu)
            # y log mu + (n - y) log(1 - mu), without a loss at either end
            kept = y * eta - n * np.logaddexp(0, eta)
            weight = n * mu * (1 - mu)
            sums = np.concatenate([[-2 * kept.sum()], x.T @ (y - n * mu), ((x * weight[:, None]).T @ x).ravel()])
            moved = np.zeros(len(sums))
            moved[0] = np.abs(x @ (beta - last)).max()
            yield pa.RecordBatch.from_pydict({"k": np.arange(len(sums)), "v": sums, "m": moved})

    rows = (design.mapInArrow(task, "k long, v double, m double").groupBy("k")
            .agg(F.sum("v").alias("v"), F.max("m").alias("m")).collect())
    v = np.zeros(1 + size + size * size)
    for row in rows:
        v[row.k] = row.v
    moved = max((row.m for row in rows if row.k == 0), default=0.0)
    return _Sums(float(v[0]), v[1:size + 1], v[size + 1:].reshape(size, size), moved)


def _independent(information: np.ndarray) -> list[int]:
    """Terms, in order, that earlier ones do not determine."""
    left, kept = information.copy(), []
    for i in range(len(left)):
        if left[i, i] > _ALIASED * max(information[i, i], 1e-300):
            kept.append(i)
            left = left - np.outer(left[:, i], left[i]) / left[i, i]
    return kept


def fit_logistic(df: DataFrame, outcome: str, covariates: Sequence[str],
                 max_iter: int = 50, tol: float = 1e-6) -> LogisticFit:
    """Fit by Newton steps over covariate patterns.

    Text covariates are coded against their alphabetically first level; rows
    with a missing covariate are left out.  The fit has converged when the last
    step moved no pattern's log odds by more than ``tol``.  Where
    covariates tell cases apart completely, the deviance settles while some log
    odds keep growing: such a fit is reported as separated.
    """
    spark = df.sparkSession
    patterns = stage(_patterns(df, outcome, covariates), "patterns")
    terms = _terms(patterns, covariates)
    names = ["(Intercept)", *[name for name, _ in terms]]
    columns = F.array(F.lit(1.0), *[value.cast("double") for _, value in terms])
    design = patterns.select(columns.alias("x"), "__n", "__y")
    totals = patterns.agg(F.sum("__n"), F.sum("__y")).first()
    n, yes = float(totals[0] or 0), float(totals[1] or 0)

    beta = np.zeros(len(names))
    if 0 < yes < n:
        beta[0] = math.log(yes / (n - yes))
    now = _pass(design, beta, beta)
    kept = _independent(now.information)
    step_no, converged, separated = 0, False, not 0 < yes < n
    while n and not separated and not converged and step_no < max_iter:
        step_no += 1
        step = np.zeros(len(names))
        step[kept] = np.linalg.lstsq(now.information[np.ix_(kept, kept)], now.gradient[kept], rcond=None)[0]
        then = _pass(design, beta + step, beta)
        while then.deviance > now.deviance + 1e-9 * (1 + abs(now.deviance)) and then.moved > tol:
            step = step / 2
            then = _pass(design, beta + step, beta)
        settled = abs(now.deviance - then.deviance) <= 1e-8 * (0.1 + abs(then.deviance))
        beta, now = beta + step, then
        converged = settled and now.moved <= tol
        separated = settled and now.moved > _RUNNING
    rows = _coefficients(names, beta, now.information, kept) if n else []
    null = -2 * (_part(yes, n) + _part(n - yes, n))
    statistics = (int(n), null, int(n) - 1, now.deviance, int(n) - len(kept),
                  now.deviance + 2 * len(kept), step_no, bool(converged), bool(separated))
    return LogisticFit(
        spark.createDataFrame(rows, "term string, estimate double, std_error double, "
                                    "z_value double, p_val double"),
        spark.createDataFrame([statistics], statistics_schema()))


def _coefficients(names, beta, information, kept) -> list[tuple]:
    """Coefficient rows, the intercept last."""
    variance = np.full(len(names), np.nan)
    variance[kept] = np.diag(np.linalg.pinv(information[np.ix_(kept, kept)], hermitian=True))
    out = []
    for i in [*range(1, len(names)), 0]:
        if i not in kept:
            out.append((names[i], None, None, None, None))
            continue
        error = math.sqrt(max(variance[i], 0.0))
        z = beta[i] / error if error else math.nan
        out.append((names[i], float(beta[i]), error, float(z), math.erfc(abs(z) / math.sqrt(2))))
    return out


def _part(count: float, n: float) -> float:
    return count * math.log(count / n) if count > 0 else 0.0


def statistics_schema() -> str:
    return ("n bigint, null_deviance double, null_df bigint, residual_deviance double, "
            "residual_df bigint, aic double, steps int, converged boolean, separated boolean")


def logistic(df: DataFrame, outcome: str, covariates: Sequence[str],
             **options: object) -> DataFrame:
    """Coefficient table of :func:`fit_logistic`."""
    return fit_logistic(df, outcome, covariates, **options).coefficients
