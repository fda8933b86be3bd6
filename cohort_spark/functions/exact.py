"""Exact tests: a binomial p as a column, 2x2 tests over term rows.

The binomial test runs per call, so it stays a JVM expression.  The 2x2 tests
run per term, after all aggregation, as numpy batches inside Spark tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHIFT = 10


def log_factorial(z: Column) -> Column:
    """log(z!) by Stirling's series at ``z + 11``, shifted back ten factors."""
    z = z.cast("double")
    product = z + 1
    for i in range(2, _SHIFT + 1):
        product = product * (z + i)
    w = z + 1 + _SHIFT
    series = (1 / (12 * w) - 1 / (360 * F.pow(w, F.lit(3))) + 1 / (1260 * F.pow(w, F.lit(5)))
              - 1 / (1680 * F.pow(w, F.lit(7))))
    return (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def binom_p(x: Column, n: Column) -> Column:
    """Two-sided exact binomial p at one half.

    The upper tail from ``max(x, n - x)`` is its first mass times
    1 + r1 (1 + r2 (1 + ...)) with r the ratios of neighbouring masses.  This
    loses nothing a double holds: from a start at n / 2 or above, the mass after
    j steps is below exp(-2 j^2 / n) of the first (each ratio is at most
    (n - 2 i + 2) / (n + 2 i) at step i), so after ``6 sqrt(n) + 10`` steps what
    is left out is below exp(-72) times sqrt(n).
    """
    x, n = x.cast("double"), n.cast("double")
    start = F.greatest(x, n - x)
    steps = F.least(n - start, F.ceil(6 * F.sqrt(n)) + 10).cast("int")
    first = F.exp(log_factorial(n) - log_factorial(start) - log_factorial(n - start)
                  - n * math.log(2))
    relative = F.when(steps < 1, F.lit(1.0)).otherwise(F.aggregate(
        F.sequence(steps, F.lit(1)), F.lit(1.0),
        lambda acc, j: 1 + acc * (n - start - j + 1) / (start + j)))
    valid = (x >= 0) & (n >= x)
    return (F.when(valid & (start * 2 == n), F.lit(1.0))
            .when(valid, F.least(F.lit(1.0), 2 * first * relative)))


# --- 2x2 tests --------------------------------------------------------------
# Cell x = case_w of a table with case total m, control total n and k rows
# with the term; weights C(m,x) C(n,k-x) exp(theta x), theta = log odds ratio.

_BLOCK_CELLS = 1_000_000    # terms are worked in blocks of about this many cells
_SOLVE_NATS, _P_NATS = 60.0, 745.0   # masses smaller by more are lost in a double anyway
_STEPS = 200                # Newton or halving steps before a solve counts as failed


def _log_fact(z: np.ndarray) -> np.ndarray:
    w = z + 11.0
    product = np.ones_like(w)
    for i in range(1, 11):
        product = product * (z + i)
    series = 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5)
    return (w - 0.5) * np.log(w) - w + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def _bisect(low: np.ndarray, high: np.ndarray, keep) -> np.ndarray:
    """Largest whole number in [low, high] where ``keep`` holds (it does at low)."""
    low, high = low.copy(), high.copy()
    while np.any(low < high):
        mid = np.ceil((low + high) / 2)
        ok = keep(mid)
        low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
    return low


class _Tables:
    """A block of 2x2 tables, each worked on the part of its support that has mass."""

    def __init__(self, m, n, k, x):
        self.m, self.n, self.k, self.x = m, n, k, x
        self.lo, self.hi = np.maximum(0.0, k - n), np.minimum(k, m)

    def take(self, rows):
        return _Tables(self.m[rows], self.n[rows], self.k[rows], self.x[rows])

    def _log_weights(self, start, end, theta):
        steps = np.arange(int((end - start).max(initial=0)) + 1, dtype=float)
        v = start[:, None] + steps
        inside = v <= end[:, None]
        m, n, k = self.m[:, None], self.n[:, None], self.k[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = (np.log((m - v + 1) * (k - v + 1)) - np.log(v * (n - k + v))
                     + np.reshape(theta, (-1, 1)))
        ratio[:, 0] = 0.0
        log_w = np.cumsum(np.where(inside, ratio, 0.0), axis=1)
        return v, np.where(inside, log_w, -np.inf)

    def _window(self, theta, nats):
        """Range of cell values within ``nats`` of the likeliest one."""
        m, n, k = self.m, self.n, self.k

        def log_mass(v):
            return theta * v - (_log_fact(v) + _log_fact(m - v) + _log_fact(k - v)
                                + _log_fact(n - k + v))

        mode = _bisect(self.lo, self.hi, lambda v: (v <= self.lo) | (
            np.log((m - v + 1) * (k - v + 1)) + theta
            >= np.log(np.maximum(v * (n - k + v), 1e-300))))
        floor = log_mass(mode) - nats
        right = _bisect(mode, self.hi, lambda v: log_mass(v) >= floor)
        left = mode - _bisect(np.zeros_like(mode), mode - self.lo,
                              lambda u: log_mass(mode - u) >= floor)
        return left, right

    def masses(self, theta, nats=_SOLVE_NATS):
        """Support values and their probabilities, one padded row per table."""
        v, log_w = self._log_weights(*self._window(theta, nats), theta)
        w = np.exp(log_w - log_w.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        return v, w

    def two_sided_p(self):
        v, w = self.masses(np.zeros_like(self.x), _P_NATS)
        column = self.x - v[:, 0]
        inside = (column >= 0) & (column < v.shape[1])
        at = np.clip(column, 0, v.shape[1] - 1).astype(int)
        observed = np.where(inside, w[np.arange(len(at)), at], 0.0)
        limit = observed * (1 + 1e-7)
        return np.where(w <= limit[:, None], w, 0.0).sum(axis=1).clip(0, 1)

    def mean_gap(self, theta):
        v, w = self.masses(theta)
        mean = (w * v).sum(axis=1)
        return mean - self.x, (w * (v - mean[:, None]) ** 2).sum(axis=1)

    def upper_tail_gap(self, theta, log_level):
        v, w = self.masses(theta)
        return self._tail_gap(v, w, v >= self.x[:, None], log_level)

    def lower_tail_gap(self, theta, log_level):
        v, w = self.masses(theta)
        gap, slope = self._tail_gap(v, w, v <= self.x[:, None], log_level)
        return -gap, -slope

    @staticmethod
    def _tail_gap(v, w, side, log_level):
        part = np.where(side, w, 0.0)
        tail, mean = part.sum(axis=1), (w * v).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.log(tail) - log_level, (part * v).sum(axis=1) / tail - mean

    def solve(self, gap):
        """exp of the root of ``gap``, which increases in theta: bracket, safe Newton."""
        a, b = self.x + 0.5, self.m - self.x + 0.5
        c, d = self.k - self.x + 0.5, self.n - self.k + self.x + 0.5
        theta = np.log(a * d / (b * c))
        low, high = theta - 2, theta + 2
        for bound, sign in ((low, -1.0), (high, 1.0)):
            wrong, step = np.arange(len(theta)), 2.0
            while len(wrong):
                value = gap(self.take(wrong), bound[wrong])[0]
                wrong = wrong[sign * value < 0]
                bound[wrong] += sign * step
                step *= 2
        active = np.arange(len(theta))
        for _ in range(_STEPS):
            here = theta[active]
            value, slope = gap(self.take(active), here)
            low[active] = np.where(value < 0, here, low[active])
            high[active] = np.where(value >= 0, here, high[active])
            with np.errstate(divide="ignore", invalid="ignore"):
                newton = here - value / slope
            good = np.isfinite(newton) & (newton > low[active]) & (newton < high[active])
            theta[active] = np.where(good, newton, (low[active] + high[active]) / 2)
            moved = np.abs(theta[active] - here) > 1e-12 * (1 + np.abs(here))
            active = active[moved]
            if not len(active):
                return np.exp(theta)
        raise RuntimeError(f"{len(active)} exact tests have not settled after {_STEPS} steps")

    def estimates(self, alpha):
        """Conditional odds ratio and exact confidence limits."""
        level = math.log(alpha / 2)
        above, below = self.x > self.lo, self.x < self.hi
        ratio = np.where(above, np.inf, 0.0)
        low, high = np.zeros_like(ratio), np.full_like(ratio, np.inf)
        for rows, target, gap in (
            (above & below, ratio, _Tables.mean_gap),
            (above, low, lambda t, theta: t.upper_tail_gap(theta, level)),
            (below, high, lambda t, theta: t.lower_tail_gap(theta, level)),
        ):
            if rows.any():
                target[rows] = self.take(np.flatnonzero(rows)).solve(gap)
        return ratio, low, high


def fisher_numpy(case_w, control_w, case_wo, control_wo, confidence: float = 0.95):
    """Arrays (odds ratio, low, high, p) for arrays of 2x2 cells."""
    a, c, b, d = (np.asarray(v, dtype=float) for v in (case_w, control_w, case_wo, control_wo))
    if min(v.min(initial=0) for v in (a, b, c, d)) < 0:
        raise ValueError("negative cell: a term is counted more often than its arm has "
                         "persons; count persons, not rows")
    m, n, k = a + b, c + d, a + c
    # the count is a sum of independent 0/1 draws, at most as many as the smallest margin, so its
    # variance is below a quarter of that whatever the odds ratio
    width = np.minimum(np.minimum(k, m) - np.maximum(0.0, k - n),
                       2 * np.sqrt(_P_NATS * np.minimum(np.minimum(m, n), np.minimum(k, m + n - k)) / 2)) + 1
    out = np.zeros((4, len(a)))
    order = np.argsort(width, kind="stable")
    begin = 0
    while begin < len(order):
        end, size = begin + 1, 1
        while end < len(order):
            if (size + 1) * width[order[end]] > _BLOCK_CELLS:
                break
            end, size = end + 1, size + 1
        rows = order[begin:end]
        block = _Tables(m[rows], n[rows], k[rows], a[rows])
        out[:3, rows] = block.estimates(1 - confidence)
        out[3, rows] = block.two_sided_p()
        begin = end
    return out


TEST_COLUMNS = ("odds_ratio", "or_low", "or_hi", "p_val")


def fisher_tests(counts: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Add exact 2x2 results to rows with the four ``case_/control_`` counts."""
    schema = T.StructType(counts.schema.fields
                          + [T.StructField(name, T.DoubleType()) for name in TEST_COLUMNS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            result = fisher_numpy(batch["case_w"], batch["control_w"],
                                  batch["case_wo"], batch["control_wo"], confidence)
            yield batch.assign(**dict(zip(TEST_COLUMNS, result)))

    return counts.mapInPandas(run, schema)
