"""Upper tails of the chi-square and F distributions as column expressions.

Both are incomplete functions, summed inwards over a number of terms that the
arguments give beforehand: about the square root of the degrees of freedom.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohort_spark.functions.exact import log_factorial


def _log_gamma(z: Column) -> Column:
    return log_factorial(z - 1)


def _terms(size: Column) -> Column:
    """Terms after which neither a series nor a fraction changes: ratios fall off as exp(-k^2 / 2 size)."""
    return (F.ceil(10 * F.sqrt(size)) + 100).cast("int")


def _inwards(terms: Column, start: Column, step) -> Column:
    return F.aggregate(F.sequence(terms, F.lit(1)), start, lambda acc, j: step(acc, j.cast("double")))


def gamma_upper(s: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma Q(s, x) for s > 0."""
    front = F.exp(s * F.log(x) - x - _log_gamma(s))
    # 1 + x/(s+1) (1 + x/(s+2) (1 + ...)), below the mean
    series = _inwards(_terms(s), F.lit(1.0), lambda acc, j: 1 + acc * x / (s + j)) / s
    # x+1-s - 1(1-s)/(x+3-s - 2(2-s)/(x+5-s - ...)), above it
    terms = _terms(s)
    last = x + 2 * terms + 1 - s
    fraction = _inwards(terms, last, lambda acc, j: x + 2 * j - 1 - s - j * (j - s) / acc)
    return (F.when(x <= 0, F.lit(1.0)).when(x < s + 1, 1 - front * series)
            .otherwise(front / fraction))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """x^a (1-x)^b / (a B(a,b)) / (1 + d1/(1 + d2/(1 + ...))), for x below the mean."""
    def both(acc: Column, m: Column) -> Column:
        # d(2m-1) / (1 + d(2m) / acc), with m counting from 1
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        return 1 + odd / (1 + even / acc)

    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.log(x) + b * F.log1p(-x)) / a
    return front / _inwards(_terms(F.greatest(a, b)), F.lit(1.0), both)


def beta_lower(a: Column, b: Column, x: Column) -> Column:
    """Regularised lower incomplete beta I_x(a, b) for a, b > 0."""
    return (F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0))
            .when(x > (a + 1) / (a + b + 2), 1 - _beta_fraction(b, a, 1 - x))
            .otherwise(_beta_fraction(a, b, x)))


def upper_tail(statistic: Column | str, df1: Column | str, df2: Column | str) -> Column:
    """P(F > statistic), or P(chi-square > statistic) where ``df2`` is missing."""
    value, a, b = (F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
                   for c in (statistic, df1, df2))
    known = value.isNotNull() & (a > 0)
    return (F.when(known & b.isNull(), gamma_upper(a / 2, value / 2))
            .when(known & (b > 0), beta_lower(b / 2, a / 2, b / (b + a * value))))
