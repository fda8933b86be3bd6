import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_spark.functions import (
    binom_p,
    classify,
    exact_years,
    first_field,
    first_integer,
    first_number,
    fisher_tests,
    is_in,
    n_unique,
    not_in,
    remove_first,
    round_half_even,
    split_fields,
    to_number,
    with_class,
    with_dictionary_class,
)
from cohort_spark.functions.exact import fisher_numpy
from cohort_spark.functions.tails import beta_lower, gamma_upper, upper_tail
from conftest import values


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# --- missing values ------------------------------------------------------------
def test_membership_is_never_null(frame):
    df = frame([("a",), ("b",), (None,)], "x string")
    got = values(df.select("x", is_in(F.col("x"), ["a"]).alias("i"),
                           not_in(F.col("x"), ["a"]).alias("o")))
    assert got == [("a", True, False), ("b", False, True), (None, False, True)]


def test_membership_of_missing_when_listed(frame):
    df = frame([("b",), (None,)], "x string")
    assert values(df.select("x", is_in(F.col("x"), ["a", None]).alias("i"))) == [
        ("b", False), (None, True)]


def test_distinct_count_counts_missing_once(frame):
    df = frame([(1, "a"), (1, None), (1, None), (2, "a"), (3, None)], "k int, x string")
    assert values(df.groupBy("k").agg(n_unique(F.col("x")).alias("n"))) == [(1, 2), (2, 1), (3, 1)]


# --- dates and rounding --------------------------------------------------------
@pytest.mark.parametrize("start, end, years", [
    ("1980-02-29", "2023-08-29", 43.497267760),
    ("1960-06-15", "2020-06-14", 59.997267760),
    ("1960-06-15", "2020-06-15", 60.0),
    ("2000-01-01", "2000-01-01", 0.0),
])
def test_exact_years(spark, start, end, years):
    got = one(spark, exact_years(F.lit(start).cast("date"), F.lit(end).cast("date")))
    assert got == pytest.approx(years, abs=1e-8)


@pytest.mark.parametrize("value, digits, rounded", [
    (2.5, 0, 2), (3.5, 0, 4), (45.0, -1, 40), (55.0, -1, 60), (0.25, 1, 0.2), (-2.5, 0, -2)])
def test_round_half_even(spark, value, digits, rounded):
    assert one(spark, round_half_even(F.lit(value), digits)) == rounded


# --- text ----------------------------------------------------------------------
@pytest.mark.parametrize("text, number, whole", [
    ("Customer#000000899", 899, 899), ("no digits", None, None), ("$1,234.50 paid", 1234.5, 1234),
    ("id-12x7", -12, -12), (".5", 0.5, None), ("9007199254740993", 9007199254740992.0,
                                               9007199254740993)])
def test_first_number(spark, text, number, whole):
    assert one(spark, first_number(F.lit(text))) == number
    assert one(spark, first_integer(F.lit(text))) == whole


def test_lenient_number(frame):
    df = frame([("1.5",), ("0.1,0.2",), ("",), (None,)], "x string")
    assert values(df.select(to_number(F.col("x")).alias("v"))) == [
        (1.5,), (None,), (None,), (None,)]


def test_codes(frame):
    df = frame([("A01.1.2",), ("A011",), (None,), (".x",)], "c string")
    got = values(df.select("c", remove_first(F.col("c"), ".").alias("r"),
                           first_field(F.col("c")).alias("f")))
    assert got == [(".x", "x", ""), ("A01.1.2", "A011.2", "A01"), ("A011", "A011", "A011"),
                   (None, None, None)]


def test_split_fills_short_rows_and_rejects_long_ones(frame):
    df = frame([(1, "a:b,c"), (2, "a"), (3, None)], "id int, x string")
    got = values(split_fields(df, "x", ":|,", ["p", "q", "r"]))
    assert got == [(1, "a", "b", "c"), (2, "a", None, None), (3, None, None, None)]
    long = frame([(1, "a:b:c:d")], "id int, x string")
    with pytest.raises(Exception, match="more than 3 fields"):
        split_fields(long, "x", ":|,", ["p", "q", "r"]).collect()
    assert values(split_fields(long, "x", ":|,", ["p", "q", "r"], too_many="drop")) == [
        (1, "a", "b", "c")]


def test_first_rule_wins(frame):
    rules = [("^leuko", "wbc"), ("lympho|x", "lympho"), ("leuko", "late")]
    df = frame([("Leukocytes lympho",), ("a LYMPHO leuko",), ("old leuko",), ("none",), (None,)],
               "t string")
    expected = [("Leukocytes lympho", "wbc"), ("a LYMPHO leuko", "lympho"), ("none", "nomatch"),
                ("old leuko", "late"), (None, "nomatch")]
    assert values(df.select("t", classify(F.col("t"), rules).alias("l"))) == expected
    assert values(with_class(df, "t", rules, "l")) == expected
    assert values(with_dictionary_class(df, "t", rules, "l")) == expected
    named = [row for row in expected if row[1] != "nomatch"]
    assert values(with_class(df, "t", rules, "l", keep_default=False)) == named
    twice = with_dictionary_class(df.union(df), "t", rules, "l", keep_default=False)
    assert values(twice) == sorted(named + named)


# --- exact tests ---------------------------------------------------------------
@pytest.mark.parametrize("x, n, p", [
    (10, 20, 1.0), (14, 20, 0.1153182983), (15, 20, 0.0413894653), (20, 23, 0.00048828125),
    (3, 23, 0.00048828125), (0, 1, 1.0), (0, 5, 0.0625), (5, 5, 0.0625)])
def test_binomial(spark, x, n, p):
    assert one(spark, binom_p(F.lit(x), F.lit(n))) == pytest.approx(p, abs=1e-9)


def test_binomial_against_whole_sums(frame):
    cases = [(x, n) for n in (1, 2, 7, 40, 333, 2000) for x in (0, n // 3, n // 2, n - 1, n)]
    got = frame(cases, "x int, n int").select("x", "n", binom_p(F.col("x"), F.col("n")).alias("p"))
    for x, n, p in got.collect():
        top = max(x, n - x)
        exact = min(1.0, 2 * sum(math.comb(n, k) for k in range(top, n + 1)) / 2**n) \
            if 2 * top != n else 1.0
        assert p == pytest.approx(exact, rel=1e-9)


GOLDENS = [  # control_wo, control_w, case_wo, case_w -> odds ratio, low, high, p
    ((3, 1, 1, 3), (6.4083197, 0.2117356, 626.24353, 0.4857142857)),
    ((2, 10, 15, 3), (0.04693664, 0.003317164, 0.3631896, 0.00053672412)),
    ((700, 40, 60, 14), (4.0721251, 1.9341357, 8.1754741, 0.00013484735)),
    ((740, 0, 73, 1), (math.inf, 0.2564103, math.inf, 0.0909090909)),
]


def test_fisher_goldens(frame):
    df = frame([cells for cells, _ in GOLDENS], "control_wo long, control_w long, "
               "case_wo long, case_w long")
    got = {tuple(row[:4]): tuple(row[4:]) for row in fisher_tests(df).collect()}
    for cells, expected in GOLDENS:
        assert got[cells] == pytest.approx(expected, rel=2e-7)


def _fisher_slow(a, c, b, d):
    """p, and the tail and mean equations, by whole-number sums."""
    m, n, k = a + b, c + d, a + c
    support = range(max(0, k - n), min(k, m) + 1)
    weight = {v: math.comb(m, v) * math.comb(n, k - v) for v in support}
    total = sum(weight.values())
    p = sum(w for w in weight.values() if w <= weight[a] * (1 + 1e-7)) / total
    return weight, p


def test_fisher_against_whole_sums():
    rng = np.random.default_rng(3)
    cells = [tuple(int(v) for v in rng.integers(0, 30, 4)) for _ in range(60)]
    cells += [(0, 0, 5, 7), (5, 7, 0, 0), (0, 4, 6, 0), (1, 0, 0, 1)]
    result = fisher_numpy(*zip(*cells))
    for i, (a, c, b, d) in enumerate(cells):
        weight, p = _fisher_slow(a, c, b, d)
        ratio, low, high, got = result[:, i]
        assert got == pytest.approx(p, rel=1e-9)

        def share(odds, test):
            top = max(math.log(w) + v * math.log(odds) for v, w in weight.items())
            scaled = {v: math.exp(math.log(w) + v * math.log(odds) - top)
                      for v, w in weight.items()}
            return sum(test(v) * s for v, s in scaled.items()) / sum(scaled.values())

        if 0 < ratio < math.inf:
            assert share(ratio, float) == pytest.approx(a, abs=1e-6)
        if low > 0:
            assert share(low, lambda v: v >= a) == pytest.approx(0.025, rel=1e-7)
        if high < math.inf:
            assert share(high, lambda v: v <= a) == pytest.approx(0.025, rel=1e-7)


def test_fisher_swaps_with_the_arms():
    one_way = fisher_numpy([14], [40], [60], [700])[:, 0]
    other = fisher_numpy([40], [14], [700], [60])[:, 0]
    assert other[0] == pytest.approx(1 / one_way[0], rel=1e-9)
    assert other[1] == pytest.approx(1 / one_way[2], rel=1e-9)
    assert other[3] == pytest.approx(one_way[3], rel=1e-9)


def test_fisher_window_equals_whole_support(monkeypatch):
    import cohort_spark.functions.exact as exact
    cells = ([900, 2000], [3000, 9000], [5100, 4000], [21000, 21000])
    wide = fisher_numpy(*cells)
    monkeypatch.setattr(exact._Tables.masses, "__defaults__", (10**6,))
    assert np.allclose(wide, fisher_numpy(*cells), rtol=1e-8, atol=0)


def test_fisher_of_many_wide_tables_is_one_block():
    """A few hundred tables of large arms together cost about as much as one."""
    import time
    m, n, a = 3000, 30000, np.arange(100, 300)
    began = time.process_time()
    fisher_numpy(a, 10 * a, m - a, n - 10 * a)
    assert time.process_time() - began < 10


def test_fisher_that_does_not_settle_raises(monkeypatch):
    import cohort_spark.functions.exact as exact
    monkeypatch.setattr(exact, "_STEPS", 1)
    with pytest.raises(RuntimeError, match="have not settled"):
        fisher_numpy([14], [40], [60], [700])


def test_negative_cell_is_refused():
    with pytest.raises(ValueError, match="negative cell"):
        fisher_numpy([80], [3], [-6], [737])


def test_tails(frame):
    """Quantiles of printed tables, closed forms, and tails far out and at large degrees of freedom."""
    cases = [(3.841458820694124, 1.0, None, 0.05), (18.307038053275146, 10.0, None, 0.05),
             (4.964602743730711, 1.0, 10.0, 0.05), (1500.0, 2.0, None, math.exp(-750)),
             (1.5, 2.0, None, math.exp(-0.75)), (0.0, 3.0, None, 1.0), (0.0, 3.0, 5.0, 1.0),
             # with two numerator degrees of freedom the tail is (1 + 2 f / d)^(-d / 2)
             (3.0, 2.0, 7.0, (1 + 6 / 7) ** -3.5), (0.2, 2.0, 9.0, (1 + 0.4 / 9) ** -4.5),
             (0.5, 2.0, 200_000.0, (1 + 1 / 200_000) ** -100_000), (40.0, 2.0, 1000.0, (1.08) ** -500)]
    df = frame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, x double, a double, b double")
    got = {r.i: r.p for r in df.select("i", upper_tail("x", "a", "b").alias("p")).collect()}
    for i, (*_, want) in enumerate(cases):
        assert got[i] == pytest.approx(want, rel=1e-8)
    missing = frame([(None, 1.0, 2.0), (1.0, 0.0, None), (1.0, None, 3.0), (1.0, 1.0, 0.0)], "x double, a double, b double")
    assert values(missing.select(upper_tail("x", "a", "b"))) == [(None,)] * 4


def test_tails_beyond_the_mean_sum_to_one(frame):
    df = frame([(s, x) for s in (0.5, 3.0, 40.0, 900.0) for x in (0.3 * s, 0.99 * s, s + 1.01, 1.4 * s + 2)],
               "s double, x double")
    rows = df.select("s", "x", gamma_upper(F.col("s"), F.col("x")).alias("q"),
                     beta_lower(F.col("s"), F.lit(6.0), F.col("s") / (F.col("s") + F.col("x"))).alias("low"),
                     beta_lower(F.lit(6.0), F.col("s"), F.col("x") / (F.col("s") + F.col("x"))).alias("high")).collect()
    for r in rows:
        assert 0 <= r.q <= 1 and r.low + r.high == pytest.approx(1, abs=1e-10)
        # integral of the density, by Simpson's rule
        n, top = 20_000, r.x + 40 * math.sqrt(r.s) + 60
        t = np.linspace(r.x, top, n + 1)
        w = np.where(np.arange(n + 1) % 2, 4, 2)
        w[[0, -1]] = 1
        f = np.exp((r.s - 1) * np.log(t) - t - math.lgamma(r.s))
        assert r.q == pytest.approx((w * f).sum() * (top - r.x) / n / 3, rel=1e-5)
