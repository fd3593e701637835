"""Tails of tests, one row a test, in Arrow functions: hypergeometric ones by the ratios of neighbouring outcomes, Student and F by continued fraction."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The Lanczos approximation with g = 7 and nine terms.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def lgamma(z: Column) -> Column:
    """Natural logarithm of the gamma function for z >= 1."""
    x = z - 1.0
    t = x + 7.5
    series = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (x + float(k))
    return F.lit(0.5 * math.log(2 * math.pi)) + (x + 0.5) * F.ln(t) - t + F.ln(series)


def make_hypergeometric():
    """tails(k, population, successes, draws, two_sided) over arrays, as one closure over plain functions (see make_f_tail)."""
    import numpy as np

    def one(k, population, successes, draws, two_sided):
        low, high = max(0, draws + successes - population), min(successes, draws)
        if not two_sided and k > high:
            return 0.0
        if not two_sided and k <= low:
            return 1.0
        # Outcomes from the mode outward, each from the one before by the ratio of neighbours. Those left out weigh nothing beside the rest.
        mode = min(high, max(low, (draws + 1) * (successes + 1) // (population + 2)))
        spread = (draws * (successes / population) * (1 - successes / population) * (population - draws) / max(1, population - 1)) ** 0.5
        far = abs(k - mode)
        if far > 60 * spread + 10_000:
            return 0.0 if two_sided or k > mode else 1.0
        reach = int(50 * spread + 2 * far) + 1000
        first, last = max(low, mode - reach), min(high, mode + reach)
        i = np.arange(first, last, dtype=np.float64)  # from i to i + 1
        step = np.log((successes - i) * (draws - i)) - np.log((i + 1) * (population - successes - draws + i + 1))
        log_p = np.concatenate([[0.0], np.cumsum(step)])
        log_p -= log_p.max()
        p = np.exp(log_p)
        at = k - first
        if two_sided:
            return float(min(1.0, p[log_p <= log_p[at] + 1e-7].sum() / p.sum()))
        return float(min(1.0, p[at:].sum() / p.sum()))

    def tails(k, population, successes, draws, two_sided):
        rows = zip(k, population, successes, draws, strict=True)
        return [None if any(x is None or x != x for x in r) else one(*(int(x) for x in r), two_sided) for r in rows]

    return tails


def _hypergeometric(k: Column, population: Column, successes: Column, draws: Column, two_sided: bool) -> Column:
    tails = make_hypergeometric()

    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(tails(a, b, c, d, two_sided), dtype="float64")

    return F.pandas_udf(run, "double")(*[x.cast("long") for x in (k, population, successes, draws)])


def hypergeometric_tail(k: Column, population: Column, successes: Column, draws: Column) -> Column:
    """P(X >= k). A row is a test; the outcomes near the mode are summed in an array."""
    return _hypergeometric(k, population, successes, draws, False)


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of [[a, b], [c, d]]: all tables with these margins that are no likelier than the observed one, within a relative 1e-7."""
    a, b, c, d = (x.cast("long") for x in (a, b, c, d))
    return _hypergeometric(a, a + b + c + d, a + c, a + b, True)


def make_f_tail():
    """The tail as one closure over plain functions, so that workers without this package can run it."""
    from math import exp, isnan, lgamma as lg, log, log1p

    def fraction(a, b, x):
        tiny = 1e-300
        c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
        d = 1.0 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 + num * d
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = 1.0 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1.0) < 1e-15:
                break
        return h

    def tail(f, df1, df2):
        if f is None or isnan(f) or isnan(df1) or isnan(df2):
            return float("nan")
        if f <= 0:
            return 1.0
        a, b, x = df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f)
        if x <= 0:
            return 0.0
        front = exp(lg(a + b) - lg(a) - lg(b) + a * log(x) + b * log1p(-x))
        return front * fraction(a, b, x) / a if x < (a + 1.0) / (a + b + 2.0) else 1.0 - front * fraction(b, a, 1.0 - x) / b

    return tail


#: P(F >= f) in plain Python.
f_tail_value = make_f_tail()


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """P(F >= f); a handful of rows, one for each test. t with n degrees of freedom is F with 1 and n at t squared."""
    tail = make_f_tail()

    def tails(fs: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([tail(x, y, z) for x, y, z in zip(fs, a, b, strict=True)], dtype="float64")

    return F.pandas_udf(tails, "double")(f.cast("double"), df1.cast("double"), df2.cast("double"))
