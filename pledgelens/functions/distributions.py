"""Tail probabilities for test statistics.

Spark has no error function. These helpers run on result tables with one row
per feature or coefficient, never on data rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300

    def away_from_zero(v: float) -> float:
        return v if abs(v) > tiny else tiny

    c, d = 1.0, 1.0 / away_from_zero(1.0 - (a + b) * x / (a + 1.0))
    value = d
    for m in range(1, 500):
        before = value
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for coefficient in (even, odd):
            d = 1.0 / away_from_zero(1.0 + coefficient * d)
            c = away_from_zero(1.0 + coefficient / c)
            value *= c * d
        if abs(value - before) < 1e-16 * abs(value):
            break
    return front * value


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def rank_sum_counts(m: int, n: int) -> list[int]:
    """Orders of m and n untied values by their U, from 0 to m n: the coefficients of a Gaussian binomial.

    A factor (1 - q^(n+i)) / (1 - q^i) for every i up to m, on whole numbers.
    """
    m, n = min(m, n), max(m, n)
    counts = [1] + [0] * (m * n)
    for i in range(1, m + 1):
        for u in range(m * n, n + i - 1, -1):
            counts[u] -= counts[u - n - i]
        for u in range(i, m * n + 1):
            counts[u] += counts[u - i]
    return counts


def rank_sum_two_sided(u: float, m: float, n: float) -> float:
    """Exact two-sided p-value of U for samples of m and n untied values."""
    m, n = int(m), int(n)
    counts = rank_sum_counts(m, n)
    # U counts whole pairs; the two tails are alike.
    low = min(int(u), m * n - int(u))
    return min(1.0, 2 * sum(counts[:low + 1]) / math.comb(m + n, m))


def _vector(fn):
    def run(*series: pd.Series) -> pd.Series:
        out = []
        for values in zip(*series):
            bad = any(v is None or (isinstance(v, float) and np.isnan(v)) for v in values)
            out.append(None if bad else fn(*values))
        return pd.Series(out, dtype="float64")

    return run


def normal_p(z):
    """Two-sided normal p-value column of a small result table."""
    def run(z: pd.Series) -> pd.Series:
        return _vector(normal_two_sided)(z)

    return F.pandas_udf(run, "double")(z)


def rank_sum_p(u, m, n):
    """Exact two-sided p-value column of a small result table; null where an argument is."""
    def run(u: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        return _vector(rank_sum_two_sided)(u, m, n)

    return F.pandas_udf(run, "double")(u, m, n)


def student_p(t, df):
    """Two-sided Student p-value column of a small result table."""
    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        return _vector(student_two_sided)(t, df)

    return F.pandas_udf(run, "double")(t, df)
