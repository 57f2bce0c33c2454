"""Numeric column helpers and special functions (no scipy): incomplete beta and gamma, their tails, the normal quantile."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def r6(column) -> Column:
    """Rounds to six places, nudged so that sums taken in another order give the same."""
    return F.round((F.col(column) if isinstance(column, str) else column) + F.lit(1e-9), 6)


def nan_to_null(column) -> Column:
    return F.when(~F.isnan(column), column)


def log2_fold_change(reference, test, pseudocount: float = 0.0, otherwise: float | None = None) -> Column:
    """log2((test + c) / (reference + c)); without pseudocount `otherwise` (null or a number) unless both means are positive."""
    if pseudocount:
        return F.log2((test + pseudocount) / (reference + pseudocount))
    return F.when((test > 0) & (reference > 0), F.log2(test / reference)).otherwise(F.lit(otherwise).cast("double"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1.0 / (1.0 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 400):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + numerator * d) or tiny)
            c = (1.0 + numerator / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 1000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for k in range(1, 1000):
        n = -k * (k - a)
        b += 2
        d, c = 1 / ((n * d + b) or 1e-300), (b + n / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of numbers above 0, by Stirling's series beyond 8 steps."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - sum(np.log(x + k) for k in range(8))


def hypergeom_sf(k: int, population: int, successes: int, draws: int) -> float:
    """P(X >= k)."""

    def choose(n: float, r: np.ndarray) -> np.ndarray:
        return log_gamma(np.float64(n + 1)) - log_gamma(r + 1.0) - log_gamma(n - r + 1.0)

    low, high = max(k, draws + successes - population, 0), min(successes, draws)
    if low > high:
        return 0.0
    i = np.arange(low, high + 1)
    return min(1.0, float(np.exp(choose(successes, i) + choose(population - successes, draws - i) - choose(population, np.float64(draws))).sum()))


def _tail(function, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in row) else function(*row) for row in zip(*columns)], dtype="float64")


# The UDFs below get one row per feature or test, never the measurements.
@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _tail(lambda a, b: t_two_sided(a, b) if b > 0 else None, t, df)


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _tail(lambda a, b, c: f_sf(a, b, c) if b > 0 and c > 0 else None, f, d1, d2)


@F.pandas_udf(DoubleType())
def chi2_p_value(x: pd.Series, df: pd.Series) -> pd.Series:
    return _tail(lambda a, b: chi2_sf(a, b) if b > 0 else None, x, df)


@F.pandas_udf(DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    return _tail(normal_two_sided, z)


@F.pandas_udf(DoubleType())
def hypergeom_p_value(k: pd.Series, population: pd.Series, successes: pd.Series, draws: pd.Series) -> pd.Series:
    return _tail(lambda a, b, c, d: hypergeom_sf(int(a), int(b), int(c), int(d)), k, population, successes, draws)


@F.pandas_udf(DoubleType())
def probit(p: pd.Series) -> pd.Series:
    inverse = NormalDist().inv_cdf
    return _tail(lambda x: inverse(x) if 0 < x < 1 else None, p)
