"""Student's t distribution for pandas UDFs, by the continued fraction of the incomplete beta."""

import math

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's method (Press et al., Numerical Recipes, 6.4)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                          -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def _regularized_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    if math.isnan(t):
        return math.nan
    tail = 0.5 * _regularized_beta(df / 2.0, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0
    return tail if t >= 0 else 1.0 - tail


def t_ppf(p: float, df: float) -> float:
    """The t with P(T <= t) = p, by bisection."""
    low, high = -1.0, 1.0
    while t_sf(high, df) > 1.0 - p:
        high *= 2.0
    while t_sf(low, df) < 1.0 - p:
        low *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        low, high = (middle, high) if t_sf(middle, df) > 1.0 - p else (low, middle)
    return (low + high) / 2.0


def _apply(fn, first: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(d) else fn(x, d) for x, d in zip(first, df)], dtype="float64")


@pandas_udf(DoubleType())
def student_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(t_sf, t, df)


@pandas_udf(DoubleType())
def student_ppf(p: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(t_ppf, p, df)
