"""p-values of the t and normal distributions, as Arrow UDFs on small tables of test statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def normal_two_tailed(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def beta_fraction(x: float, a: float, b: float, rounds: int = 300, small: float = 1e-15) -> float:
    """Regularised incomplete beta function by its even and odd continued-fraction terms."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_fraction(1 - x, b, a, rounds, small)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Modified Lentz: value holds the fraction 1/(1 + term_1/(1 + term_2/(1 + ...))).
    value = c = 1e-300
    d = 0.0
    for k in range(rounds):
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / ((1.0 + term * d) or 1e-300)
        c = (1.0 + term / c) or 1e-300
        value *= c * d
        if k and abs(1.0 - c * d) < small:
            break
    return scale * value


def t_two_tailed(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    return min(1.0, max(0.0, beta_fraction(df / (df + t * t), df / 2.0, 0.5)))


@pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(n) else t_two_tailed(float(x), float(n)) for x, n in zip(t, df)], dtype="float64")


@pandas_udf(DoubleType())
def z_p_value(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else normal_two_tailed(float(x)) for x in z], dtype="float64")
