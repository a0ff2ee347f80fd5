"""Tail probabilities for the test tables.

A test table has one row per tested feature, so these run on a handful of rows.
They work with logarithms, which keeps p-values down to about 1e-308 exact to
many digits; below that they are 0.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship these functions to the executors by value, so that no package has to be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TINY = 1e-300
_STOP = 1e-16


def _away_from_zero(value: float) -> float:
    return value if abs(value) > _TINY else _TINY


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    value, c, d = 1.0, 1.0, 0.0
    for index in range(1, int(2000 + 20 * math.sqrt(max(a, b)))):
        m = index // 2
        if index % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / _away_from_zero(1.0 + term * d)
        c = _away_from_zero(1.0 + term / c)
        value *= c * d
        if abs(c * d - 1.0) < _STOP:
            break
    return 1.0 / value


def _log_half_power(log_x: float, log_y: float, a: float, b: float) -> float:
    """log of x^a y^b / B(a, b)."""
    return a * log_x + b * log_y - _log_beta(a, b)


def _log_beta(a: float, b: float) -> float:
    small, large = min(a, b), max(a, b)
    if large < 1e4:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    # lgamma(large) - lgamma(large + small) by Stirling, free of cancellation.
    def correction(z: float) -> float:
        return 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)

    total = large + small
    difference = (
        -small * math.log(total)
        - (large - 0.5) * math.log1p(small / large)
        + small
        + correction(large)
        - correction(total)
    )
    return math.lgamma(small) + difference


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom."""
    if not (math.isfinite(df) and df > 0) or math.isnan(t):
        return math.nan
    if t == 0:
        return 1.0
    if math.isinf(t):
        return 0.0
    if df > 1e7:
        # The incomplete beta loses digits here; this normal form is exact to 1e-12.
        z = (8 * df + 1) / (8 * df + 3) * math.sqrt(df * math.log1p(t * t / df))
        return math.erfc(z / math.sqrt(2))
    a, b = df / 2.0, 0.5
    square = t * t
    log_x = -math.log1p(square / df)  # log(df / (df + t^2))
    x = math.exp(log_x)
    y = square / (df + square)
    log_front = _log_half_power(log_x, math.log(y), a, b)
    if x < (a + 1) / (a + b + 2):
        return _exp(log_front - math.log(a) + math.log(_beta_fraction(a, b, x)))
    return 1.0 - math.exp(log_front - math.log(b)) * _beta_fraction(b, a, y)


def chi_square_upper(value: float, df: float) -> float:
    """P(X >= value) for the chi-square distribution with ``df`` degrees of freedom."""
    if math.isnan(value) or not df > 0:
        return math.nan
    if value <= 0:
        return 1.0
    a, x = df / 2.0, value / 2.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    limit = int(2000 + 20 * math.sqrt(a))
    if x < a + 1:
        term = total = 1.0 / a
        for index in range(1, limit):
            term *= x / (a + index)
            total += term
            if term < total * _STOP:
                break
        return 1.0 - math.exp(log_front) * total
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    fraction = d
    for index in range(1, limit):
        step = -index * (index - a)
        b += 2
        d = 1 / _away_from_zero(step * d + b)
        c = _away_from_zero(b + step / c)
        fraction *= c * d
        if abs(c * d - 1) < _STOP:
            break
    return _exp(log_front + math.log(fraction))


def _exp(power: float) -> float:
    return math.exp(power) if power > -745 else 0.0


def _each(function, first: pd.Series, second: pd.Series) -> pd.Series:
    pairs = zip(first, second)
    return pd.Series(
        [None if pd.isna(a) or pd.isna(b) else function(float(a), float(b)) for a, b in pairs],
        dtype="float64",
    )


_student_udf = F.pandas_udf(
    lambda t, df: _each(student_two_sided, t, df), T.DoubleType()
)
_chi_square_udf = F.pandas_udf(
    lambda value, df: _each(chi_square_upper, value, df), T.DoubleType()
)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic."""
    return _student_udf(t.cast("double"), df.cast("double"))


def correlation_p(r: Column, rows: Column) -> Column:
    """Two-sided p-value of a correlation of ``rows`` pairs against zero."""
    df = (rows - 2).cast("double")
    left = (1 - r) * (1 + r)
    # A perfect correlation has an infinite statistic.
    t = F.when(left > 0, r * F.sqrt(df / left)).when(left.isNotNull(), float("inf"))
    return student_p(F.when(df > 0, t), F.when(df > 0, df))


def chi_square_p(value: Column, df: Column) -> Column:
    """Upper-tail p-value of a chi-square statistic."""
    return _chi_square_udf(value.cast("double"), df.cast("double"))
