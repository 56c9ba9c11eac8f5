"""Tail probabilities of reported statistics, for checking a stated p value against its statistic and degrees of freedom."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def _safe(v: float) -> float:
    return _TINY if abs(v) < _TINY else v


def regularized_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b), by its continued fraction (modified Lentz method)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - regularized_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / _safe(1.0 - (a + b) * x / (a + 1.0))
    h = d
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / _safe(1.0 + term * d)
            c = _safe(1.0 + term / c)
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return min(1.0, front * h)


def upper_gamma(a: float, x: float) -> float:
    """Q(a, x), the regularized upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    b, c = x + 1.0 - a, 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        c = b + an / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def tail(kind: str | None, value: float | None, df1: float | None, df2: float | None) -> float | None:
    """Two-sided p of z, t and r, upper tail of F and chi2; null where the statistic or its degrees of freedom are missing or impossible."""
    if kind is None or value is None or math.isnan(value):
        return None
    one = df1 is not None and not math.isnan(df1) and df1 > 0
    if kind == "z":
        return math.erfc(abs(value) / math.sqrt(2.0))
    if not one:
        return None
    if kind == "r":
        if abs(value) >= 1.0:
            return 0.0 if abs(value) == 1.0 else None
        kind, value = "t", value * math.sqrt(df1 / (1.0 - value * value))
    if kind == "t":
        return regularized_beta(df1 / 2.0, 0.5, df1 / (df1 + value * value))
    if kind == "chi2":
        return upper_gamma(df1 / 2.0, value / 2.0) if value >= 0 else None
    if kind == "F" and df2 is not None and not math.isnan(df2) and df2 > 0 and value >= 0:
        return regularized_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * value))
    return None


@F.pandas_udf(T.DoubleType())
def p_value(kind: pd.Series, value: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    none = lambda x: None if x is None or pd.isna(x) else float(x)
    return pd.Series([tail(k, none(v), none(a), none(b)) for k, v, a, b in zip(kind, value, df1, df2)], dtype="float64")


def interval_agrees(estimate: Column, error: Column, low: Column, high: Column, *, z: float = 1.959964, tolerance: float = 0.02) -> Column:
    """Is a stated interval estimate ± z·error, within a share of its width? Null where a part is missing."""
    slack = (high - low) * tolerance
    return (F.abs(estimate - z * error - low) <= slack) & (F.abs(estimate + z * error - high) <= slack)


def percentage_agrees(count: Column, total: Column, stated: Column, *, decimals: int = 1) -> Column:
    """Is a stated percentage the count's share of the total, as rounded to its decimals?"""
    return F.abs(F.try_divide(count * 100.0, total) - stated) <= F.lit(0.5 * 10.0**-decimals + 1e-9)
