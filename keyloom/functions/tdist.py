"""Student's t and normal tails as columns.

Tails are computed themselves, not as one minus the rest, so that small p-values stay exact: the t tail is the regularised
incomplete beta function by its continued fraction, for any degrees of freedom; the normal tail is the complementary error
function. Spark has neither; the functions take Arrow batches, one number per test or group.
"""

from __future__ import annotations

import math
import sys
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from keyloom.session import ship_with_tasks

ship_with_tasks(sys.modules[__name__])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz steps)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            c = 1.0 + numerator / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            step = c * d
            total *= step
        if abs(step - 1.0) < 1e-15:
            break
    return total


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def tail_probability(t: float, dof: int) -> float:
    """P(|T| >= t)."""
    t2 = t * t
    if t2 < dof:  # near the centre the complement is the accurate side
        return 1.0 - incomplete_beta(0.5, dof / 2.0, t2 / (dof + t2))
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + t2))


def central_probability(t: float, dof: int) -> float:
    """P(-t <= T <= t)."""
    return incomplete_beta(0.5, dof / 2.0, t * t / (dof + t * t))


@lru_cache(maxsize=10_000)
def quantile(dof: int, confidence: float = 0.95) -> float:
    """t such that the central probability equals ``confidence``, by bisection."""
    low, high = 0.0, 1.0
    while central_probability(high, dof) < confidence:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if central_probability(middle, dof) < confidence:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def quantile_column(dof: Column, confidence: float = 0.95) -> Column:
    """:func:`quantile` of an integer column; NULL below one degree of freedom."""

    @F.pandas_udf(DoubleType())
    def column(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) or v < 1 else quantile(int(v), confidence)).astype(float)

    return F.when(dof >= 1, column(dof.cast("long")))


@F.pandas_udf(DoubleType())
def _tails(t: pd.Series, dof: pd.Series) -> pd.Series:
    pairs = zip(t, dof, strict=True)
    return pd.Series([None if pd.isna(x) or pd.isna(v) or v < 1 else tail_probability(float(x), int(v)) for x, v in pairs], dtype=float)


@F.pandas_udf(DoubleType())
def _normal_tails(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2.0))).astype(float)


def two_sided_p(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|); NULL where ``t`` is NULL or ``dof`` < 1."""
    return F.when(t.isNotNull() & (dof >= 1), _tails(F.abs(t), dof.cast("long")))


def normal_two_sided_p(z: Column) -> Column:
    """P(|Z| >= |z|) for a standard normal Z; NULL where ``z`` is NULL."""
    return F.when(z.isNotNull(), _normal_tails(z))
