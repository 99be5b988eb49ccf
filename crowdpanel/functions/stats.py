"""Aggregate expressions shared by the estimators."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def std_error(x: Column) -> Column:
    """Sample sd over root n of the non-NULL values."""
    return F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x)))


def t_statistic(x: Column) -> Column:
    return F.try_divide(F.avg(x), F.nullif(std_error(x), F.lit(0.0)))


def ratio_of_sums(num: Column, den: Column) -> Column:
    """sum/sum, NULL on a zero denominator (not the mean of ratios)."""
    return F.try_divide(F.sum(num).cast("double"), F.nullif(F.sum(den).cast("double"), F.lit(0.0)))


def weighted_mean(x: Column, w: Column) -> Column:
    return F.try_divide(F.sum(x * w), F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0)))


def sum_if(cond: Column, x: Column) -> Column:
    return F.sum(F.when(cond, x))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def share_if(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def _student_half(x: float, df: float, n: int = 2000) -> float:
    """Chance of Student's t between 0 and x, a Simpson integral of its density."""
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    h = x / n
    pdf = [scale * (1 + (i * h) ** 2 / df) ** (-(df + 1) / 2) for i in range(n + 1)]
    return h / 3 * (pdf[0] + pdf[-1] + 4 * sum(pdf[1:-1:2]) + 2 * sum(pdf[2:-1:2]))


def student_p_value(t: float, df: float) -> float:
    """Chance of a value of Student's t at least as far from 0."""
    return max(0.0, 1 - 2 * _student_half(abs(t), df))


def student_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection."""
    if df > 1e6:
        return NormalDist().inv_cdf(p)
    target, lo, hi = abs(p - 0.5), 0.0, 200.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _student_half(mid, df) < target else (lo, mid)
    return math.copysign((lo + hi) / 2, p - 0.5)
