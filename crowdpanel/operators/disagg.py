"""Quarterly totals spread over days with exact sum-back.

One series is a calendar-sized group (its days), many series run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Quarter coverage and the autocorrelation grid.
MIN_QUARTER_DAYS = 88
RHO_GRID = (0.05, 0.98, 40)
OUT = "series string, date date, period string, value_daily double, se double, rho double"


def quarter_key(date: str = "date"):
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


def period_totals(daily: DataFrame, value: str, conversion: str = "sum") -> DataFrame:
    """Sums (or means) of a daily series per quarter, with the number of days."""
    fold = F.sum(value) if conversion == "sum" else F.avg(value)
    return daily.groupBy("series", quarter_key().alias("period")).agg(fold.alias("total"), F.count("*").alias("n_days"))


def usable_days(totals: DataFrame, indicator: DataFrame, strict: bool = False) -> DataFrame:
    """Indicator days of the quarters both sides hold with enough days.

    Default: at least 88 days. ``strict`` asks for every day of the quarter.
    """
    days = indicator.withColumn("period", quarter_key())
    full = F.datediff(F.add_months(F.trunc("date", "quarter"), 3), F.trunc("date", "quarter"))
    n = days.groupBy("series", "period").agg(F.count("*").alias("n_days"), F.max(full).alias("full_days"))
    enough = F.col("n_days") >= (F.col("full_days") if strict else F.lit(MIN_QUARTER_DAYS))
    kept = totals.select("series", "period", "total").join(n.filter(enough), ["series", "period"])
    return days.join(kept, ["series", "period"])


def spread_prorata(days: DataFrame) -> DataFrame:
    """Quarter total times the day's share of the indicator."""
    share = F.col("ind") / F.sum("ind").over(Window.partitionBy("series", "period"))
    return days.withColumn("value_daily", F.col("total") * share)


def _layout(pdf: pd.DataFrame):
    """Days in order, indicator, quarter index per day and quarter totals."""
    pdf = pdf.sort_values("date", ignore_index=True)
    codes, periods = pd.factorize(pdf["period"])
    totals = pdf.groupby(codes)["total"].first().to_numpy(float)
    return pdf, pdf["ind"].to_numpy(float), codes, totals, np.eye(len(periods))[codes]


def denton_series(p: np.ndarray, quarter: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Smoothest ratio x/p (least squared first differences) with exact quarter sums.

    Stationarity makes the second difference of the ratio proportional to p within
    each quarter, so the ratio is a constant plus a double running sum of known
    shapes: one small system in (quarters + 1) unknowns replaces the full one.
    """
    # Scaling the ratio to one keeps the small system well conditioned.
    p = p / p.mean()
    mask = np.eye(quarter.max() + 1)[quarter]
    shapes = mask * p[:, None]
    slopes = -np.cumsum(shapes, axis=0)[:-1]
    ratio = np.vstack([np.zeros(shapes.shape[1]), np.cumsum(slopes, axis=0)]) / len(p) ** 2
    sums = mask.T @ (p[:, None] * ratio)
    weight = shapes.sum(axis=0)
    system = np.block([[sums, weight[:, None]], [weight[None, :], np.zeros((1, 1))]])
    solved = np.linalg.lstsq(system, np.append(totals, 0.0), rcond=None)[0]
    x = p * (ratio @ solved[:-1] + solved[-1])
    # Remove the rounding left in each quarter in proportion to p.
    return x + shapes @ ((totals - mask.T @ x) / weight)


def _ar1(rho: float, v: np.ndarray) -> np.ndarray:
    """Matrix rho^|t-s| times v through one forward and one backward recursion."""
    ahead, back = v.astype(float).copy(), v.astype(float).copy()
    for t in range(1, len(v)):
        ahead[t] += rho * ahead[t - 1]
        back[-1 - t] += rho * back[-t]
    return ahead + back - v


def chowlin_series(p: np.ndarray, quarter: np.ndarray, totals: np.ndarray):
    """GLS on quarter sums with AR(1) errors; returns (x, se, rho) of the best rho."""
    mask = np.eye(quarter.max() + 1)[quarter]
    design = np.column_stack([np.ones(len(p)), p])
    low = mask.T @ design
    n_low = len(totals)
    best = None
    for rho in (0.0, *np.linspace(*RHO_GRID)):
        vc = mask if rho == 0.0 else _ar1(rho, mask)
        cvc = mask.T @ vc
        inv = np.linalg.inv(cvc)
        info = low.T @ inv @ low
        beta = np.linalg.solve(info, low.T @ inv @ totals)
        u = totals - low @ beta
        sigma2 = float(u @ inv @ u) / n_low
        loglik = -0.5 * (n_low * np.log(max(sigma2, 1e-300)) + np.linalg.slogdet(cvc)[1])
        if best is None or loglik > best[0]:
            best = (loglik, rho, vc, inv, info, beta, u, sigma2)
    _, rho, vc, inv, info, beta, u, sigma2 = best
    gain = vc @ inv
    x = design @ beta + gain @ u
    lever = design - gain @ low
    spread = 1.0 - np.einsum("tq,tq->t", gain, vc)
    from_beta = np.einsum("ti,ij,tj->t", lever, np.linalg.inv(info), lever)
    dof = max(n_low - 2, 1)
    scale = sigma2 * n_low / dof
    return x, np.sqrt(np.maximum(scale * (spread + from_beta), 0.0)), rho


def _denton(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, p, quarter, totals, _ = _layout(pdf)
    if (p <= 0).any():
        raise ValueError("the indicator must be positive")
    return pdf[["series", "date", "period"]].assign(value_daily=denton_series(p, quarter, totals), se=np.nan, rho=np.nan)


def _chowlin(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, p, quarter, totals, _ = _layout(pdf)
    x, se, rho = chowlin_series(p, quarter, totals)
    return pdf[["series", "date", "period"]].assign(value_daily=x, se=se, rho=rho)


def spread_denton(days: DataFrame) -> DataFrame:
    """Proportional first-difference spread per series."""
    return days.groupBy("series").applyInPandas(_denton, OUT)


def spread_chowlin(days: DataFrame) -> DataFrame:
    """Regression spread with per-day standard errors per series."""
    return days.groupBy("series").applyInPandas(_chowlin, OUT)


METHODS = {"prorata": spread_prorata, "denton": spread_denton, "chowlin": spread_chowlin}


def disaggregate(totals: DataFrame, indicator: DataFrame, method: str = "denton", strict: bool = False) -> DataFrame:
    """Daily values of the usable quarters. ``indicator`` is (series, date, ind)."""
    days = usable_days(totals, indicator, strict).select("series", "date", "period", "ind", "total")
    return METHODS[method](days)


def sum_back(daily: DataFrame, totals: DataFrame) -> DataFrame:
    """Per series: quarters, largest relative sum-back error and smallest daily value."""
    back = daily.groupBy("series", "period").agg(F.sum("value_daily").alias("s"), F.min("value_daily").alias("lo"))
    err = F.abs(F.col("s") - F.col("total")) / F.abs("total")
    return back.join(totals.select("series", "period", "total"), ["series", "period"]).groupBy("series").agg(
        F.count("*").alias("n_quarters"), F.max(err).alias("max_rel_error"), F.min("lo").alias("min_value"))
