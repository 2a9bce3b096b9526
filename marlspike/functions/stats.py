"""Statistics with defined results on degenerate input."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, ``default`` where b is zero or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def exact_sum(name: str) -> Column:
    """Aggregate: sum of a double column, added up as decimals of eight digits, so order doesn't matter."""
    return F.sum(F.col(name).cast("decimal(38,8)")).cast("double")


def safe_corr(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation, null where a side is constant or too short."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((F.count(x) > 1) & (sx > 1e-12) & (sy > 1e-12), F.covar_pop(x, y) / (sx * sy))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def normal_quantile(p: float) -> float:
    """Inverse of the standard normal distribution by bisection on the error function."""
    low, high = -10.0, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (low, mid)
    return (low + high) / 2


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution for any degrees of freedom.

    Recurrence over degrees in steps of two from the closed forms for 1 and 2;
    beyond 300 degrees the cube root's normal approximation.
    """
    if x <= 0 or df <= 0:
        return 1.0
    if df > 300:
        v = 2 / (9 * df)
        return 0.5 * math.erfc(((x / df) ** (1 / 3) - (1 - v)) / math.sqrt(2 * v))
    h = x / 2
    if df % 2:
        tail, term, k = math.erfc(math.sqrt(h)), math.sqrt(h) * math.exp(-h) / math.gamma(1.5), 1.5
    else:
        tail, term, k = 0.0, math.exp(-h), 1.0
    while k <= df / 2:
        tail += term
        term *= h / k
        k += 1
    return min(1.0, tail)


def multinomial_pvalues(counts: np.ndarray, shares: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Monte-Carlo p-value of the chi-square statistic for each row of counts.

    Rows of one total share their draws, made once from (seed, total) and sorted,
    so a row costs a binary search; its p-value depends on its counts alone.
    """
    out = np.ones(len(counts))
    totals = counts.sum(axis=1)
    for n in np.unique(totals[totals > 0]):
        expected = n * shares
        sample = np.random.default_rng([seed, int(n)]).multinomial(int(n), shares / shares.sum(), size=draws)
        drawn = np.sort(((sample - expected) ** 2 / expected).sum(axis=1))
        rows = totals == n
        seen = ((counts[rows] - expected) ** 2 / expected).sum(axis=1)
        above = draws - np.searchsorted(drawn, seen - 1e-9 * np.maximum(1, seen))
        out[rows] = np.maximum(1 / draws, above / draws)
    return out
