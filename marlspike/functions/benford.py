"""Leading-digit statistics as Column builders; everything stays in code generation.

A histogram is a list of nine count columns. Aggregating the histogram is one
pass of nine conditional counts, mergeable at every level.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Expected share of each leading digit.
EXPECTED = [math.log10(1 + 1 / k) for k in range(1, 10)]

#: Critical chi-square (8 degrees, 5 %), deviation threshold, KS factor.
CHI2_CRITICAL = 15.507
MAD_LIMIT = 0.015
KS_FACTOR = 1.358


def leading_digit(col: Column) -> Column:
    """First significant digit of a positive finite number, else null.

    Read from the shortest decimal text of the number, which is exact for round
    lots where a logarithm isn't.
    """
    ok = (col > 0) & (col < F.lit(float("inf")))
    return F.when(ok, F.regexp_extract(col.cast("string"), "[1-9]", 0).cast("int"))


def digit_counts(digit: Column, condition: Column | None = None) -> list[Column]:
    """Nine aggregates c1..c9: how often each leading digit occurs."""
    keep = F.lit(True) if condition is None else condition
    return [F.count_if((digit == k) & keep).alias(f"c{k}") for k in range(1, 10)]


def counts(prefix: str = "c") -> list[Column]:
    return [F.col(f"{prefix}{k}") for k in range(1, 10)]


def total(c: list[Column]) -> Column:
    out = c[0]
    for x in c[1:]:
        out = out + x
    return out


def _sum(parts: list[Column]) -> Column:
    return total(parts)


def chi_square(c: list[Column], n: Column) -> Column:
    """Chi-square distance of counts from the expected shares; 0 without counts."""
    parts = [F.pow(x - n * e, 2) / (n * e) for x, e in zip(c, EXPECTED)]
    return F.when(n > 0, _sum(parts)).otherwise(0.0)


def z_score(c: Column, n: Column, k: int) -> Column:
    """Z-score of digit k with continuity correction; 0 without counts."""
    e = EXPECTED[k - 1]
    gap = F.greatest(F.abs(c / n - e) - F.lit(1) / (n * 2), F.lit(0.0))
    return F.when(n > 0, gap / F.sqrt(F.lit(e * (1 - e)) / n)).otherwise(0.0)


def max_z(c: list[Column], n: Column) -> Column:
    return F.greatest(*[z_score(x, n, k) for k, x in enumerate(c, 1)])


def mean_deviation(c: list[Column], n: Column) -> Column:
    """Mean absolute deviation of the nine shares; 0 without counts."""
    return F.when(n > 0, _sum([F.abs(x / n - e) for x, e in zip(c, EXPECTED)]) / 9).otherwise(0.0)


def chi2_sf8(x: Column) -> Column:
    """Upper tail of the chi-square distribution with 8 degrees, in closed form."""
    h = x / 2
    return F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)


def _cumulative(c: list[Column], n: Column) -> list[Column]:
    out, run, expected = [], F.lit(0.0), 0.0
    for x, e in zip(c, EXPECTED):
        run, expected = run + x / n, expected + e
        out.append(run - expected)
    return out


def ks_statistic(c: list[Column], n: Column) -> Column:
    """Largest gap between observed and expected cumulative shares; null for n < 5."""
    return F.when(n >= 5, F.greatest(*[F.abs(x) for x in _cumulative(c, n)]))


def kuiper_statistic(c: list[Column], n: Column) -> Column:
    """Sum of the largest gaps above and below; null for n < 5."""
    gaps = _cumulative(c, n)
    above = F.greatest(*gaps, F.lit(0.0))
    below = F.greatest(*[-x for x in gaps], F.lit(0.0))
    return F.when(n >= 5, above + below)


def ks_lambda(d: Column, n: Column) -> Column:
    """Size-adjusted KS statistic; make it a column of its own before ``ks_pvalue``."""
    root = F.sqrt(n.cast("double"))
    return (root + 0.12 + F.lit(0.11) / root) * d


def ks_pvalue(lam: Column) -> Column:
    """Kolmogorov's series (100 terms) at the size-adjusted statistic."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, j: acc + F.pow(F.lit(-1.0), j - 1) * F.exp(-2.0 * j * j * lam * lam),
    )
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), terms * 2)))


def kuiper_lambda(v: Column, n: Column) -> Column:
    """Size-adjusted Kuiper statistic; make it a column of its own before ``kuiper_pvalue``."""
    root = F.sqrt(n.cast("double"))
    return (root + 0.155 + F.lit(0.24) / root) * v


def kuiper_pvalue(lam: Column) -> Column:
    """Kuiper's series (100 terms) at the size-adjusted statistic."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, j: acc + (4.0 * j * j * lam * lam - 1) * F.exp(-2.0 * j * j * lam * lam),
    )
    return F.when(lam < 0.4, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), terms * 2)))


def entropy(c: list[Column], n: Column) -> Column:
    """Entropy in nats of the nine shares; empty shares count as zero."""
    return -_sum([F.when(x > 0, (x / n) * F.log(x / n)).otherwise(0.0) for x in c])


EXPECTED_ENTROPY = -sum(e * math.log(e) for e in EXPECTED)
