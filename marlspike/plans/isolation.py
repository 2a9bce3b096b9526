"""Outlier scores by random isolation trees, grown on a bounded sample and laid over all rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _usual_depth(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n values."""
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def _grow(x: np.ndarray, rng: np.random.Generator, room: int) -> tuple:
    """A tree as (feature, cut, left, right), a leaf as (rows,)."""
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) else []
    if room == 0 or len(x) <= 1 or not len(spread):
        return (len(x),)
    f = int(rng.choice(spread))
    cut = rng.uniform(x[:, f].min(), x[:, f].max())
    below = x[:, f] < cut
    return f, cut, _grow(x[below], rng, room - 1), _grow(x[~below], rng, room - 1)


def _depths(tree: tuple, x: np.ndarray, rows: np.ndarray, depth: int, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[rows] += depth + _usual_depth(tree[0])
        return
    below = x[rows, tree[0]] < tree[1]
    _depths(tree[2], x, rows[below], depth + 1, out)
    _depths(tree[3], x, rows[~below], depth + 1, out)


def isolation_scores(rows: DataFrame, key: str, features: list[str], trees: int = 100, sample: int = 256, fit_rows: int = 20_000, seed: int = 11) -> DataFrame:
    """(key, outlier): 1 - 2^(-mean depth / usual depth) turned so that easily isolated rows are near 1.

    Each tree is grown on ``sample`` rows drawn from at most ``fit_rows`` rows (in
    order of a seeded hash of the key) that come to the driver; every row is
    scored, in Arrow batches. Nulls and NaN count as 0. Equal keys get equal
    scores for equal features. No rows give no scores.
    """
    clean = rows.select(key, *[F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in features])
    fit = clean.orderBy(F.xxhash64(F.lit(seed), key), key).limit(fit_rows).select(*features).toPandas().to_numpy(float)
    if not len(fit):
        return clean.select(key, F.lit(0.0).alias("outlier")).limit(0)
    rng = np.random.default_rng(seed)
    size = min(sample, len(fit))
    room = max(1, math.ceil(math.log2(max(2, size))))
    forest = [_grow(fit[rng.choice(len(fit), size, replace=False)], rng, room) for _ in range(trees)]
    usual = max(_usual_depth(size), 1e-9)

    def score(batches):
        for f in batches:
            x, total = f[features].to_numpy(float), np.zeros(len(f))
            for tree in forest:
                _depths(tree, x, np.arange(len(f)), 0, total)
            yield pd.DataFrame({key: f[key], "outlier": 2 ** (-total / trees / usual)})

    return clean.mapInPandas(score, f"`{key}` {clean.schema[key].dataType.simpleString()}, outlier double")
