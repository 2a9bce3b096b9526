"""Mean correlation of filled daily scores: long calendars, and what reaches the driver."""

import datetime

import numpy as np

import __spark_entry__ as entry

START = datetime.datetime(2026, 1, 5, 12)
SCORES = "id long, wallet string, asset_pair string, score int, timestamp timestamp_ntz"


def corr(spark, tmp_path, scores):
    """The query's result over rows of (pair, days after the start, score)."""
    data = [(i, "w", pair, score, None if day is None else START + datetime.timedelta(day)) for i, (pair, day, score) in enumerate(scores)]
    spark.createDataFrame(data, SCORES).write.mode("overwrite").parquet(f"{tmp_path}/risk_scores.parquet")
    return dict(map(tuple, entry.queries()["pairwise_corr"](spark, str(tmp_path)).collect()))


def brute(scores):
    """Every pair's series laid out day by day."""
    known = [(p, day, x) for p, day, x in scores if p is not None and day is not None]
    first, n = min(day for _, day, _ in known), max(day for _, day, _ in known) - min(day for _, day, _ in known) + 1
    z, out = {}, dict.fromkeys(p for p, _, _ in known)
    for p in out:
        at = {}
        for q, day, x in known:
            if q == p and x is not None and 0 <= x <= 100:
                at.setdefault(day - first, []).append(x)
        if at:
            days = sorted(at)
            series = np.repeat([round(np.mean(at[k]), 6) for k in days], np.diff([0, *days[1:], n]))
            if series.min() < series.max():
                z[p] = (series - series.mean()) / series.std()
    return out | {p: np.mean([np.mean(z[p] * z[q]) for q in z if q != p]) if len(z) > 1 else None for p in z}


def same(got, want):
    assert got.keys() == want.keys()
    for p, r in want.items():
        assert (r is None) == (got[p] is None) and (r is None or abs(got[p] - r) < 6e-6), (p, got[p], r)


def some(seed, days):
    rng = np.random.default_rng(seed)
    rows = [(f"P{rng.integers(7)}", int(rng.integers(days)), int(rng.integers(-5, 110))) for _ in range(120)]
    return [*rows, ("FLAT", 3, 40), ("FLAT", 9, 40), ("NONE", 2, None), ("BAD", 4, 999), ("ONE", 5, 7), (None, 1, 50), ("P0", None, 50), ("P1", 0, 10), ("P2", days, 90)]


def test_pairwise_corr_broadcasts_no_row_per_day(spark, tmp_path):
    """Only single rows may be broadcast by force; a table of the days is left to the cluster's threshold."""
    scores = some(1, 140)
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxBroadcastTableSize": "16k"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got = corr(spark, tmp_path, scores)
    finally:
        for k in keys:
            spark.conf.unset(k)
    same(got, brute(scores))


def test_pairwise_corr_forms_no_calendar(spark, tmp_path, monkeypatch):
    """A stray date far off adds a scored day, not a calendar of rows."""
    from marlspike.queries import monitoring

    written, durable = [], monitoring.durable

    def kept(df, label):
        out = durable(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(monitoring, "durable", kept)
    scores = [*some(2, 140), ("P3", 700_000, 20), ("P4", -20_000, 70)]
    same(corr(spark, tmp_path, scores), brute(scores))
    assert sum(written) <= len(scores)


def test_pairwise_corr_constant_single_and_empty(spark, tmp_path):
    assert corr(spark, tmp_path, [("A", 0, 10), ("A", 4, 30), ("B", 2, 50)]) == {"A": None, "B": None}
    assert corr(spark, tmp_path, [("A", 0, 10), ("A", 4, 30), ("B", 0, 5), ("B", 4, 6)]) == {"A": 1.0, "B": 1.0}
    assert corr(spark, tmp_path, [("A", 0, 10), ("B", 0, 30)]) == {"A": None, "B": None}
    assert corr(spark, tmp_path, [(None, 0, 10)]) == {}
