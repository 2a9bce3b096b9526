"""Sets of pairs of wallets: against brute force, and without rows for pairs of pairs that nobody meets."""

import datetime
import itertools
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from marlspike.operators import pairsets
from marlspike.queries import monitoring, patterns
from marlspike.queries.views import WALLET_SQL
from verify import _rows

from tests.conftest import rows

DATA = "/root/testdata/sf0.01"
START = datetime.datetime(2026, 1, 1)


@pytest.mark.skipif(not Path(DATA).exists(), reason="test data absent")
def test_cross_pair_features_writes_met_pairs_only(spark, monkeypatch):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW horizon_trade AS SELECT * FROM read_parquet('{DATA}/horizon_trade.parquet')")
    met = set(db.execute(f"""WITH {WALLET_SQL}, r AS (SELECT DISTINCT wallet, pair_key, ts FROM wrows)
SELECT DISTINCT a.pair_key, b.pair_key FROM r a JOIN r b ON a.wallet = b.wallet AND a.pair_key < b.pair_key AND b.ts BETWEEN a.ts - INTERVAL 10 MINUTE AND a.ts + INTERVAL 10 MINUTE""").fetchall())
    written, durable = [], patterns.durable

    def kept(df, label):
        out = durable(df, label)
        if {"pair_key", "other"} <= set(out.columns):
            written.extend(map(tuple, out.select("pair_key", "other").distinct().collect()))
        return out

    monkeypatch.setattr(patterns, "durable", kept)
    monkeypatch.setattr(pairsets, "BLOCK", 16)
    monkeypatch.setattr(pairsets, "_CELLS", 50)
    df = entry.queries()["cross_pair_features_wide"](spark, DATA)
    got = _rows(df.columns, df.collect())
    assert written and set(written) <= met
    result = db.execute(entry.oracle_sql()["cross_pair_features_wide"])
    assert got and got == _rows([c[0] for c in result.description], result.fetchall())


def test_near_other_pairs_edges(spark):
    at = lambda s: START + datetime.timedelta(seconds=s)
    day = 86_400
    mine = [("w", "a", at(0)), ("w", "a", at(day - 1)), ("w", "b", at(3 * day)), ("v", "a", at(0)), ("u", "c", at(5))]
    sets = [("w", "a"), ("w", "b"), ("v", "a"), ("v", "c"), ("u", "c")]
    # 600 seconds before the first, 600 seconds after the second in the next day, nothing near the third; c one second too late for v
    trades = [("a", at(0)), ("a", at(day - 1)), ("b", at(-600)), ("b", at(day + 599)), ("b", at(3 * day)), ("a", at(3 * day + 601)), ("c", at(601)), ("x", at(0))]
    found = pairsets.near_other_pairs(
        spark.createDataFrame(mine, "wallet string, pair_key string, ts timestamp_ntz"), spark.createDataFrame(sets, "wallet string, pair_key string"), spark.createDataFrame(trades, "pair_key string, ts timestamp_ntz")
    )
    assert rows(found.select("wallet", "n", "b")) == [("u", 1, 0), ("v", 1, 0), ("w", 3, 2)]


@pytest.mark.skipif(not Path(DATA).exists(), reason="test data absent")
def test_best_rank_correlation_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairsets, "BLOCK", 16)
    r = {(x["pair_key"], x["other"]): x["r"] for x in monitoring.spearman_pairs(spark, DATA).collect()}
    names = sorted({k for x in r for k in x})
    sets = {f"w{i}": names[i::9] for i in range(9)} | {"all": names, "one": names[:1]}
    e, per = monitoring.daily_ranks(spark, DATA)
    members = spark.createDataFrame([(w, p) for w, x in sets.items() for p in x], "wallet string, pair_key string")
    found = {x["wallet"]: x["r"] for x in pairsets.best_rank_correlation(members, e, per).collect()}
    assert found.keys() == sets.keys() - {"one"}
    for w, x in found.items():
        assert abs(x - max(r[c] for c in itertools.combinations(sets[w], 2) if r[c] is not None)) < 6e-7


def test_common_wallets_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairsets, "SIDE", 5)
    monkeypatch.setattr(pairsets, "_ROWS", 2)
    monkeypatch.setattr(pairsets, "_CELLS", 7)
    # one wallet of all pairs, some of few, pairs that share none but the first
    sets = {f"w{i}": {f"p{(i * 7 + k * (i + 1)) % 23:02}" for k in range(i % 6 + 1)} for i in range(40)} | {"all": {f"p{k:02}" for k in range(22)}, "lone": {"p99"}}
    members = spark.createDataFrame([(w, p) for w, x in sets.items() for p in sorted(x)], "wallet string, pair_key string")
    number = lambda c: monitoring.numbered(members.select(c).distinct(), c)
    df = pairsets.common_wallets(number("pair_key"), number("wallet"), members)
    want = {}
    for x in sets.values():
        for c in itertools.combinations(sorted(x), 2):
            want[c] = want.get(c, 0) + 1
    assert rows(df.select("pair_key", "other", "wallets")) == sorted(((*c, k) for c, k in want.items()), key=repr)
