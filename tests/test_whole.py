"""Queries over all pairs, wallets and rows, compared with SQL of their own."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from marlspike.queries.views import TRADES_SQL, WALLET_SQL
from verify import _rows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test data absent")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def same(spark, db, name, sql):
    """The rows, if they are the same as those of the SQL."""
    df = entry.queries()[name](spark, DATA)
    found = df.collect()
    result = db.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, found) == _rows(columns, result.fetchall())
    return found


def test_cross_pair_wallets_all_pairs(spark, db):
    found = same(spark, db, "cross_pair_wallets", f"""WITH {WALLET_SQL}, r AS (SELECT DISTINCT wallet, pair_key, ts FROM wrows)
SELECT a.pair_key, b.pair_key AS pair_b, count(DISTINCT a.wallet) AS wallets FROM r a JOIN r b ON a.wallet = b.wallet AND a.pair_key < b.pair_key
AND b.ts BETWEEN a.ts - INTERVAL 10 MINUTE AND a.ts + INTERVAL 10 MINUTE GROUP BY 1, 2""")
    majors = {"VUSD/XLM", "AQUR/XLM", "EURV/VUSD"}
    assert {r["pair_key"] for r in found} - majors


def test_spearman_pairs_from_ten_days(spark, db):
    found = same(spark, db, "spearman_pairs", f"""WITH {TRADES_SQL}, dl AS (SELECT pair_key, CAST(ts AS DATE) AS day, round(sum(amount), 6) AS v FROM trades GROUP BY ALL),
p AS (SELECT pair_key FROM dl WHERE v > 0 GROUP BY 1 HAVING count(*) >= 10),
g AS (SELECT p.pair_key, c.day, coalesce(v, 0) AS v FROM p CROSS JOIN (SELECT DISTINCT day FROM dl) c LEFT JOIN dl ON dl.pair_key = p.pair_key AND dl.day = c.day),
r AS (SELECT *, rank() OVER (PARTITION BY pair_key ORDER BY v) + (count(*) OVER (PARTITION BY pair_key, v) - 1) / 2 AS r FROM g)
SELECT x.pair_key, y.pair_key AS other, count(*) FILTER (x.v > 0 AND y.v > 0) AS days, round(covar_pop(x.r, y.r) / nullif(stddev_pop(x.r) * stddev_pop(y.r), 0), 6) AS r
FROM r x JOIN r y ON x.day = y.day AND x.pair_key < y.pair_key GROUP BY 1, 2""")
    assert found and min(r["days"] for r in found) < 60


FILL = """sc AS (SELECT * FROM risk_scores WHERE asset_pair IS NOT NULL AND timestamp IS NOT NULL),
dly AS (SELECT asset_pair, CAST(timestamp AS DATE) AS day, avg(score) AS m FROM sc WHERE score BETWEEN 0 AND 100 GROUP BY ALL),
gd AS (SELECT asset_pair, CAST(unnest(generate_series((SELECT min(timestamp)::DATE FROM sc), (SELECT max(timestamp)::DATE FROM sc), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT asset_pair FROM sc)),
fill AS (SELECT g.asset_pair, strftime(g.day, '%Y-%m-%d') AS day, round(coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY g.asset_pair ORDER BY g.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(m IGNORE NULLS) OVER (PARTITION BY g.asset_pair ORDER BY g.day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 20.0), 6) AS score FROM gd g LEFT JOIN dly ON dly.asset_pair = g.asset_pair AND dly.day = g.day)"""


def test_series_of_all_pairs(spark, db):
    found = same(spark, db, "ffill_bfill", f"WITH {FILL} SELECT * FROM fill")
    assert len({r["asset_pair"] for r in found}) > 10


def test_pairwise_corr_all_pairs(spark, db):
    want = dict(db.execute(f"""WITH {FILL}, sd AS (SELECT asset_pair, stddev_pop(score) AS sd FROM fill GROUP BY 1), f AS (SELECT fill.*, sd FROM fill JOIN sd USING (asset_pair)),
c AS (SELECT a.asset_pair, b.asset_pair AS o, CASE WHEN min(a.sd) > 1e-12 AND min(b.sd) > 1e-12 THEN covar_pop(a.score, b.score) / (min(a.sd) * min(b.sd)) END AS r FROM f a JOIN f b ON a.day = b.day AND a.asset_pair <> b.asset_pair GROUP BY 1, 2)
SELECT asset_pair, avg(r) FROM c GROUP BY 1""").fetchall())
    got = dict(map(tuple, entry.queries()["pairwise_corr"](spark, DATA).collect()))
    assert len(want) > 10 and got.keys() == want.keys()
    for k, r in want.items():
        assert (r is None) == (got[k] is None) and (r is None or abs(got[k] - r) < 6e-6)


def test_shared_wallets_all_pairs(spark, db):
    found = same(spark, db, "shared_wallets", f"""WITH {WALLET_SQL}, p AS (SELECT DISTINCT wallet, pair_key FROM wrows)
SELECT a.pair_key, b.pair_key AS other, count(*) AS wallets FROM p a JOIN p b ON a.wallet = b.wallet AND a.pair_key < b.pair_key GROUP BY 1, 2""")
    assert len(found) > 45


def test_alerts_fold_every_score(spark, db):
    want = {}
    for wallet, score in db.execute("SELECT wallet, score FROM risk_scores WHERE wallet IS NOT NULL AND score BETWEEN 0 AND 100 AND timestamp IS NOT NULL ORDER BY timestamp, id, score").fetchall():
        w = want.setdefault(wallet, {"on": False, "last": 0, "below": 0, "opened": 0, "escalated": 0, "resolved": 0})
        high = score >= 80
        w["below"] = w["below"] + 1 if w["on"] and not high else 0
        if not w["on"]:
            w["on"], w["opened"] = high, w["opened"] + high
        elif high:
            w["escalated"] += score > w["last"] + 10
        elif w["below"] == 3:
            w["on"], w["below"], w["resolved"] = False, 0, w["resolved"] + 1
        w["last"] = score
    got = {r["wallet"]: (r["open"], r["opened"], r["escalated"], r["resolved"]) for r in entry.queries()["alert_state_machine"](spark, DATA).collect()}
    assert got == {k: (w["on"], w["opened"], w["escalated"], w["resolved"]) for k, w in want.items()}


def test_reordered_files_release_every_line(spark, db):
    same(spark, db, "stream_reordered_files", "SELECT feed, count(DISTINCT (file_seq, line_no)) AS released FROM horizon_trade_raw GROUP BY 1")
