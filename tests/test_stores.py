import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from marlspike.sources import stores
from tests.conftest import rows

T0 = dt.datetime(2026, 1, 1)


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 2, "y"), ("b", 3, "p"), ("b", 1, "q"), (None, 1, "n")], "k string, t int, v string")
    assert rows(stores.insert_new(old, new, "k", [F.col("t")])) == [("b", 1, "q")]
    assert rows(stores.latest_by_key([old, new], ["k"], ["t"])) == [("a", 2, "y"), ("b", 3, "p"), (None, 1, "n")]


def test_export_rewrites_only_changed_partitions(spark):
    path = tempfile.mkdtemp() + "/out"
    df = spark.createDataFrame([("d1", "p", "1"), ("d1", "p", "2"), ("d2", "p", "3")], "day string, pair string, token string")
    made = stores.export_partitions(df, path, ["day", "pair"], None, "token").collect()
    first = spark.createDataFrame(made, "day string, pair string, rows long, last string")
    before = {f: os.path.getmtime(os.path.join(r, f)) for r, _, fs in os.walk(path) for f in fs if "day=d1" in r and f.endswith("parquet")}
    more = df.unionAll(spark.createDataFrame([("d2", "p", "9")], df.schema))
    assert rows(stores.changed_partitions(stores.partition_states(more, ["day", "pair"], "token"), first, ["day", "pair"])) == [("d2", "p", 2, "9")]
    stores.export_partitions(more, path, ["day", "pair"], first, "token")
    after = {f: os.path.getmtime(os.path.join(r, f)) for r, _, fs in os.walk(path) for f in fs if "day=d1" in r and f.endswith("parquet")}
    assert before == after
    assert spark.read.parquet(path).count() == 4


def test_archive_and_pruned_read(spark):
    path = tempfile.mkdtemp() + "/cold"
    df = spark.createDataFrame([("w", T0 + dt.timedelta(days=k), k) for k in range(40)] + [("n", None, -1)], "wallet string, ts timestamp_ntz, v int")
    hot = stores.archive(df, "ts", F.lit("2026-01-31 00:00:00").cast("timestamp_ntz"), path)
    assert hot.count() == 11
    got = stores.read_tier(spark, path, "ts", dt.datetime(2026, 1, 5), dt.datetime(2026, 1, 8, 1), wallet="w")
    assert sorted(r["v"] for r in got.collect()) == [4, 5, 6, 7]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_chunks(spark):
    c = stores.chunk_table(spark, "2026-01-01 00:00:00", "2026-01-01 15:00:00")
    assert [(r[0].hour, r[1].hour) for r in c.orderBy("chunk_start").collect()] == [(0, 6), (6, 12), (12, 15)]
    assert stores.open_chunks(c, c.limit(2)).count() == 1
    assert stores.chunk_table(spark, "2026-01-02 00:00:00", "2026-01-01 00:00:00").count() == 0


def test_csv_and_bad_rows(spark):
    folder = tempfile.mkdtemp()
    with open(f"{folder}/a.csv", "w") as f:
        f.write("wallet,label,x\nw1,1,q\nw2,maybe,r\n")
    assert [(r["wallet"], r["label"]) for r in stores.labelled_csv(spark, folder).collect()] == [("w1", 1), ("w2", None)]
    with open(f"{folder}/a.csv", "w") as f:
        f.write("wallet,x\nw1,1\n")
    with pytest.raises(ValueError):
        stores.labelled_csv(spark, folder)
    df = spark.createDataFrame([(1,), (None,)], "v int")
    good, bad = stores.split_bad(df, F.when(F.col("v").isNull(), "missing"))
    assert rows(good) == [(1,)] and rows(bad) == [(None, "missing")]


def test_words(spark):
    cases = {"0x" + "0" * 63 + "5": (5.0, 5.0), "0x" + "f" * 64: (float(2**256 - 1), -1.0), "0x12": (None, None), None: (None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "w string").select(
        "w", stores.word_to_double(F.col("w"), scale=1.0).alias("u"), stores.word_to_double(F.col("w"), True, 1.0).alias("s")
    )
    for r in df.collect():
        u, s = cases[r["w"]]
        assert (r["u"] is None) == (u is None) and (u is None or abs(r["u"] - u) <= abs(u) * 1e-12)
        assert s is None or abs(r["s"] - s) < 1e-3 * 2.0**210
