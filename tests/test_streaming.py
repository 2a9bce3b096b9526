import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from marlspike.session import shared_dir
from marlspike.streaming.jobs import changed_by, drain, file_stream, first_by_key, in_sequence, tumbling
from tests.conftest import rows


def landed(spark, parts, schema):
    path = tempfile.mkdtemp() + "/in"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet"):
                at = os.path.getmtime(f"{path}/{f}")
                os.utime(f"{path}/{f}", (at, at))
    return path


def test_dedup_and_restart(spark):
    path = landed(spark, [[("a", 1), ("b", 2)], [("a", 3), ("c", 4)]], "k string, v int")
    place = shared_dir(spark, "place")
    s = first_by_key(file_stream(spark, path, 1).select("k"), "k")
    assert rows(drain(s, "out", checkpoint=place)) == [("a",), ("b",), ("c",)]
    spark.createDataFrame([("c", 5), ("d", 6)], "k string, v int").write.mode("append").parquet(path)
    s = first_by_key(file_stream(spark, path, 1).select("k"), "k")
    assert rows(drain(s, "out", checkpoint=place)) == [("a",), ("b",), ("c",), ("d",)]


def test_windows_equal_batch(spark):
    path = landed(spark, [[("2026-01-01 00:10:00", 1.0)], [("2026-01-01 00:50:00", 2.0), ("2026-01-01 01:00:00", 4.0)]], "t string, amount double")
    s = file_stream(spark, path, 1).select(F.to_timestamp("t").alias("ts"), "amount")
    out = drain(tumbling(s, "ts", "1 hour", []), "w", "complete").select(F.hour("start"), "n", "volume")
    assert rows(out) == [(0, 2, 3.0), (1, 1, 4.0)]


def test_changes(spark):
    path = landed(spark, [[("w", 1, 10.0), ("w", 2, 12.0), ("w", 3, 16.0)], [("w", 4, 15.0), ("w", 5, 30.0), ("x", 6, 1.0)]], "k string, i int, v double")
    out = drain(changed_by(file_stream(spark, path, 1), "k", ["i"], "v", 5.0), "c")
    assert rows(out) == [("w", 1, 10.0), ("w", 3, 16.0), ("w", 5, 30.0), ("x", 6, 1.0)]


def test_sequence(spark):
    path = landed(spark, [[("f", 1, "a"), ("f", 3, "c")], [("f", 2, "b"), ("f", 2, "again"), ("f", 9, "z")]], "k string, n long, p string")
    out = drain(in_sequence(file_stream(spark, path, 1), "k", "n", "p", hold=5), "s")
    assert rows(out) == [("f", 1, "a"), ("f", 2, "b"), ("f", 3, "c")]


def test_wallet_windows_after_a_restart(spark):
    import random

    from marlspike.streaming.windows import WINDOWS, last_per_wallet, wallet_windows

    rng, place, start = random.Random(3), shared_dir(spark, "windows"), dt.datetime(2026, 1, 1)
    data = [(rng.choice(["hot"] * 5 + ["w1", "w2"]), start + dt.timedelta(seconds=rng.randrange(50 * 86400)), rng.choice([1.5, 20.0, 300.25]), rng.random() < 0.2) for _ in range(900)]
    shape = "wallet string, ts timestamp, amount double, same boolean"
    for part in range(3):  # a part per run: the second and third go on with the state of the first
        spark.createDataFrame(data[part::3], shape).repartition(2).write.mode("append").parquet(f"{place}/in")
        out = drain(wallet_windows(file_stream(spark, f"{place}/in", files_per_trigger=1)), "windows", checkpoint=f"{place}/check")
    got = {r["wallet"]: r for r in last_per_wallet(out).collect()}
    for w in {r[0] for r in data}:
        mine = [(int((t - dt.datetime(1970, 1, 1)).total_seconds() // 60), a, s) for x, t, a, s in data if x == w]
        newest = max(m for m, _, _ in mine)
        assert got[w]["seen"] == len(mine) and got[w]["newest_minute"] == newest
        for name, width in WINDOWS.items():
            inside = [(a, s) for m, a, s in mine if m > newest - width]
            assert got[w][f"n_{name}"] == len(inside) and abs(got[w][f"volume_{name}"] - sum(a for a, _ in inside)) < 1e-6
            assert abs(got[w][f"self_{name}"] - sum(s for _, s in inside) / len(inside)) < 1e-12
