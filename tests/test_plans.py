import random

from pyspark.sql import functions as F

from marlspike.plans.isolation import isolation_scores
from marlspike.queries.patterns import distinct_rings
from marlspike.queries.relational import not_in
from marlspike.sources.plugins import Filter, FolderBus, first_rejection
from marlspike.session import shared_dir
from tests.conftest import rows


def test_isolation_finds_outliers(spark):
    rng = random.Random(2)
    data = [(f"w{k}", rng.gauss(0, 1), rng.gauss(5, 2), None) for k in range(400)] + [("far", 40.0, -60.0, float("nan"))]
    df = spark.createDataFrame(data, "wallet string, a double, b double, c double")
    got = {r["wallet"]: r["outlier"] for r in isolation_scores(df, "wallet", ["a", "b", "c"]).collect()}
    assert len(got) == 401 and max(got, key=got.get) == "far" and got["far"] > 0.7
    assert isolation_scores(df.limit(0), "wallet", ["a"]).count() == 0


def test_rings_inside_others_go(spark):
    rings = {"r1": "abc", "r2": "abcd", "r3": "abcd", "r4": "xyz", "r5": "bcx"}
    df = spark.createDataFrame([(r, a) for r, m in rings.items() for a in m], "ring string, account string")
    assert sorted({r[0] for r in distinct_rings(df).collect()}) == ["r2", "r4", "r5"]


def test_not_in_with_nulls(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    right = lambda *v: spark.createDataFrame([(x,) for x in v], "c string")
    assert rows(not_in(left, "k", right("a"), "c")) == [("b",)]
    assert rows(not_in(left, "k", right("a", None), "c")) == []
    assert rows(not_in(left, "k", right(), "c")) == sorted([("a",), ("b",), (None,)], key=repr)


def test_filters_in_order_and_bus(spark):
    df = spark.createDataFrame([(1, None), (5, "x"), (9, "y")], "n int, s string")
    chain = [Filter("small", lambda r: F.col("n") < 3), Filter("named", lambda r: F.col("s") == "x"), Filter("any", lambda r: F.col("n") < 6)]
    assert rows(first_rejection(df, chain).select("n", "reason")) == [(1, "small"), (5, "named"), (9, None)]
    bus = FolderBus(spark, shared_dir(spark, "bus"))
    for k in range(2):
        bus.publish("t", df.select(F.col("n").cast("string").alias("key"), F.lit(str(k)).alias("value")))
    assert bus.consume("t").count() == 6
