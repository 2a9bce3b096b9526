import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from marlspike.operators.rolling import rolling_totals
from marlspike.operators.skew import eager_join_totals, heavy_keys, key_states, salted_states
from tests.conftest import rows


def test_eager_totals_equal_the_join(spark):
    rng = random.Random(2)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "c", None])
    left = spark.createDataFrame([(key(), rng.choice([None, 1, 2, 3]), "l") for _ in range(300)], "k string, x int, n string")
    right = spark.createDataFrame([(key(), rng.choice([None, 10, 20]), "r") for _ in range(200)], "k string, y int, n string")
    got = eager_join_totals(left, right, ["k"], {"sx": F.col("x")}, {"sy": F.col("y")}).select("k", "pairs", "sx", "sy")
    want = left.drop("n").join(right.drop("n"), "k").groupBy("k").agg(F.count(F.lit(1)), F.sum("x"), F.sum("y"))
    assert rows(got) == rows(want)
    outer = eager_join_totals(left, right.filter("k = 'a'"), ["k"], {"sx": F.col("x")}, {"sy": F.col("y")}, how="left").select("k", "pairs", "sx", "sy")
    want = left.drop("n").join(right.drop("n").filter("k = 'a'"), "k", "left").groupBy("k").agg(F.count(F.lit(1)), F.sum("x"), F.sum("y"))
    assert rows(outer) == rows(want)
    up = eager_join_totals(left, right, ["k"], by=["x"], roll_up=["x"]).select("x", "pairs")
    assert rows(up) == rows(left.drop("n").join(right.drop("n"), "k").groupBy("x").agg(F.count(F.lit(1))))


def test_heavy_keys(spark):
    data = [("t", "a")] * 50 + [("t", "b")] * 3 + [("t", None)] * 45 + [("t", "c")] * 2 + [("u", "z")]
    df = spark.createDataFrame(data, "g string, key string")
    assert rows(heavy_keys(df, "g", "key", 0.03)) == [("t", "a", 50, 100), ("t", "b", 3, 100), ("u", "z", 1, 1)]
    assert heavy_keys(df.limit(0), "g", "key", 0.03).count() == 0


def test_states(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    assert rows(key_states(df, ["k"], {"s": F.col("v")})) == [("a", 2, 3), (None, 1, 3)]
    salted = salted_states(df, ["k"], [F.collect_set("v").alias("v")], [F.array_sort(F.flatten(F.collect_list("v"))).alias("v")])
    assert rows(salted) == [("a", [1, 2]), (None, [3])]


def test_rolling_against_brute_force(spark):
    rng = random.Random(3)
    start = dt.date(2026, 1, 1)
    data = [
        (rng.choice(["a", "b", None]), rng.choice([None, *[start + dt.timedelta(days=rng.randrange(60)) for _ in range(9)]]), rng.choice([None, Decimal("0.1"), Decimal("2.5")]), "v")
        for _ in range(120)
    ]
    df = spark.createDataFrame(data, "who string, day date, amount decimal(38,18), total string")
    got = rows(rolling_totals(df, "who", "day", "amount", (7, 30)).select("who", "day", "active", "total", "total_7", "active_7", "total_30", "active_30"))
    want = []
    for who in ("a", "b"):
        days = {}
        for w, day, amount, _ in data:
            if w == who and day and amount is not None:
                days[day] = days.get(day, Decimal(0)) + amount
        day = min(days)
        while day <= max(days):
            win = lambda n: [days[x] for x in days if day - dt.timedelta(days=n - 1) <= x <= day]  # noqa: B023, E731
            want.append((who, day, int(day in days), days.get(day, Decimal(0)), sum(win(7)), len(win(7)), sum(win(30)), len(win(30))))
            day += dt.timedelta(days=1)
    assert [(*r[:3], float(r[3]), float(r[4]), r[5], float(r[6]), r[7]) for r in got] == sorted(
        [(*r[:3], float(r[3]), float(r[4]), r[5], float(r[6]), r[7]) for r in want], key=repr
    )
    assert rolling_totals(df.limit(0), "who", "day", "amount").count() == 0
    few = rolling_totals(df, "who", "day", "amount", at_least_active=1000)
    assert few.count() == 0
