import math
import random

import numpy as np
from pyspark.sql import functions as F

from marlspike.functions import benford as b
from marlspike.functions.cells import amount, micros, stripped
from marlspike.functions.stats import chi2_sf, multinomial_pvalues, normal_quantile, safe_corr
from marlspike.operators.graph import bottleneck_cycle, components_of, directed_triangles, strong_components, timing_spread, tree_roots, wash_rings, weak_components
from marlspike.operators.rangejoin import band_join
from tests.conftest import rows


def test_cells(spark):
    cases = {" 1.5 ": 1.5, "+2": 2.0, "1e+2": 100.0, "3E-5": 3e-5, "NaN": None, "Infinity": None, "": None, "n/a": None, "1.2.3": None, None: None, ".5": 0.5, "1d": None, "\t7\n": 7.0, "9" * 30: None}
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", amount(F.col("x")).cast("double").alias("v"))
    assert {r["x"]: r["v"] for r in df.collect()} == cases
    df = spark.createDataFrame([(" a ",), ("　",), (None,)], "x string").select(stripped(F.col("x")).alias("v"))
    assert [r["v"] for r in df.collect()] == ["a", None, None]
    one = spark.sql("SELECT TIMESTAMP_NTZ'1970-01-02 00:00:00.000005' AS t").select(micros("t").alias("m")).first()["m"]
    assert one == 86_400_000_005


def test_digits_and_statistics(spark):
    values = [0.00123, 5e-6, 9.99, 100.0, 7.0, -1.0, 0.0, float("nan"), float("inf"), None, 2.5e10]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(b.leading_digit(F.col("x")).alias("d"))
    assert [r["d"] for r in df.collect()] == [1, 5, 9, 1, 7, None, None, None, None, None, 2]
    c = [30, 18, 12, 10, 8, 7, 6, 5, 4]
    n = sum(c)
    chi = sum((x - n * e) ** 2 / (n * e) for x, e in zip(c, b.EXPECTED))
    h = spark.createDataFrame([(*c, n), (*[0] * 9, 0)], ", ".join(f"c{k} long" for k in range(1, 10)) + ", n long")
    got = h.select(b.chi_square(b.counts(), F.col("n")).alias("x"), b.mean_deviation(b.counts(), F.col("n")).alias("m"), b.ks_statistic(b.counts(), F.col("n")).alias("k")).collect()
    assert math.isclose(got[0]["x"], chi) and got[1]["x"] == 0 and got[1]["k"] is None
    assert math.isclose(chi2_sf(15.507, 8), 0.05, abs_tol=1e-4) and math.isclose(chi2_sf(3.841, 1), 0.05, abs_tol=1e-3)
    p = spark.range(1).select(b.chi2_sf8(F.lit(15.507)).alias("p")).first()["p"]
    assert math.isclose(p, chi2_sf(15.507, 8), rel_tol=1e-9)
    assert math.isclose(normal_quantile(0.975), 1.959964, abs_tol=1e-5)
    low = multinomial_pvalues(np.array([[50, 0, 0, 0, 0, 0, 0, 0, 0], [0] * 9]), np.array(b.EXPECTED), 500, 1)
    assert low[0] < 0.01 and low[1] == 1
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double").agg(safe_corr(F.col("a"), F.col("b")).alias("r"))
    assert flat.first()["r"] is None


def test_band_join_against_cross_join(spark):
    rng = random.Random(8)
    base = "SELECT TIMESTAMP_NTZ'2026-01-01 00:00:00' AS t"
    side = lambda n, c: spark.createDataFrame([(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(5000)]), i) for i in range(n)], f"k string, s int, {c} int").join(
        spark.sql(base)).select("k", F.timestamp_add("SECOND", F.col("s"), F.col("t")).alias(f"t{c}"), c)
    left, right = side(60, "l"), side(60, "r")
    left, right = spark.createDataFrame(left.collect(), left.schema), spark.createDataFrame(right.collect(), right.schema)
    got = band_join(left, right, ["k"], "tl", "tr", 300).select("l", "r")
    want = left.join(right.withColumnRenamed("k", "k2"), (F.col("k") == F.col("k2")) & (F.abs(F.timestamp_diff("SECOND", F.col("tl"), F.col("tr"))) <= 300)).select("l", "r")
    assert rows(got) == rows(want)
    assert rows(band_join(left, right, ["k"], "tl", "tr", 300, how="left_semi").select("l")) == rows(want.select("l").distinct())
    assert band_join(left.limit(0), right, ["k"], "tl", "tr", 300).count() == 0


def reach_components(n, pairs):
    r = np.eye(n, dtype=bool)
    for a, c in pairs:
        r[a, c] = True
    for k in range(n):
        r |= np.outer(r[:, k], r[k])
    both = r & r.T
    return [int(np.flatnonzero(both[i])[0]) for i in range(n)]


def test_components_both_ways(spark):
    rng = random.Random(9)
    for density in (15, 35):
        pairs = [(rng.randrange(20), rng.randrange(20)) for _ in range(density)]
        want = reach_components(20, pairs)
        seen = {v for p in pairs for v in p}
        df = spark.createDataFrame([*pairs, *pairs, (None, 3), (4, None)], "src int, dst int")
        for limit in (1_000_000, 6, 0):
            got = {r["v"]: r["component"] for r in strong_components(df, one_task_edges=limit).collect()}
            assert got == {v: want[v] for v in seen}
        joined = list(range(20))
        for _ in range(20):
            for a, c in pairs:
                joined[a] = joined[c] = min(joined[a], joined[c])
        assert {r["v"]: r["component"] for r in weak_components(df).collect()} == {v: joined[v] for v in seen}
    assert strong_components(spark.createDataFrame([], "src int, dst int")).count() == 0
    assert list(components_of(np.array([0, 1, 2]), np.array([1, 0, 2]), 3)) in ([0, 0, 1], [1, 1, 0])


def brute_cycle(w, least):
    from itertools import permutations

    best, n = 0.0, len(w)
    for k in range(least, n + 1):
        for p in permutations(range(n), k):
            if p[0] == min(p):
                best = max(best, min(w[p[i], p[(i + 1) % k]] for i in range(k)))
    return best


def test_bottleneck_cycle_and_rings(spark):
    rng = np.random.default_rng(1)
    for _ in range(8):
        w = rng.integers(0, 9, (6, 6)) * (rng.random((6, 6)) < 0.5)
        assert bottleneck_cycle(w.astype(float), 3) == brute_cycle(w.astype(float), 3)
    e = spark.createDataFrame([("a", "b", 5.0, 1), ("b", "c", 3.0, 2), ("c", "a", 9.0, 3), ("x", "y", 1.0, 1), ("y", "x", 1.0, 1)], "src string, dst string, volume double, cnt long")
    assert rows(wash_rings(e, strong_components(e))) == [("a", 3, 17.0, 2.0, 3.0, False)]
    assert rows(wash_rings(e, strong_components(e), most=2)) == [("a", 3, 17.0, 2.0, 8.5, True)]


def test_triangles_roots_timing(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(60)]
    e = {p for p in pairs if p[0] != p[1]}
    want = {}
    for a, c in e:
        for c2, d in e:
            if c2 == c and d != a and (d, a) in e:
                want[a] = want.get(a, 0) + 1
    got = {r["v"]: r["cycles"] for r in directed_triangles(spark.createDataFrame(pairs, "src int, dst int")).collect()}
    assert got == want
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("s", "s")], "c string, p string")
    assert rows(tree_roots(links, "c", "p")) == [("a", "c", 2), ("b", "c", 1), ("x", None, None), ("y", None, None)]
    times = spark.sql("SELECT 1 AS g, TIMESTAMP_NTZ'2026-01-01 23:59:50' AS t UNION ALL SELECT 1, TIMESTAMP_NTZ'2026-01-02 00:00:00' UNION ALL SELECT 1, TIMESTAMP_NTZ'2026-01-02 00:00:30'")
    assert rows(timing_spread(times, "g", "t")) == [(1, 2, 20.0, 10.0)]


def test_neighbours_equal_whole_windows(spark):
    from pyspark.sql import Window

    from marlspike.operators.neighbours import with_neighbours

    rng = random.Random(11)
    data = [(rng.choice(["hot"] * 6 + ["b"]), rng.randrange(40), i, "clash") for i in range(200)]
    df = spark.createDataFrame(data, "k string, t int, i int, o string")
    whole = Window.partitionBy("k").orderBy("t", "i")
    cut = with_neighbours(df, ["k"], ["t", "i"], F.floor(F.col("t") / 3), 3, 2)
    part = Window.partitionBy("k", "__chunk").orderBy("t", "i")
    look = lambda w: [F.lag("i", n).over(w).alias(f"b{n}") for n in (1, 3)] + [F.lead("i", n).over(w).alias(f"a{n}") for n in (1, 2)]
    want = df.select("k", "i", *look(whole))
    assert rows(cut.select("k", "i", "__own", *look(part)).filter("__own").drop("__own")) == rows(want)
    assert with_neighbours(df.limit(0), ["k"], ["t", "i"], F.col("t"), 1, 1).count() == 0
