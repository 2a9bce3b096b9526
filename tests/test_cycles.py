import random
from itertools import permutations, product

from pyspark.sql import functions as F

from marlspike.operators.cycles import timed_cycles
from marlspike.operators.graph import strong_components
from marlspike.plans.scoring import ensemble
from marlspike.sources.synthetic import labelled_trades
from tests.conftest import rows


def test_cycles_against_brute_force(spark):
    rng = random.Random(3)
    pay = [(rng.randrange(5), rng.randrange(5), rng.randrange(100) * 1_000_000, float(rng.randrange(1, 9))) for _ in range(18)]
    df = spark.createDataFrame([*pay, (1, 2, None, 5.0), (7, 7, 1, 1.0)], "src int, dst int, t long, amount double")
    comp = strong_components(df)
    got = {(r["nodes"], r["length"]): r["span_s"] for r in timed_cycles(df, comp, 4, 40).filter("status = 'found'").collect()}
    want = {}
    for n in (3, 4):
        for p in permutations(range(5), n):
            if p[0] != min(p):
                continue
            hops = [[x[2] for x in pay if (x[0], x[1]) == (p[i], p[(i + 1) % n])] for i in range(n)]
            if all(hops):
                span = min(max(c) - min(c) for c in product(*hops))
                if span <= 40_000_000:
                    key = (tuple(sorted(p)), n)
                    if key not in want or p < want[key][0]:
                        want[key] = (p, span)
    assert got == {(">".join(map(str, p)), n): s / 1e6 for (_, n), (p, s) in want.items()}
    assert timed_cycles(df, comp, most_nodes=2).filter("status = 'skipped'").count() == comp.groupBy("component").count().filter("count >= 3").count()


def test_generator_and_ensemble(spark):
    a, b = labelled_trades(spark), labelled_trades(spark)
    assert rows(a) == rows(b) and a.filter("label = 1").count() == 270 and a.filter("label = 1 AND account = counter").count() > 0
    per = a.groupBy("account").agg(F.max("label").alias("label"), F.avg("amount").alias("amount")).withColumn("hint", F.col("label").cast("double"))
    p = ensemble(per, per, ["amount", "hint"])
    assert p.filter("(probability > 0.5) <> (label = 1)").count() == 0
    assert ensemble(per.filter("label = 0"), per, ["amount"]).filter("probability <> 0").count() == 0


def test_cycles_of_two_and_in_large_components(spark):
    day = 86_400_000_000
    ring = [(i, (i + 1) % 14, i * day, 1.0) for i in range(14)]
    # over an edge of two slices, one too wide, and one of two accounts
    pay = [*ring, (2, 5, 0, 4.0), (5, 9, day - 1, 3.0), (9, 2, day, 2.0), (4, 3, 3 * day + 5, 7.0), (20, 21, 5, 1.0), (21, 20, 3 * day, 1.0), (30, 31, 5, 6.0), (31, 30, 9, 5.0)]
    df = spark.createDataFrame(pay, "src int, dst int, t long, amount double")
    got = rows(timed_cycles(df, strong_components(df), most_nodes=None, shortest=2).select("nodes", "length", "span_s", "value", "status"))
    assert got == [("2>5>9", 3, 86400.0, 2.0, "found"), ("30>31", 2, 4e-6, 5.0, "found"), ("3>4", 2, 5e-6, 1.0, "found")]
