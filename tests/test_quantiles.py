import random

import numpy as np

from marlspike.operators.quantiles import exact_quantiles


def test_against_numpy(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 6 + ["b", "c"]), rng.choice([None, 0.0, -3.5, 7.25, rng.gauss(0, 100), 10.0 ** rng.randrange(-8, 9), float(rng.randrange(5))]), 0) for _ in range(3000)] + [("one", 4.0, 0)]
    df = spark.createDataFrame(data, "key string, value double, n int")
    got = {r["key"]: (r["n"], r["q1"], r["half"], r["q3"]) for r in exact_quantiles(df, "key", "value", {"q1": 0.25, "half": 0.5, "q3": 0.75}).collect()}
    for k in {r[0] for r in data}:
        v = [x for key, x, _ in data if key == k and x is not None]
        assert got[k][0] == len(v) and np.allclose(got[k][1:], np.percentile(v, [25, 50, 75]), rtol=1e-12, atol=1e-12)
    assert exact_quantiles(df.limit(0), "key", "value", {"half": 0.5}).count() == 0
