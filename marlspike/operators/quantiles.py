"""Exact quantiles per key without bringing a key's values together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, n, one column per name in ``shares``): linearly interpolated quantiles of the non-null values.

    Values are counted per key and value, cut into slices by their leading digits
    (64 per power of two), ranked within slices, and the slices' totals are laid
    over them; a key has as many slices as its range needs, so a key with a third
    of all rows is spread. Of the ranked values each quantile keeps its two
    neighbours by a min aggregate. Negative and positive values, zeros and
    infinities are in order; NaN counts as the greatest.
    """
    v = F.col("v")
    slice_ = F.when(v == 0, 0).otherwise(F.signum(v) * (F.floor(F.log2(F.abs(v)) * 64) + 100_000)).cast("long")
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("s", F.coalesce(slice_, F.lit(1 << 60)))
    totals = counts.groupBy("k", "s").agg(F.sum("c").alias("t"))
    before = totals.select("k", "s", (F.sum("t").over(Window.partitionBy("k").orderBy("s")) - F.col("t")).alias("before"), F.sum("t").over(Window.partitionBy("k")).alias("n"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("k", "s").orderBy("v"))
    ranked = counts.join(before, ["k", "s"]).select("k", "v", "n", upto.alias("upto"))
    aggs = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("n") - 1)
        for end, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            aggs.append(F.min(F.when(F.col("upto") >= at + 1, v)).alias(f"{name}_{end}"))
    out = ranked.groupBy("k").agg(F.max("n").alias("n"), *aggs)
    each = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("n") - 1)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        each.append(F.when(lo == hi, lo).otherwise(lo + (place - F.floor(place)) * (hi - lo)).alias(name))
    return out.select(F.col("k").alias(key), "n", *each)
