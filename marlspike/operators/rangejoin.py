"""Joins on closeness in time, planned as equi-joins on buckets of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.functions.cells import micros


def band_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    tolerance_s: float,
    strict: bool = False,
    how: str = "inner",
    also: Column | None = None,
) -> DataFrame:
    """Rows of equal ``keys`` whose times differ by at most ``tolerance_s`` (less, if ``strict``).

    Time is cut into buckets as long as the tolerance; the right side is sent to
    its own and both neighbouring buckets, and sides join on keys and bucket. A
    key with very many rows is so spread over its buckets, and no pair of far
    rows is ever formed. ``how``: inner, left, left_semi or left_anti. Columns
    other than keys must differ between sides; null keys or times match nothing.
    """
    size = max(1, int(tolerance_s * 1_000_000))
    a = left.withColumn("__lt", micros(left_time)).withColumn("__b", F.floor(F.col("__lt") / F.lit(size)))
    b = right.withColumn("__rt", micros(right_time)).withColumn("__c", F.floor(F.col("__rt") / F.lit(size)))
    b = b.withColumn("__b", F.explode(F.array(F.col("__c") - 1, F.col("__c"), F.col("__c") + 1))).drop("__c")
    apart = F.abs(F.col("__lt") - F.col("__rt"))
    near = apart < size if strict else apart <= size
    condition = near if also is None else near & also
    renamed = b.withColumnsRenamed({k: f"__r_{k}" for k in [*keys, "__b"]})
    on = condition
    for k in [*keys, "__b"]:
        on = on & (F.col(k) == F.col(f"__r_{k}"))
    joined = a.join(renamed, on, how)
    return joined.drop("__b", "__lt", "__rt", *[f"__r_{k}" for k in [*keys, "__b"]])
