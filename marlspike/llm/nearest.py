"""Records paired with the record of the same entity that is nearest in time."""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PAIR_SQL = """
WITH r AS (SELECT e, t, min(v) AS v FROM right_side GROUP BY e, t),
back AS (
  SELECT l.k, l.t, r.t AS rt, r.v FROM left_side l ASOF LEFT JOIN r ON l.e = r.e AND l.t >= r.t
),
ahead AS (
  SELECT l.k, r.t AS rt, r.v FROM left_side l ASOF LEFT JOIN r ON l.e = r.e AND l.t <= r.t
)
SELECT k, CASE WHEN use_back THEN bv ELSE av END AS v, CASE WHEN use_back THEN bt ELSE ft END AS rt,
       CASE WHEN use_back THEN bd ELSE ad END AS gap
FROM (
  SELECT b.k, b.v AS bv, a.v AS av, b.rt AS bt, a.rt AS ft, b.t - b.rt AS bd, a.rt - b.t AS ad,
         b.rt IS NOT NULL AND (a.rt IS NULL OR b.t - b.rt <= a.rt - b.t) AS use_back
  FROM back b JOIN ahead a ON a.k = b.k
)
WHERE CASE WHEN use_back THEN bd ELSE ad END <= {tolerance}
"""


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    left_entity: str,
    left_micros: Column,
    right_value: str,
    right_entity: str,
    right_micros: Column,
    tolerance_s: int,
    groups: int,
    block_s: int = 21_600,
) -> DataFrame:
    """(left_key, right_value, gap_us): per left row the nearest right row of its entity.

    Earlier or later, at most ``tolerance_s`` seconds apart (inclusive); equally
    near: the earlier time, then the lowest value. Left rows without entity or
    time, or without a near partner, don't come out; every other left row comes
    out once, repeated ones too (``left_key`` is unique). Right rows without
    entity, time or value are no candidates. Empty sides give no rows.

    Rows are hash-partitioned by entity *and block of time* (``block_s``), so an
    entity with a third of all rows is cut into many pieces; a left row near a
    block's edge is also sent to the neighbouring block, which is enough as
    blocks are longer than the tolerance. ``groups`` is the number of hash
    partitions; choose it so that one holds some hundred thousand rows. In each
    of them DuckDB runs one backward and one forward ASOF join over Arrow data;
    the nearer one within the tolerance stays. The copies of an edge row are
    settled by a final min per left key.
    """
    tolerance, block = tolerance_s * 1_000_000, block_s * 1_000_000
    if block <= tolerance:
        raise ValueError("block_s must exceed tolerance_s")
    groups = max(1, groups)

    def placed(entity: str, at: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(entity), at), F.lit(groups)).cast("int")

    a = left.select(
        F.col(left_key).cast("long").alias("k"), F.col(left_entity).alias("e"), left_micros.alias("t")
    ).filter(F.col("k").isNotNull() & F.col("e").isNotNull() & F.col("t").isNotNull())
    here = F.floor(F.col("t") / F.lit(block)).cast("long")
    low, high = (F.floor((F.col("t") + F.lit(d)) / F.lit(block)).cast("long") for d in (-tolerance, tolerance))
    a = a.select("k", "e", "t", F.explode(F.array_distinct(F.array(low, here, high))).alias("b"))
    a = a.select(placed("e", F.col("b")).alias("p"), F.concat_ws("|", "e", "b").alias("e"), "t", "k")
    b = right.select(
        F.col(right_value).alias("v"), F.col(right_entity).alias("e"), right_micros.alias("t")
    ).filter(F.col("v").isNotNull() & F.col("e").isNotNull() & F.col("t").isNotNull())
    b = b.select(placed("e", here).alias("p"), F.concat_ws("|", "e", here).alias("e"), "t", "v")

    def pair(left_table: pa.Table, right_table: pa.Table) -> pa.Table:
        db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        try:
            db.register("left_side", left_table)
            db.register("right_side", right_table)
            found = db.sql(_PAIR_SQL.format(tolerance=tolerance)).to_arrow_table()
        finally:
            db.close()
        return found.cast(pa.schema([("k", pa.int64()), ("v", pa.string()), ("rt", pa.int64()), ("gap", pa.int64())]))

    joined = a.groupBy("p").cogroup(b.groupBy("p")).applyInArrow(pair, "k long, v string, rt long, gap long")
    return (
        joined.groupBy("k")
        .agg(F.min(F.struct("gap", "rt", "v")).alias("m"))
        .select(F.col("k").alias(left_key), F.col("m.v").alias(right_value), F.col("m.gap").alias("gap_us"))
    )
