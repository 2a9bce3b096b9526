"""Seeded labelled trades: ordinary accounts, wash rings, evasive variants. Made in tasks, not on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def labelled_trades(
    spark: SparkSession,
    normal_accounts: int = 20,
    trades_each: int = 15,
    rings: int = 3,
    ring_size: int = 3,
    rounds: int = 30,
    jitter_s: int = 60,
    camouflage: bool = False,
    seed: int = 42,
) -> DataFrame:
    """(account, counter, ts, amount, label): label 1 for trades inside a ring.

    Ordinary amounts are log-normal (3, 1.5) at any hour; ring trades are round
    lots at night that go round the ring, each leg up to ``jitter_s`` seconds
    after the one before. ``camouflage`` replaces round lots by log-uniform
    amounts, whose leading digits follow the digit law. Every fifth round adds a
    trade with oneself. The same seed gives the same rows.
    """
    start = F.lit("2026-01-05 00:00:00").cast("timestamp_ntz")
    day = 86_400
    normal = spark.range(normal_accounts * trades_each, numPartitions=4).select(
        F.concat(F.lit("N"), (F.col("id") % normal_accounts)).alias("account"),
        F.concat(F.lit("N"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(normal_accounts)))).alias("counter"),
        F.timestamp_add("SECOND", (F.rand(seed) * 30 * day).cast("int"), start).alias("ts"),
        F.round(F.exp(3 + 1.5 * F.randn(seed + 1)), 7).alias("amount"),
        F.lit(0).alias("label"),
    )
    legs = spark.range(rings * rounds * ring_size, numPartitions=4).select(
        "id", (F.col("id") % ring_size).alias("leg"), F.floor(F.col("id") / ring_size).alias("turn")
    )
    ring = F.col("turn") % rings
    name = lambda k: F.concat(F.lit("W"), ring, F.lit("_"), k)
    lot = F.exp(F.rand(seed + 2) * 6) if camouflage else (1 + F.floor(F.rand(seed + 2) * 9)) * 100.0
    at = F.pmod(F.xxhash64("turn", F.lit(seed)), F.lit(30)) * day + F.pmod(F.xxhash64("turn", F.lit(seed + 3)), F.lit(5 * 3600)) + F.col("leg") * jitter_s
    wash = legs.select(
        name(F.col("leg")).alias("account"),
        F.when((F.col("turn") % 5 == 0) & (F.col("leg") == 0), name(F.col("leg"))).otherwise(name((F.col("leg") + 1) % ring_size)).alias("counter"),
        F.timestamp_add("SECOND", at.cast("int"), start).alias("ts"), F.round(lot, 7).alias("amount"), F.lit(1).alias("label"),
    )
    return normal.unionByName(wash)
