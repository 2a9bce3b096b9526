"""End-to-end plans: rings and timed cycles per pair, ensemble scores of wallets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.cells import micros
from marlspike.operators.cycles import timed_cycles
from marlspike.operators.graph import strong_components, trade_edges, wash_rings
from marlspike.plans.scoring import blend, ensemble
from marlspike.queries.features import feature_vector
from marlspike.queries.graphs import _scc_sql
from marlspike.queries.views import TRADES_SQL, trades
from marlspike.session import durable
from marlspike.sources.synthetic import labelled_trades
from marlspike.sources.tables import table


def _pair_trades(spark: SparkSession, d: str) -> DataFrame:
    """Trades with accounts kept apart by pair: a ring trades one pair."""
    t = trades(spark, d).filter("counter IS NOT NULL")
    return t.select(F.concat_ws("|", "pair_key", "base").alias("base"), F.concat_ws("|", "pair_key", "counter").alias("counter"), "amount", "ts")


def pair_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of at least three accounts within one pair: size and pair."""
    c = strong_components(trade_edges(_pair_trades(spark, d)))
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size >= 3")


def pair_wash_rings(spark: SparkSession, d: str) -> DataFrame:
    """Wash rings within one pair with their best bottleneck volume."""
    e = durable(trade_edges(_pair_trades(spark, d)), "pair-edges")
    return wash_rings(e, strong_components(e))


def path_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Cycles of 2 to 6 payments within one pair that close in 24 hours, in components of any size."""
    t = durable(_pair_trades(spark, d), "pair-trades")
    pay = t.select(F.col("base").alias("src"), F.col("counter").alias("dst"), micros("ts").alias("t"), "amount")
    return timed_cycles(pay, strong_components(trade_edges(t)), most_nodes=None, shortest=2)


def ensemble_scores(spark: SparkSession, d: str) -> DataFrame:
    """Wallet features to an ensemble's probability (labels: majority of analysts) and the blended score."""
    v = durable(feature_vector(spark, d), "vectors")
    votes = table(spark, d, "label_feedback").filter(F.col("true_label").isin(0, 1)).groupBy("wallet").agg((F.avg("true_label") > 0.5).cast("int").alias("label"))
    names = ["volume", "self_matching", "off_hours", "pool_share", "mad", "concentration", "round_trips", "rotation"]
    p = ensemble(v.join(votes, "wallet"), v, names)
    return p.select("wallet", F.round("probability", 9).alias("probability"), F.round("confidence", 9).alias("confidence"), blend(F.col("mad"), F.col("probability")).alias("score"))


def synthetic_check(spark: SparkSession, d: str) -> DataFrame:
    """Generated rings against ordinary accounts: trades, self-trades and night share per label."""
    g = labelled_trades(spark)
    return g.groupBy("label").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("account") == F.col("counter")).alias("self_trades"),
        F.round(F.avg(F.hour("ts").between(0, 5).cast("double")), 6).alias("off_hours"),
    )


QUERIES = {f.__name__: f for f in (pair_components, pair_wash_rings, path_cycles, ensemble_scores, synthetic_check)}

ORACLE = {
    "pair_components": f"""WITH RECURSIVE {TRADES_SQL}, e AS (SELECT DISTINCT pair_key || '|' || base AS src, pair_key || '|' || counter AS dst FROM trades WHERE counter IS NOT NULL),
{_scc_sql('e')} SELECT component, count(*) AS size FROM comp GROUP BY 1 HAVING count(*) >= 3""",
}
