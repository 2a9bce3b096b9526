"""Queries of the training-data problems of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.cells import micros
from marlspike.llm.consensus import counted_labels, fit_consensus
from marlspike.llm.mixing import mix
from marlspike.llm.nearest import nearest_in_time
from marlspike.llm.packing import pack
from marlspike.llm.tokens import with_tokens
from marlspike.llm.top_items import top_per_group
from marlspike.llm.truncation import truncated_texts, truncation_rates
from marlspike.session import durable
from marlspike.sources.tables import table

LEAST_RELIABLE = 0.6
TOLERANCE_S = 300
#: Rows that one Arrow group of the nearest-time match should hold about.
ROWS_PER_GROUP = 150_000


def _consensus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    feedback = table(spark, d, "label_feedback")
    labels = counted_labels(feedback, "wallet", "analyst_id", "true_label", "confirmed_at", "id")
    models = F.from_json("model_scores_json", "random_forest double, xgboost double, lightgbm double")
    features = feedback.filter(F.col("wallet").isNotNull()).select(
        F.col("wallet").alias("item"),
        models["random_forest"].alias("random_forest"),
        models["xgboost"].alias("xgboost"),
        models["lightgbm"].alias("lightgbm"),
        (F.col("ensemble_score") / 100).alias("ensemble"),
    )
    return fit_consensus(labels, features)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Wallets whose consensus is 1, and analysts who agree with it on fewer than 60 % of their wallets."""
    items, annotators = _consensus(spark, d)
    return items.filter("consensus = 1").select(F.lit("wallet").alias("case_kind"), F.col("item").alias("case_key")).unionAll(
        annotators.filter(F.col("reliability") < LEAST_RELIABLE).select(
            F.lit("analyst").alias("case_kind"), F.col("annotator").alias("case_key")
        )
    )


def p1_items(spark: SparkSession, d: str) -> DataFrame:
    """Per wallet: consensus, probability, votes and agreement."""
    return _consensus(spark, d)[0].withColumnRenamed("item", "wallet")


def p1_annotators(spark: SparkSession, d: str) -> DataFrame:
    """Per analyst: reliability and fitted confusion rates."""
    return _consensus(spark, d)[1].withColumnRenamed("annotator", "analyst_id")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "risk_scores").filter(F.col("score").between(0, 100))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The first five wallets of each pair."""
    return top_per_group(_scores(spark, d), "asset_pair", "wallet", "score", 5).select("asset_pair", "place", "wallet")


def p2_top(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty wallets of each pair with their scores."""
    return top_per_group(_scores(spark, d), "asset_pair", "wallet", "score", 20)


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    transfers = table(spark, d, "bridge_transfers").withColumnRenamed("id", "transfer_row")
    trades = table(spark, d, "horizon_trade").withColumnRenamed("id", "trade_id")
    rows = transfers.count() + trades.count()  # from the files' footers
    return nearest_in_time(
        transfers, trades, "transfer_row", "source_address", micros("timestamp"), "trade_id", "base_account",
        micros("ledger_close_time"), TOLERANCE_S, groups=max(12, rows // ROWS_PER_GROUP),
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Per transfer the trade of the same account nearest in time, within 300 seconds."""
    return _nearest(spark, d).select("transfer_row", "trade_id")


def p6_gaps(spark: SparkSession, d: str) -> DataFrame:
    """How far apart the matched records are, per minute of gap."""
    gap = F.floor(F.col("gap_us") / 60_000_000).cast("int")
    return _nearest(spark, d).groupBy(gap.alias("minutes")).agg(F.count(F.lit(1)).alias("transfers"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    # counted once, read by every profile or mix
    return durable(with_tokens(table(spark, d, "documents"), "text", ["doc_id", "source"]), "sizes")


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(documents in containers, plans), both per profile."""
    sized = _sized(spark, d)
    out, plans = None, []
    # profiles are configuration, a handful of rows
    for profile in table(spark, d, "pack_profiles").orderBy("profile").collect():
        packed, plan = pack(sized, "doc_id", "tokens", profile["capacity_tokens"])
        packed = packed.select(F.lit(profile["profile"]).alias("profile"), "doc_id", "part", "tokens", "container")
        out = packed if out is None else out.unionAll(packed)
        plans.append((profile["profile"], plan.bound, plan.by_lp / max(1, plan.items)))
    return out, spark.createDataFrame(plans, "profile string, least_containers long, by_lp_patterns double")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every document in containers of each profile's capacity."""
    return _packed(spark, d)[0]


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per profile: containers, the LP's lower bound of them, tokens, share of the space used, share of parts that lie in LP patterns."""
    rows, plans = _packed(spark, d)
    packed = rows.groupBy("profile").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    profiles = table(spark, d, "pack_profiles")
    return packed.join(profiles, "profile").join(plans, "profile").select(
        "profile", "capacity_tokens", "containers", "least_containers", "tokens",
        (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"), "by_lp_patterns",
    )


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix and how often each is repeated."""
    return mix(_sized(spark, d), table(spark, d, "mix_targets"), "doc_id", "source", "tokens")[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Per mix and source: target and actual share."""
    return mix(_sized(spark, d), table(spark, d, "mix_targets"), "doc_id", "source", "tokens")[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text was cut off."""
    found, _ = truncated_texts(table(spark, d, "documents"), "doc_id", "source", "text")
    return found.select(F.col("id").alias("doc_id"))


def p10_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cut documents with the spike they lie at, or 'transfer' where they lie at none."""
    found, _ = truncated_texts(table(spark, d, "documents"), "doc_id", "source", "text")
    return found.select(F.col("id").alias("doc_id"), "source", "reason", "limit_length", "limit_unit")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut documents per source."""
    docs = table(spark, d, "documents")
    return truncation_rates(docs, truncated_texts(docs, "doc_id", "source", "text")[0], "source")


def p10_limits(spark: SparkSession, d: str) -> DataFrame:
    """Lengths at which a source's texts are cut."""
    return truncated_texts(table(spark, d, "documents"), "doc_id", "source", "text")[1]


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_items, p1_annotators, p2_found, p2_top, p6_found, p6_gaps, p8_pack, p8_fill, p9_mix, p9_report,
        p10_found, p10_cases, p10_rates, p10_limits,
    )
}

_TOP = """
SELECT asset_pair, CAST(place AS INT) AS place, wallet{score} FROM (
  SELECT asset_pair, wallet, s, row_number() OVER (PARTITION BY asset_pair ORDER BY s DESC, wallet) AS place
  FROM (SELECT asset_pair, wallet, max(score) AS s FROM risk_scores
        WHERE asset_pair IS NOT NULL AND wallet IS NOT NULL AND score BETWEEN 0 AND 100 GROUP BY 1, 2))
WHERE place <= {n}"""

_NEAREST = """
SELECT transfer_row, trade_id, gap FROM (
  SELECT b.id AS transfer_row, h.id AS trade_id,
         abs(epoch_us(b.timestamp) - epoch_us(h.ledger_close_time)) AS gap,
         row_number() OVER (PARTITION BY b.id ORDER BY abs(epoch_us(b.timestamp) - epoch_us(h.ledger_close_time)),
                            h.ledger_close_time, h.id) AS rn
  FROM bridge_transfers b JOIN horizon_trade h ON b.source_address = h.base_account
   AND h.ledger_close_time BETWEEN b.timestamp - INTERVAL 300 SECOND AND b.timestamp + INTERVAL 300 SECOND
  WHERE h.id IS NOT NULL)
WHERE rn = 1"""

ORACLE = {
    "p2_found": _TOP.format(score="", n=5),
    "p2_top": _TOP.format(score=", s AS score", n=20),
    "p6_found": f"SELECT transfer_row, trade_id FROM ({_NEAREST})",
    "p6_gaps": f"SELECT CAST(gap // 60000000 AS INT) AS minutes, count(*) AS transfers FROM ({_NEAREST}) GROUP BY 1",
}
