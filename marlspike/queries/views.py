"""The domain's views over the given tables, in Spark and as SQL text for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.cells import amount, stripped
from marlspike.operators.dedup import first_copies
from marlspike.session import shared_dir
from marlspike.sources.tables import table

#: Analytic clock: results don't depend on when a query runs.
AS_OF = "2026-05-20 00:00:00"


#: Single trades already written: (application, folder, state of its files) -> (path, schema).
_WRITTEN: dict[tuple, tuple] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: another state is another table."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def trades(spark: SparkSession, d: str) -> DataFrame:
    """``single_trades``, written to the shared folder once per application and state of the table's files.

    Every trade query reads this table, pruned to its columns, instead of finding
    the single copies again. It lies there as Parquet for all executors and goes
    when the application ends.
    """
    key = (spark.sparkContext.applicationId, d, _state(spark, f"{d}/horizon_trade.parquet"))
    if key not in _WRITTEN:
        rows = single_trades(spark, d)
        path = f"{shared_dir(spark, 'trades')}/rows"
        rows.write.parquet(path)
        _WRITTEN[key] = (path, rows.schema)
    path, schema = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path)


def single_trades(spark: SparkSession, d: str) -> DataFrame:
    """Single, cleaned trades.

    trade_id, token, ts, base, counter, base_code, counter_code, pair, pair_key
    (unordered), amount, counter_amount, price, base_is_seller, kind
    (orderbook/liquidity_pool), pool. Rows without time, base account or a
    usable amount are left out.
    """
    kind = F.lower(stripped(F.col("trade_type")))
    base = F.coalesce("base_asset_code", F.lit("XLM"))
    counter = F.coalesce("counter_asset_code", F.lit("XLM"))
    raw = table(spark, d, "horizon_trade")
    winners = first_copies(
        raw, F.col("paging_token"), F.col("id"), [F.col("received_at"), F.col("delivery_id")], [F.col("delivery_id")]
    )
    # only numbers are compared and joined; what a query doesn't use is never read
    kept = raw.join(winners, "delivery_id", "left_semi").select(
        F.col("delivery_id").alias("trade_id"),
        F.col("id").alias("op"),
        stripped(F.col("paging_token")).alias("token"),
        F.col("ledger_close_time").alias("ts"),
        F.col("base_account").alias("base"),
        F.col("counter_account").alias("counter"),
        base.alias("base_code"),
        counter.alias("counter_code"),
        F.concat_ws("/", base, counter).alias("pair"),
        F.concat_ws("/", F.least(base, counter), F.greatest(base, counter)).alias("pair_key"),
        amount(F.col("base_amount")).cast("double").alias("amount"),
        amount(F.col("counter_amount")).cast("double").alias("counter_amount"),
        (F.col("price.n") / F.col("price.d")).alias("price"),
        F.col("base_is_seller"),
        F.when(kind.isin("liquidity_pool", "2"), "liquidity_pool").otherwise("orderbook").alias("kind"),
        F.col("liquidity_pool_id").alias("pool"),
    )
    return kept.filter(F.col("ts").isNotNull() & F.col("base").isNotNull() & (F.col("amount") > 0))


def wallet_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each trade once per wallet that took part: wallet, counterparty and the trade's columns."""
    wallets = F.array_distinct(F.filter(F.array("base", "counter"), lambda x: x.isNotNull()))
    out = trades(spark, d).withColumn("wallet", F.explode(wallets))
    return out.withColumn("cp", F.when(F.col("base") == F.col("wallet"), F.col("counter")).otherwise(F.col("base")))


def activity(spark: SparkSession, d: str) -> DataFrame:
    """``events`` as wallet activity: wallet, ts, pair (event type), amount."""
    return table(spark, d, "events").select(
        F.col("event_id"), F.col("user_id").alias("wallet"), F.col("ts"), F.col("event_type").alias("pair"),
        F.col("value").alias("amount"), F.col("props"),
    )


def transfers(spark: SparkSession, d: str) -> DataFrame:
    """Bridge transfers with time and wallet, once per transfer id (its last report)."""
    rows = table(spark, d, "bridge_transfers").filter(F.col("timestamp").isNotNull())
    last = F.max_by(
        F.struct(
            "id", "chain", "direction", F.lower("evm_wallet").alias("evm"), F.col("stellar_wallet").alias("wallet"),
            F.col("amount_usd").alias("usd"), F.col("timestamp").alias("ts"),
        ),
        "id",
    )
    return rows.groupBy("transfer_id").agg(last.alias("t")).select("transfer_id", "t.*")


def assignments(spark: SparkSession, d: str) -> DataFrame:
    """Labels read as cases: id, wallet, asset_pair, analyst, assigned_at, lock_expires_at, status, resolved_at.

    A label that is no 0 or 1 is a case still 'assigned', with a lock of 30 days;
    the others are 'resolved' as many minutes later as their ensemble score.
    """
    f = table(spark, d, "label_feedback")
    done = F.coalesce(F.col("true_label").isin(0, 1), F.lit(False))
    at = F.col("confirmed_at")
    return f.select(
        "id", "wallet", "asset_pair", F.lower(F.trim("analyst_id")).alias("analyst"), at.alias("assigned_at"),
        (at + F.expr("INTERVAL 30 DAYS")).alias("lock_expires_at"), F.when(done, "resolved").otherwise("assigned").alias("status"),
        F.when(done, F.timestamp_add("MINUTE", F.col("ensemble_score"), at)).alias("resolved_at"),
    )


_B = r"E' \t\n\r\f'"
_NUM = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _number(c: str) -> str:
    return f"CASE WHEN regexp_matches(trim({c}, {_B}), '{_NUM}') THEN CAST(TRY_CAST(trim({c}, {_B}) AS DECIMAL(38,18)) AS DOUBLE) END"


TRADES_SQL = f"""
tok AS (SELECT *, nullif(trim(paging_token, {_B}), '') AS tk, nullif(trim(id, {_B}), '') AS ident FROM horizon_trade),
grouped AS (
  SELECT *, CASE WHEN ident IS NULL AND tk IS NULL THEN 'row' || delivery_id
                 WHEN bool_or(tk IS NULL) OVER (PARTITION BY coalesce(ident, tk)) AND ident IS NOT NULL THEN 'id' || ident
                 ELSE 'tok' || tk END AS copy_key FROM tok),
ranked AS (SELECT *, row_number() OVER (PARTITION BY copy_key ORDER BY received_at, delivery_id) AS rn FROM grouped),
trades AS (
  SELECT * FROM (
    SELECT delivery_id AS trade_id, id AS op, tk AS token, ledger_close_time AS ts, base_account AS base,
      counter_account AS counter, coalesce(base_asset_code, 'XLM') AS base_code,
      coalesce(counter_asset_code, 'XLM') AS counter_code,
      coalesce(base_asset_code, 'XLM') || '/' || coalesce(counter_asset_code, 'XLM') AS pair,
      least(coalesce(base_asset_code, 'XLM'), coalesce(counter_asset_code, 'XLM')) || '/' ||
      greatest(coalesce(base_asset_code, 'XLM'), coalesce(counter_asset_code, 'XLM')) AS pair_key,
      {_number('base_amount')} AS amount, {_number('counter_amount')} AS counter_amount,
      price.n / price.d AS price, base_is_seller,
      CASE WHEN lower(trim(trade_type, {_B})) IN ('liquidity_pool', '2') THEN 'liquidity_pool' ELSE 'orderbook' END AS kind,
      liquidity_pool_id AS pool
    FROM ranked WHERE rn = 1)
  WHERE ts IS NOT NULL AND base IS NOT NULL AND amount > 0)"""

WALLET_SQL = f"""{TRADES_SQL},
wrows AS (
  SELECT *, base AS wallet, counter AS cp FROM trades
  UNION ALL
  SELECT *, counter AS wallet, base AS cp FROM trades WHERE counter IS NOT NULL AND counter <> base)"""

ACTIVITY_SQL = "activity AS (SELECT event_id, user_id AS wallet, ts, event_type AS pair, value AS amount, props FROM events)"

TRANSFERS_SQL = """
transfers AS (
  SELECT transfer_id, id, chain, direction, lower(evm_wallet) AS evm, stellar_wallet AS wallet, amount_usd AS usd, timestamp AS ts
  FROM (SELECT *, row_number() OVER (PARTITION BY transfer_id ORDER BY id DESC) AS rn FROM bridge_transfers WHERE timestamp IS NOT NULL)
  WHERE rn = 1)"""

CASES_SQL = """
cases AS (
  SELECT id, wallet, asset_pair, lower(trim(analyst_id)) AS analyst, confirmed_at AS assigned_at, confirmed_at + INTERVAL 30 DAY AS lock_expires_at,
    CASE WHEN coalesce(true_label IN (0, 1), FALSE) THEN 'resolved' ELSE 'assigned' END AS status,
    CASE WHEN coalesce(true_label IN (0, 1), FALSE) THEN confirmed_at + to_minutes(ensemble_score) END AS resolved_at
  FROM label_feedback)"""
