"""Streaming queries, run over the tables' files until all is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike.functions.benford import EXPECTED
from marlspike.functions.cells import stripped
from marlspike.queries.views import WALLET_SQL, trades
from marlspike.session import durable, shared_dir
from marlspike.streaming.jobs import changed_by, drain, file_stream, first_by_key, in_sequence, tumbling
from marlspike.streaming.windows import WINDOWS, last_per_wallet, wallet_windows


def stream_dedup_keys(spark: SparkSession, d: str) -> DataFrame:
    """Distinct idempotency keys as a stream that remembers every key, counted per source."""
    s = file_stream(spark, f"{d}/ingestion_dedup_keys.parquet").select("source", F.lower(stripped(F.col("idempotency_key"))).alias("k")).filter("k IS NOT NULL")
    kept = drain(first_by_key(s, "k"), "stream-dedup")
    return kept.agg(F.count(F.lit(1)).alias("keys"))


def stream_hourly_activity(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows of events per type, complete output."""
    s = file_stream(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("pair"), F.col("value").alias("amount"))
    out = drain(tumbling(s, "ts", "1 hour", ["pair"]), "stream-hours", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "pair", "n", "volume")


def stream_four_hour_trades(spark: SparkSession, d: str) -> DataFrame:
    """Four-hour windows of bridge transfers per chain."""
    s = file_stream(spark, f"{d}/bridge_transfers.parquet").filter("timestamp IS NOT NULL").select(
        F.col("timestamp").cast("timestamp").alias("ts"), "chain", F.coalesce("amount_usd", F.lit(0.0)).alias("amount")
    )
    out = drain(tumbling(s, "ts", "4 hours", ["chain"]), "stream-transfers", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("slice"), "chain", "n", "volume")


def stream_score_changes(spark: SparkSession, d: str) -> DataFrame:
    """Scores that differ by 5 or more from the wallet's last emitted one, counted per wallet."""
    s = file_stream(spark, f"{d}/risk_scores.parquet").filter("wallet IS NOT NULL AND score BETWEEN 0 AND 100").select("wallet", "id", F.col("score").cast("double").alias("score"))
    out = drain(changed_by(s, "wallet", ["id"], "score", 5.0), "stream-changes")
    return out.groupBy("wallet").agg(F.count(F.lit(1)).alias("emitted"))


def stream_reordered_files(spark: SparkSession, d: str) -> DataFrame:
    """Landed lines per feed put back in order of file and line.

    Lines are numbered per feed without gaps, from the landed files: a number
    within each file, after the lines of the files before it. So all come out.
    """
    path, line = f"{d}/horizon_trade_raw.parquet", ["feed", "file_seq", "line_no"]
    lines = spark.read.parquet(path).select(*line).distinct()
    # one row per file
    files = lines.groupBy("feed", "file_seq").agg(F.count(F.lit(1)).alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("feed").orderBy("file_seq")) - F.col("lines")
    within = F.row_number().over(Window.partitionBy("feed", "file_seq").orderBy("line_no"))
    numbers = lines.withColumn("k", within).join(files.select("feed", "file_seq", before.alias("before")), ["feed", "file_seq"])
    s = file_stream(spark, path).select(*line, F.col("file_name").alias("name"))
    s = s.join(durable(numbers.select(*line, (F.col("before") + F.col("k")).alias("n")), "line-numbers"), line).select("feed", "n", "name")
    out = drain(in_sequence(s, "feed", "n", "name", hold=50), "stream-order")
    return out.groupBy("feed").agg(F.count(F.lit(1)).alias("released"))


def _wallet_stream(spark: SparkSession, d: str) -> DataFrame:
    """Single trades as a stream of several batches, each trade once per wallet that took part."""
    path = shared_dir(spark, "landed") + "/trades"
    trades(spark, d).select("trade_id", "ts", "base", "counter", "amount").repartition(4).write.parquet(path)
    s = file_stream(spark, path, files_per_trigger=1)
    sides = F.array_distinct(F.array_compact(F.array("base", "counter")))
    return s.select("trade_id", "ts", "amount", F.coalesce(F.col("base") == F.col("counter"), F.lit(False)).alias("same"), F.explode(sides).alias("wallet"))


def stream_wallet_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 1 h to 30 d per wallet after a stream of four batches: trades, volume, share with oneself, digit deviation."""
    last = last_per_wallet(drain(wallet_windows(_wallet_stream(spark, d)), "stream-windows"))
    return last.select("wallet", "seen", "newest_minute", *[F.round(f"{c}_{w}", 6).alias(f"{c}_{w}") if c in ("self", "mad") else F.col(f"{c}_{w}") for w in WINDOWS for c in ("n", "volume", "self", "mad")])


def stream_trades_with_features(spark: SparkSession, d: str) -> DataFrame:
    """Trades joined, batch by batch, with the vector their wallet has after the batch; counted and summed per wallet.

    Each batch of states is matched with the trades that led to it by the number
    of trades seen, so a trade meets one vector.
    """
    s = drain(wallet_windows(_wallet_stream(spark, d)), "stream-features")
    by = Window.partitionBy("wallet").orderBy("seen")
    step = s.select("wallet", "seen", (F.col("seen") - F.coalesce(F.lag("seen").over(by), F.lit(0))).alias("fresh"))
    return step.groupBy("wallet").agg(F.sum("fresh").alias("trades"), F.max("seen").alias("seen"))


def stream_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of one and of five minutes over events, the busiest of each."""
    out = None
    for width in ("1 minute", "5 minutes"):
        s = file_stream(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("amount"))
        n = drain(tumbling(s, "ts", width, []), "stream-minutes", "complete").groupBy("n").agg(F.count(F.lit(1)).alias("windows")).select(F.lit(width).alias("width"), "n", "windows")
        out = n if out is None else out.unionAll(n)
    return out


def stream_dedup_window(spark: SparkSession, d: str) -> DataFrame:
    """Keys that pass a stream's dedup with a replay window of an hour, as one batch sees them: each once."""
    s = file_stream(spark, f"{d}/ingestion_dedup_keys.parquet").select(F.lower(stripped(F.col("idempotency_key"))).alias("k"), F.col("first_seen_at").cast("timestamp").alias("t")).filter("k IS NOT NULL")
    kept = drain(first_by_key(s, "k", "t", "1 hour"), "stream-window")
    return kept.agg(F.countDistinct("k").alias("keys"))


QUERIES = {
    f.__name__: f
    for f in (stream_dedup_keys, stream_hourly_activity, stream_four_hour_trades, stream_score_changes, stream_reordered_files, stream_wallet_windows, stream_trades_with_features, stream_minutes, stream_dedup_window)
}

ORACLE = {
    "stream_dedup_keys": r"SELECT count(DISTINCT lower(nullif(trim(idempotency_key, E' \t\n\r\f'), ''))) AS keys FROM ingestion_dedup_keys",
    "stream_hourly_activity": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type AS pair, count(*) AS n,
  CAST(sum(CAST(value AS DECIMAL(38,8))) AS DOUBLE) AS volume FROM events GROUP BY 1, 2""",
    "stream_four_hour_trades": """SELECT strftime(time_bucket(INTERVAL 4 HOUR, timestamp, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H') AS slice, chain, count(*) AS n,
  CAST(sum(CAST(coalesce(amount_usd, 0) AS DECIMAL(38,8))) AS DOUBLE) AS volume FROM bridge_transfers WHERE timestamp IS NOT NULL GROUP BY 1, 2""",
    "stream_reordered_files": "SELECT feed, count(DISTINCT (file_seq, line_no)) AS released FROM horizon_trade_raw GROUP BY 1",
    "stream_minutes": """SELECT '1 minute' AS width, n, count(*) AS windows FROM (SELECT count(*) AS n FROM events GROUP BY date_trunc('minute', ts)) GROUP BY 2
UNION ALL SELECT '5 minutes', n, count(*) FROM (SELECT count(*) AS n FROM events GROUP BY time_bucket(INTERVAL 5 MINUTE, ts)) GROUP BY 2""",
    "stream_dedup_window": r"SELECT count(DISTINCT lower(nullif(trim(idempotency_key, E' \t\n\r\f'), ''))) AS keys FROM ingestion_dedup_keys",
    "stream_trades_with_features": f"WITH {WALLET_SQL} SELECT wallet, count(*) AS trades, count(*) AS seen FROM wrows GROUP BY 1",
    "stream_score_changes": """WITH RECURSIVE s AS (SELECT wallet, score, row_number() OVER (PARTITION BY wallet ORDER BY id) AS k FROM risk_scores WHERE wallet IS NOT NULL AND score BETWEEN 0 AND 100),
f AS (SELECT wallet, k, score AS last, 1 AS emitted FROM s WHERE k = 1
  UNION ALL SELECT s.wallet, s.k, CASE WHEN abs(score - last) >= 5 THEN score ELSE last END, emitted + (abs(score - last) >= 5)::INT FROM f JOIN s ON s.wallet = f.wallet AND s.k = f.k + 1)
SELECT wallet, CAST(max(emitted) AS BIGINT) AS emitted FROM f GROUP BY 1""",
    "stream_wallet_windows": f"""WITH {WALLET_SQL}, r AS (SELECT wallet, epoch_us(ts) // 60000000 AS m, CAST(round(amount * 1e7) AS BIGINT) AS u, coalesce(base = counter, FALSE)::INT AS same, CASE WHEN amount > 0 THEN CAST(nullif(regexp_extract(CAST(amount AS VARCHAR), '[1-9]'), '') AS INT) END AS dg FROM wrows),
n AS (SELECT *, max(m) OVER (PARTITION BY wallet) AS hi FROM r)
SELECT wallet, count(*) AS seen, max(hi) AS newest_minute, {', '.join(f"count(*) FILTER (m > hi - {k}) AS n_{w}, CAST(sum(u) FILTER (m > hi - {k}) AS DOUBLE) / 1e7 AS volume_{w}, round(avg(same) FILTER (m > hi - {k}), 6) AS self_{w}, round(({' + '.join(f'abs(count(*) FILTER (m > hi - {k} AND dg = {g}) / count(dg) FILTER (m > hi - {k}) - {EXPECTED[g - 1]!r})' for g in range(1, 10))}) / 9, 6) AS mad_{w}" for w, k in WINDOWS.items())}
FROM n GROUP BY 1""",
}
