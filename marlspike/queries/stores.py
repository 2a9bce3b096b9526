"""Queries on storage, scoring details and extensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike.functions import benford as b
from marlspike.functions.stats import clip, exact_sum, ratio
from marlspike.plans.isolation import isolation_scores
from marlspike.queries.features import feature_vector
from marlspike.queries.monitoring import _F, _feedback
from marlspike.queries.views import ACTIVITY_SQL, AS_OF, TRADES_SQL, WALLET_SQL, activity, trades, wallet_rows
from marlspike.sources.stores import (
    changed_partitions,
    chunk_table,
    insert_new,
    latest_by_key,
    newest,
    partition_states,
    split_bad,
    word_to_double,
)
from marlspike.sources.tables import table


def _ok_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "risk_scores").filter("wallet IS NOT NULL AND asset_pair IS NOT NULL AND score BETWEEN 0 AND 100 AND timestamp IS NOT NULL")


_OK = "s AS (SELECT * FROM risk_scores WHERE wallet IS NOT NULL AND asset_pair IS NOT NULL AND score BETWEEN 0 AND 100 AND timestamp IS NOT NULL)"
_CUT = "2026-03-15 00:00:00"


def idempotent_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the later half that the earlier half doesn't have, per source."""
    k = table(spark, d, "ingestion_dedup_keys").select("id", "source", "first_seen_at", F.lower(F.btrim("idempotency_key", F.lit(" \t\n\r"))).alias("k"))
    cut = F.lit(_CUT).cast("timestamp_ntz")
    new = insert_new(k.filter(F.col("first_seen_at") < cut), k.filter(F.col("first_seen_at") >= cut), "k", [F.col("first_seen_at"), F.col("id")])
    return new.groupBy("source").agg(F.count(F.lit(1)).alias("inserted"))


def keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Latest score per wallet and pair over an older and a newer table."""
    s = _ok_scores(spark, d).select("wallet", "asset_pair", "score", "timestamp", "id")
    cut = F.lit(_CUT).cast("timestamp_ntz")
    u = latest_by_key([s.filter(F.col("timestamp") < cut), s.filter(F.col("timestamp") >= cut)], ["wallet", "asset_pair"], ["timestamp", "id"])
    return u.select("wallet", "asset_pair", "score", "id")


def export_manifest_delta(spark: SparkSession, d: str) -> DataFrame:
    """Export partitions (day, pair) that changed since the table ended at a given delivery."""
    t = trades(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "pair_key", "token", "trade_id")
    half = t.agg(F.floor(F.max("trade_id") / 2).alias("h"))
    old = t.join(F.broadcast(half)).filter("trade_id <= h").drop("h")  # h is one row
    now, before = (partition_states(x, ["day", "pair_key"], "token") for x in (t, old))
    return changed_partitions(now, before, ["day", "pair_key"]).select("day", "pair_key", "rows", F.col("last").alias("last_token"))


def retention_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows each table would archive under its time to live (dry run)."""
    end = F.lit(AS_OF).cast("timestamp_ntz")
    out = None
    for name, ts, days in (("risk_scores", "timestamp", 60), ("label_feedback", "confirmed_at", 90), ("ingestion_dedup_keys", "first_seen_at", 30)):
        old = F.col(ts) < end - F.expr(f"INTERVAL {days} DAYS")
        x = table(spark, d, name).agg(F.count_if(old).alias("expired"), F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "expired", "rows")
        out = x if out is None else out.unionAll(x)
    return out


def row_cap(spark: SparkSession, d: str) -> DataFrame:
    """What a cap of 450 rows keeps of the scores: the newest, counted per flag."""
    kept = newest(_ok_scores(spark, d), [F.col("timestamp").desc(), F.col("id").desc()], 450)
    return kept.groupBy("ml_flag").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("least_id"))


def feature_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """Wide model scores as long rows without nulls: count and mean per feature."""
    f = _feedback(spark, d).select("id", F.col("rf").cast("double"), F.col("xg").cast("double"), F.col("lg").cast("double"), F.col("ens").cast("double"))
    long = f.unpivot("id", ["rf", "xg", "lg", "ens"], "feature", "value").filter("value IS NOT NULL AND NOT isnan(value)")
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("value"), 8).alias("mean"))


def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """Landed lines by error class; good ones under 'ok'."""
    v = F.try_parse_json("payload")
    no_id = F.get_json_object("payload", "$.id").isNull()
    error = F.when(v.isNull(), "json").when(no_id, "no_id").when(F.get_json_object("payload", "$.base_account").isNull() & F.get_json_object("payload", "$.base_account_id").isNull(), "no_account")
    good, bad = split_bad(table(spark, d, "horizon_trade_raw"), error)
    both = good.select(F.lit("ok").alias("error_class")).unionAll(bad.select("error_class"))
    return both.groupBy("error_class").agg(F.count(F.lit(1)).alias("lines"))


def load_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Six-hour chunks of a week with the scores that fall into each, empty ones too."""
    c = chunk_table(spark, "2026-03-01 00:00:00", "2026-03-08 03:00:00")
    s = _ok_scores(spark, d).select(F.window("timestamp", "6 hours")["start"].alias("chunk_start"))
    n = s.groupBy("chunk_start").agg(F.count(F.lit(1)).alias("n"))
    return c.join(n, "chunk_start", "left").select(F.date_format("chunk_start", "yyyy-MM-dd HH").alias("chunk"), F.coalesce("n", F.lit(0)).alias("rows"))


def offer_events(spark: SparkSession, d: str) -> DataFrame:
    """Events read as offers: cancelled without amount, created without offer id, else updated; side by type."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    kind = F.when(F.col("amount") < 1, "cancelled").when(F.coalesce(k, F.lit(0)) == 0, "created").otherwise("updated")
    side = F.when(F.col("pair") == "purchase", "buy").otherwise("sell")
    return activity(spark, d).groupBy(kind.alias("event"), side.alias("side")).agg(F.count(F.lit(1)).alias("events"))


def evm_words(spark: SparkSession, d: str) -> DataFrame:
    """Transaction words decoded as unsigned and signed 256-bit numbers."""
    h = table(spark, d, "bridge_transfers").select("id", F.col("tx_hash_evm").alias("w"))
    return h.select("id", word_to_double(F.col("w"), scale=1e60).alias("unsigned"), word_to_double(F.col("w"), True, 1e60).alias("signed"))


def canonical_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Reports with an equal canonical hash of their unchanging fields."""
    b_ = table(spark, d, "bridge_transfers")
    h = F.sha2(F.concat_ws("|", "chain", "direction", F.lower("evm_wallet"), "stellar_wallet", "token", F.lower("tx_hash_evm")), 256)
    return b_.groupBy(h.alias("event_hash")).agg(F.count(F.lit(1)).alias("reports"), F.countDistinct("transfer_id").alias("transfers")).filter("reports > 1")


def net_balances(spark: SparkSession, d: str) -> DataFrame:
    """Per wallet and asset what was got minus what was given; differences below 1e-7 dropped."""
    t = trades(spark, d)
    dec = lambda c: F.col(c).cast("decimal(38,8)")
    legs = F.array(
        F.struct(F.col("base").alias("w"), F.col("base_code").alias("a"), (-dec("amount")).alias("x")), F.struct(F.col("base").alias("w"), F.col("counter_code").alias("a"), dec("counter_amount").alias("x")),
        F.struct(F.col("counter").alias("w"), F.col("base_code").alias("a"), dec("amount").alias("x")), F.struct(F.col("counter").alias("w"), F.col("counter_code").alias("a"), (-dec("counter_amount")).alias("x")),
    )
    n = t.select(F.explode(legs).alias("l")).select("l.*").filter("w IS NOT NULL AND x IS NOT NULL").groupBy("w", "a").agg(F.sum("x").cast("double").alias("net"))
    return n.filter(F.abs("net") > 1e-7).select(F.col("w").alias("wallet"), F.col("a").alias("asset"), "net")


def analyst_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per analyst: labels in the last 30 days, share of label 0, mean days between labels."""
    f = _feedback(spark, d)
    recent = F.col("at") > F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 30 DAYS")
    days = F.timestamp_diff("MICROSECOND", F.min("at"), F.max("at")) / F.lit(86400e6)
    return f.groupBy("analyst").agg(
        F.count_if(recent).alias("recent"), F.round(F.avg((F.col("y") == 0).cast("double")), 9).alias("clean_share"),
        F.round(ratio(days, F.count(F.lit(1)) - 1), 7).alias("mean_gap_days"),
    )


def daily_feature_means(spark: SparkSession, d: str) -> DataFrame:
    """All numeric fields of the models' JSON, averaged per day."""
    f = table(spark, d, "label_feedback").filter("model_scores_json IS NOT NULL AND confirmed_at IS NOT NULL")
    m = f.select(F.date_format("confirmed_at", "yyyy-MM-dd").alias("day"), F.explode(F.from_json("model_scores_json", "map<string,double>")).alias("feature", "v"))
    return m.groupBy("day", "feature").agg(F.round(F.avg("v"), 8).alias("mean"))


def route_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sets of assets that multi-hop operations pass through, each once, with its first operation."""
    t = trades(spark, d).groupBy("op").agg(F.count(F.lit(1)).alias("hops"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("base_code", "counter_code"))))).alias("nodes"))
    many = t.filter("hops > 1")
    return many.groupBy(F.array_join("nodes", ",").alias("nodes")).agg(F.min("op").alias("first_op"), F.count(F.lit(1)).alias("operations"))


def ar_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Mean absolute standardised residual of an AR(2) fit to daily means per activity type, over 5, clipped."""
    daily = activity(spark, d).groupBy("pair", F.to_date("ts").alias("day")).agg(F.avg("amount").alias("x"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("day")["x"].to_numpy(float)
        score = 0.0
        if len(x) >= 6:
            a = np.column_stack([np.ones(len(x) - 2), x[1:-1], x[:-2]])
            e = x[2:] - a @ np.linalg.lstsq(a, x[2:], rcond=None)[0]
            score = float(np.clip(np.abs(e / (e.std() or 1)).mean() / 5, 0, 1))
        return pd.DataFrame({"pair": [pdf["pair"].iloc[0]], "score": [score]})

    return daily.groupBy("pair").applyInPandas(fit, "pair string, score double")


def coverage_check(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of the 90 % residual quantile of the earlier half on the later half of labels."""
    f = _feedback(spark, d).filter("ens IS NOT NULL").select(F.abs(F.col("y") - F.col("ens") / 100).alias("e"), (F.col("at") < F.lit(_CUT).cast("timestamp_ntz")).alias("early"))
    q = f.filter("early").agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY e)").alias("q"))
    # one row
    late = f.filter("NOT early").join(F.broadcast(q))
    return late.agg(F.count(F.lit(1)).alias("rows"), F.round(F.max("q"), 9).alias("quantile"), F.round(F.avg((F.col("e") <= F.col("q")).cast("double")), 9).alias("coverage"))


def temporal_adjustment(spark: SparkSession, d: str) -> DataFrame:
    """Newest score blended with the wallet's mean history (weight 0.3) if it goes back seven days."""
    s = _ok_scores(spark, d)
    h = s.groupBy("wallet").agg(
        F.max_by("score", F.struct("timestamp", "id")).alias("now"), F.avg("score").alias("mean"), F.timestamp_diff("SECOND", F.min("timestamp"), F.max("timestamp")).alias("span")
    )
    return h.select("wallet", F.round(F.when(F.col("span") >= 7 * 86400, 0.7 * F.col("now") + 0.3 * F.col("mean")).otherwise(F.col("now").cast("double")), 7).alias("adjusted"))


def robust_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Wallet volumes as robust z-scores of their logarithm (median and quartiles), clipped to 0..1."""
    v = wallet_rows(spark, d).groupBy("wallet").agg(F.log10(F.sum(F.col("amount").cast("decimal(38,8)")).cast("double")).alias("x"))
    q = v.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    z = F.abs(F.col("x") - F.col("q")[1]) / (F.col("q")[2] - F.col("q")[0] + 1e-9)
    return v.join(F.broadcast(q)).select("wallet", F.round(clip(z / 4, 0.0, 1.0), 7).alias("outlier"))  # q is one row


def isolation_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Wallets' vectors scored by isolation trees grown on a bounded sample."""
    v = feature_vector(spark, d)
    names = ["trades", "volume", "counterparties", "self_matching", "off_hours", "pool_share", "concentration", "mad", "regularity", "rotation", "round_trips"]
    return isolation_scores(v, "wallet", names).select("wallet", F.round("outlier", 9).alias("outlier"))


def top_contributions(spark: SparkSession, d: str) -> DataFrame:
    """Per label row the model that pulls furthest from its mean, as linear contribution."""
    f = _feedback(spark, d).filter("rf IS NOT NULL AND xg IS NOT NULL AND lg IS NOT NULL")
    m = f.agg(*[F.avg(c).alias(f"m_{c}") for c in ("rf", "xg", "lg")])
    x = f.join(F.broadcast(m))  # one row of means
    parts = F.array(*[F.struct(F.round(F.abs(F.col(c) - F.col(f"m_{c}")), 9).alias("size"), F.lit(c).alias("model")) for c in ("rf", "xg", "lg")])
    return x.select(F.array_max(parts).alias("t")).groupBy("t.model").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("t.size"), 7).alias("mean_size"))


def masked_audit(spark: SparkSession, d: str) -> DataFrame:
    """Keys of one source from a date on with digits of their metadata masked, counted per masked form."""
    k = table(spark, d, "ingestion_dedup_keys").filter("source = 'evm' AND first_seen_at >= TIMESTAMP_NTZ'2026-02-01 00:00:00'")
    return k.groupBy(F.regexp_replace(F.coalesce("metadata_json", F.lit("none")), "[0-9]", "#").alias("form")).agg(F.count(F.lit(1)).alias("keys"))


def json_like(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ingestion_dedup_keys").filter(F.col("metadata_json").like("%log_index%")).groupBy("source").agg(F.count(F.lit(1)).alias("keys"))


def error_classes_by_feed(spark: SparkSession, d: str) -> DataFrame:
    """Replayable share per feed: lines that parse."""
    v = F.try_parse_json("payload")
    return table(spark, d, "horizon_trade_raw").groupBy("feed").agg(F.round(F.avg(v.isNotNull().cast("double")), 9).alias("replayable"), F.countDistinct("file_seq").alias("files"))


# extensions beyond the surveyed operators ---------------------------------------------


def rollup_risk(spark: SparkSession, d: str) -> DataFrame:
    """Scores rolled up by flag pattern and in all."""
    r = _ok_scores(spark, d).rollup("benford_flag", "ml_flag").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("score"), 7).alias("mean_score"), F.grouping_id().alias("level"))
    return r.select("benford_flag", "ml_flag", F.col("level").cast("int").alias("level"), "rows", "mean_score")


def session_activity(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user's events with gaps under six hours: count and mean length."""
    s = activity(spark, d).groupBy("wallet", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("wallet").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def approx_wallets(spark: SparkSession, d: str) -> DataFrame:
    """Approximate distinct wallets per pair key (HyperLogLog) within its error bound of the exact number."""
    p = wallet_rows(spark, d).groupBy("pair_key").agg(F.approx_count_distinct("wallet", 0.02).alias("about"), F.countDistinct("wallet").alias("exact"))
    return p.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.abs(F.col("about") - F.col("exact")) > 0.1 * F.col("exact") + 1).alias("far_off"))


def revenue_by_region(spark: SparkSession, d: str) -> DataFrame:
    """Star join of the order tables: revenue per region and segment."""
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n, r = table(spark, d, "nation").select("n_nationkey", "n_regionkey"), table(spark, d, "region")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "c_mktsegment").agg(exact_sum("amount").alias("revenue"), F.count(F.lit(1)).alias("lines"))


QUERIES = {
    f.__name__: f
    for f in (
        idempotent_upsert, keyed_upsert, export_manifest_delta, retention_counts, row_cap, feature_unpivot, dead_letters, load_chunks,
        offer_events, evm_words, canonical_hashes, net_balances, analyst_stats, daily_feature_means, route_sets, ar_residuals,
        coverage_check, temporal_adjustment, robust_outliers, isolation_outliers, top_contributions, masked_audit, json_like,
        error_classes_by_feed, rollup_risk, session_activity, approx_wallets, revenue_by_region,
    )
}

_KB = r"E' \t\n\r'"


def _word(signed: bool) -> str:
    total = "CAST(('0x' || substr(w, 3, 8))::UBIGINT AS DOUBLE)"
    for i in range(1, 8):
        total = f"({total} * 4294967296.0::DOUBLE + CAST(('0x' || substr(w, {3 + 8 * i}, 8))::UBIGINT AS DOUBLE))"
    if signed:
        total = f"(CASE WHEN ('0x' || substr(w, 3, 8))::UBIGINT >= 2147483648 THEN {total} - pow(2.0::DOUBLE, 256) ELSE {total} END)"
    return f"{total} / 1e60::DOUBLE"


ORACLE = {
    "dead_letters": """SELECT CASE WHEN NOT json_valid(payload) THEN 'json' WHEN json_extract_string(payload, '$.id') IS NULL THEN 'no_id'
  WHEN json_extract_string(payload, '$.base_account') IS NULL AND json_extract_string(payload, '$.base_account_id') IS NULL THEN 'no_account' ELSE 'ok' END AS error_class, count(*) AS lines
FROM horizon_trade_raw GROUP BY 1""",
    "idempotent_upsert": f"""WITH k AS (SELECT *, lower(trim(idempotency_key, {_KB})) AS k FROM ingestion_dedup_keys),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY first_seen_at, id) AS rn FROM k WHERE first_seen_at >= TIMESTAMP '{_CUT}' AND k IS NOT NULL)
SELECT source, count(*) AS inserted FROM n WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM k o WHERE o.k = n.k AND o.first_seen_at < TIMESTAMP '{_CUT}') GROUP BY 1""",
    "keyed_upsert": f"WITH {_OK} SELECT wallet, asset_pair, score, id FROM (SELECT *, row_number() OVER (PARTITION BY wallet, asset_pair ORDER BY timestamp DESC, id DESC) AS rn FROM s) WHERE rn = 1",
    "export_manifest_delta": f"""WITH {TRADES_SQL}, x AS (SELECT strftime(ts, '%Y-%m-%d') AS day, pair_key, token, trade_id <= (SELECT max(trade_id) // 2 FROM trades) AS old FROM trades),
g AS (SELECT day, pair_key, count(*) AS rows, max(token) AS last_token, count(*) FILTER (old) AS r0, max(token) FILTER (old) AS t0 FROM x GROUP BY 1, 2)
SELECT day, pair_key, rows, last_token FROM g WHERE r0 <> rows OR t0 IS DISTINCT FROM last_token""",
    "retention_counts": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) FILTER ({t} < TIMESTAMP '{AS_OF}' - INTERVAL {k} DAY) AS expired, count(*) AS rows FROM {n}"
        for n, t, k in (("risk_scores", "timestamp", 60), ("label_feedback", "confirmed_at", 90), ("ingestion_dedup_keys", "first_seen_at", 30))
    ),
    "row_cap": f"WITH {_OK}, k AS (SELECT * FROM s ORDER BY timestamp DESC, id DESC LIMIT 450) SELECT ml_flag, count(*) AS rows, min(id) AS least_id FROM k GROUP BY 1",
    "feature_unpivot": f"WITH {_F} " + " UNION ALL ".join(f"SELECT '{m}' AS feature, count({m}) AS rows, round(avg({m}), 8) AS mean FROM fb" for m in ("rf", "xg", "lg", "ens")),
    "load_chunks": f"""WITH {_OK}, c AS (SELECT unnest(generate_series(TIMESTAMP '2026-03-01 00:00:00', TIMESTAMP '2026-03-08 00:00:00', INTERVAL 6 HOUR)) AS c)
SELECT strftime(c, '%Y-%m-%d %H') AS chunk, count(id) AS rows FROM c LEFT JOIN s ON timestamp >= c AND timestamp < c + INTERVAL 6 HOUR GROUP BY 1""",
    "offer_events": f"""WITH {ACTIVITY_SQL} SELECT CASE WHEN amount < 1 THEN 'cancelled' WHEN coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), 0) = 0 THEN 'created' ELSE 'updated' END AS event,
  CASE WHEN pair = 'purchase' THEN 'buy' ELSE 'sell' END AS side, count(*) AS events FROM activity GROUP BY 1, 2""",
    "evm_words": f"SELECT id, {_word(False)} AS unsigned, {_word(True)} AS signed FROM (SELECT id, lower(tx_hash_evm) AS w FROM bridge_transfers)",
    "canonical_hashes": """WITH h AS (SELECT sha256(concat_ws('|', chain, direction, lower(evm_wallet), stellar_wallet, token, lower(tx_hash_evm))) AS event_hash, transfer_id FROM bridge_transfers)
SELECT event_hash, count(*) AS reports, count(DISTINCT transfer_id) AS transfers FROM h GROUP BY 1 HAVING count(*) > 1""",
    "net_balances": f"""WITH {TRADES_SQL}, t AS (SELECT base, counter, base_code, counter_code, CAST(amount AS DECIMAL(38,8)) AS x, CAST(counter_amount AS DECIMAL(38,8)) AS y FROM trades),
l AS (SELECT base AS w, base_code AS a, -x AS v FROM t UNION ALL SELECT base, counter_code, y FROM t UNION ALL SELECT counter, base_code, x FROM t UNION ALL SELECT counter, counter_code, -y FROM t),
n AS (SELECT w, a, CAST(sum(v) AS DOUBLE) AS net FROM l WHERE w IS NOT NULL AND v IS NOT NULL GROUP BY ALL) SELECT w AS wallet, a AS asset, net FROM n WHERE abs(net) > 1e-7""",
    "analyst_stats": f"""WITH {_F} SELECT analyst, count(*) FILTER (tm > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS recent, round(avg((y = 0)::INT), 9) AS clean_share,
  round(coalesce((epoch_us(max(tm)) - epoch_us(min(tm))) / 86400e6 / nullif(count(*) - 1, 0), 0), 7) AS mean_gap_days FROM fb GROUP BY 1""",
    "daily_feature_means": """WITH m AS (SELECT strftime(confirmed_at, '%Y-%m-%d') AS day, unnest(json_keys(model_scores_json)) AS feature, model_scores_json AS j FROM label_feedback WHERE model_scores_json IS NOT NULL AND confirmed_at IS NOT NULL)
SELECT day, feature, round(avg(CAST(json_extract(j, '$.' || feature) AS DOUBLE)), 8) AS mean FROM m GROUP BY 1, 2""",
    "route_sets": f"""WITH {TRADES_SQL}, u AS (SELECT op, base_code AS c FROM trades UNION SELECT op, counter_code FROM trades), n AS (SELECT op, count(*) AS hops FROM trades GROUP BY 1),
s AS (SELECT op, string_agg(c, ',' ORDER BY c) AS nodes FROM u GROUP BY 1) SELECT nodes, min(s.op) AS first_op, count(*) AS operations FROM s JOIN n ON n.op = s.op WHERE hops > 1 GROUP BY 1""",
    "coverage_check": f"""WITH {_F}, e AS (SELECT abs(y - ens / 100) AS e, tm < TIMESTAMP '{_CUT}' AS early FROM fb WHERE ens IS NOT NULL), q AS (SELECT quantile_disc(e, 0.9) AS q FROM e WHERE early)
SELECT count(*) AS rows, round(max(q), 9) AS quantile, round(avg((e <= q)::INT), 9) AS coverage FROM e, q WHERE NOT early""",
    "temporal_adjustment": f"""WITH {_OK}, h AS (SELECT wallet, avg(score) AS m, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // 1000000 AS span FROM s GROUP BY 1),
l AS (SELECT wallet, score FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY timestamp DESC, id DESC) AS rn FROM s) WHERE rn = 1)
SELECT h.wallet, round(CASE WHEN span >= 604800 THEN 0.7::DOUBLE * score + 0.3::DOUBLE * m ELSE score END, 7) AS adjusted FROM h JOIN l ON l.wallet = h.wallet""",
    "robust_outliers": f"""WITH {WALLET_SQL}, v AS (SELECT wallet, log10(CAST(sum(CAST(amount AS DECIMAL(38,8))) AS DOUBLE)) AS x FROM wrows GROUP BY 1), q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.75) AS c FROM v)
SELECT wallet, round(least(greatest(abs(x - b) / (c - a + 1e-9) / 4, 0), 1), 7) AS outlier FROM v, q""",
    "top_contributions": f"""WITH {_F}, x AS (SELECT * FROM fb WHERE rf IS NOT NULL AND xg IS NOT NULL AND lg IS NOT NULL), m AS (SELECT avg(rf) AS a, avg(xg) AS b, avg(lg) AS c FROM x),
t AS (SELECT list_max([{{'size': round(abs(rf - a), 9), 'model': 'rf'}}, {{'size': round(abs(xg - b), 9), 'model': 'xg'}}, {{'size': round(abs(lg - c), 9), 'model': 'lg'}}]) AS t FROM x, m)
SELECT t.model AS model, count(*) AS rows, round(avg(t.size), 7) AS mean_size FROM t GROUP BY 1""",
    "masked_audit": """SELECT regexp_replace(coalesce(metadata_json, 'none'), '[0-9]', '#', 'g') AS form, count(*) AS keys FROM ingestion_dedup_keys WHERE source = 'evm' AND first_seen_at >= TIMESTAMP '2026-02-01 00:00:00' GROUP BY 1""",
    "json_like": "SELECT source, count(*) AS keys FROM ingestion_dedup_keys WHERE metadata_json LIKE '%log_index%' GROUP BY 1",
    "error_classes_by_feed": "SELECT feed, round(avg(json_valid(payload)::INT), 9) AS replayable, count(DISTINCT file_seq) AS files FROM horizon_trade_raw GROUP BY 1",
    "rollup_risk": f"WITH {_OK} SELECT benford_flag, ml_flag, CAST(grouping(benford_flag, ml_flag) AS INT) AS level, count(*) AS rows, round(avg(score), 7) AS mean_score FROM s GROUP BY ROLLUP (benford_flag, ml_flag)",
    "session_activity": f"""WITH {ACTIVITY_SQL}, g AS (SELECT wallet, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY wallet ORDER BY ts) + INTERVAL 6 HOUR, TRUE)::INT AS b FROM activity),
n AS (SELECT wallet, sum(b) OVER (PARTITION BY wallet ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), s AS (SELECT wallet, k, count(*) AS n FROM n GROUP BY ALL) SELECT wallet, count(*) AS sessions, max(n) AS longest FROM s GROUP BY 1""",
    "revenue_by_region": """SELECT r_name, c_mktsegment, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(38,8))) AS DOUBLE) AS revenue, count(*) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "approx_wallets": f"WITH {WALLET_SQL} SELECT count(DISTINCT pair_key) AS pairs, 0::BIGINT AS far_off FROM wrows",
}
