"""Case states, replays, reports and model upkeep: small tables that are recomputed rather than updated in place."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike.functions import benford as b
from marlspike.functions.stats import clip, exact_sum, ratio
from marlspike.queries.benford import _CHI, _DG, _sql_counts
from marlspike.queries.monitoring import _F, _feedback
from marlspike.queries.views import AS_OF, CASES_SQL, TRADES_SQL, TRANSFERS_SQL, WALLET_SQL, assignments, trades, transfers, wallet_rows
from marlspike.session import shared_dir
from marlspike.sources.plugins import FolderBus
from marlspike.sources.stores import archive, export_partitions, labelled_csv, read_tier
from marlspike.sources.tables import table

def _now() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


_S = "s AS (SELECT * FROM risk_scores WHERE wallet IS NOT NULL AND asset_pair IS NOT NULL AND score BETWEEN 0 AND 100 AND timestamp IS NOT NULL)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "risk_scores").filter("wallet IS NOT NULL AND asset_pair IS NOT NULL AND score BETWEEN 0 AND 100 AND timestamp IS NOT NULL")


def optional(rows: DataFrame, equal: dict | None = None, at_least: dict | None = None, below: dict | None = None) -> DataFrame:
    """Filters for the arguments that were given; a value of None adds no condition."""
    for given, build in ((equal, lambda c, v: c == v), (at_least, lambda c, v: c >= v), (below, lambda c, v: c < v)):
        for name, value in (given or {}).items():
            if value is not None:
                rows = rows.filter(build(F.col(name), value))
    return rows


# case states ---------------------------------------------------------------------------


def expired_locks(spark: SparkSession, d: str) -> DataFrame:
    """The case table after expired locks were released: rows and releases per status."""
    c = assignments(spark, d)
    stale = (F.col("status") == "assigned") & (F.col("lock_expires_at") <= _now())
    after = c.select("*", F.coalesce(stale, F.lit(False)).alias("hit")).withColumn("status", F.when(F.col("hit"), "released").otherwise(F.col("status")))
    return after.groupBy("status").agg(F.count(F.lit(1)).alias("cases"), F.count_if("hit").alias("changed"))


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of each analyst claiming the wallets and pairs of their open cases now: renewed, taken over or refused.

    A claim renews the analyst's own live lock, is refused while another's is
    alive, and takes over otherwise. Of several claims for a case the first by
    (assigned_at, id) is heard first.
    """
    c = assignments(spark, d).filter("status = 'assigned' AND asset_pair IS NOT NULL")
    live = c.filter(F.col("lock_expires_at") > _now()).groupBy("wallet", "asset_pair").agg(F.min_by("analyst", F.struct("assigned_at", "id")).alias("holder"))
    first = c.groupBy("wallet", "asset_pair").agg(F.min(F.struct("assigned_at", "id")).alias("first"))
    x = c.join(live, ["wallet", "asset_pair"], "left").join(first, ["wallet", "asset_pair"])
    outcome = F.when(F.col("holder") == F.col("analyst"), "renewed").when(F.col("holder").isNotNull(), "refused").when(F.struct("assigned_at", "id") == F.col("first"), "taken").otherwise("refused")
    return x.select("id", "wallet", "asset_pair", "analyst", outcome.alias("outcome"))


def case_stats(spark: SparkSession, d: str) -> DataFrame:
    """One row: mean seconds to resolution, cases held, latest scores without label or holder, locks that ran out."""
    c = assignments(spark, d)
    held = c.filter((F.col("status") == "assigned") & (F.col("lock_expires_at") > _now()))
    taken = F.timestamp_diff("MICROSECOND", F.col("assigned_at"), F.col("resolved_at")) / F.lit(1e6)
    one = c.agg(
        F.round(F.avg(taken), 1).alias("mean_resolution_s"), F.count_if((F.col("status") == "assigned") & (F.col("lock_expires_at") > _now())).alias("assigned"),
        F.count_if((F.col("status") == "assigned") & (F.col("lock_expires_at") <= _now())).alias("expired"),
    )
    recent = table(spark, d, "label_feedback").filter(F.col("confirmed_at") >= _now() - F.expr("INTERVAL 7 DAYS"))
    last = _scores(spark, d).select("wallet", "asset_pair").distinct()
    free = last.join(recent, ["wallet", "asset_pair"], "left_anti").join(held, ["wallet", "asset_pair"], "left_anti").agg(F.count(F.lit(1)).alias("unassigned"))
    return one.join(F.broadcast(free))  # both are one row


def analyst_month(spark: SparkSession, d: str) -> DataFrame:
    """One row over all analysts: labels of the clock's last day, share of label 0 and mean seconds to resolution of the last 30 days."""
    f = table(spark, d, "label_feedback").select("true_label", "confirmed_at", "ensemble_score")
    month = F.col("confirmed_at") >= _now() - F.expr("INTERVAL 30 DAYS")
    valid = F.coalesce(F.col("true_label").isin(0, 1), F.lit(False))
    return f.agg(
        F.count_if(F.col("confirmed_at") >= _now() - F.expr("INTERVAL 1 DAY")).alias("today"),
        F.round(ratio(F.count_if(month & valid & (F.col("true_label") == 0)), F.count_if(month & valid)), 4).alias("clean_rate"),
        F.round(F.avg(F.when(month & valid, F.col("ensemble_score") * 60.0)), 1).alias("mean_review_s"),
    )


#: Deliveries: first delay, longest delay (seconds), attempts after which one is dead.
BASE_DELAY, MAX_DELAY, MAX_ATTEMPTS = 30, 3600, 8


def delivery_retries(spark: SparkSession, d: str) -> DataFrame:
    """Keys read as deliveries that failed as often as they were seen: next delay, or dead."""
    k = table(spark, d, "ingestion_dedup_keys").select(F.lower(F.btrim("idempotency_key", F.lit(" \t\n\r"))).alias("delivery")).filter("delivery <> ''")
    n = k.groupBy("delivery").agg(F.count(F.lit(1)).alias("attempts"))
    dead = F.col("attempts") >= MAX_ATTEMPTS
    delay = F.when(~dead, F.least(F.pow(F.lit(2.0), F.col("attempts")) * BASE_DELAY, F.lit(float(MAX_DELAY))))
    return n.groupBy("attempts", F.when(dead, "dead").otherwise("pending").alias("status"), delay.alias("delay_s")).agg(F.count(F.lit(1)).alias("deliveries"))


def cached_explanation(spark: SparkSession, d: str) -> DataFrame:
    """Scores with an explanation written to the newest row of each wallet and pair only; older rows keep null."""
    s = _scores(spark, d).select("id", "wallet", "asset_pair", "score", "timestamp")
    newest = s.groupBy("wallet", "asset_pair").agg(F.max_by("id", F.struct("timestamp", "id")).alias("id"))
    text = F.to_json(F.struct("wallet", "score"))
    return s.join(newest.withColumn("hit", F.lit(True)), ["wallet", "asset_pair", "id"], "left").select("id", F.when(F.col("hit"), text).alias("explanation"))


# reads -----------------------------------------------------------------------------------


def score_replay(spark: SparkSession, d: str) -> DataFrame:
    """Scores from April on in order of (timestamp, id); only given arguments filter."""
    s = optional(_scores(spark, d), equal={"wallet": None, "benford_flag": True}, at_least={"timestamp": F.lit("2026-04-01 00:00:00").cast("timestamp_ntz"), "score": None}, below={"timestamp": None})
    return s.select("id", "wallet", "score", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at_time")).orderBy("at_time", "id")


def feedback_range(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the last 60 days per model verdict, confirmed ones apart."""
    f = optional(_feedback(spark, d), at_least={"at": _now() - F.expr("INTERVAL 60 DAYS")})
    return f.groupBy("y", (F.col("ens") >= 50).alias("predicted")).agg(F.count(F.lit(1)).alias("labels"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def short_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of twenty with the minimum score asked before the limit (whole) and after it (short)."""
    order = [F.col("timestamp").desc(), F.col("id").desc()]
    s = _scores(spark, d).select("id", "score", "timestamp")
    whole, short = s.filter("score >= 60").orderBy(*order).limit(20), s.orderBy(*order).limit(20).filter("score >= 60")
    return whole.select("id", F.lit("whole").alias("page")).unionAll(short.select("id", F.lit("short").alias("page")))


def rate_limited(spark: SparkSession, d: str) -> DataFrame:
    """Requests (keys as seen) per source and minute over a limit of 2 by the sliding estimate: this minute plus the weighted one before."""
    k = table(spark, d, "ingestion_dedup_keys").select("source", "id", "first_seen_at", F.date_trunc("minute", "first_seen_at").alias("m"))
    per = k.groupBy("source", "m").agg(F.count(F.lit(1)).alias("n"))
    before = per.select("source", (F.col("m") + F.expr("INTERVAL 1 MINUTE")).alias("m"), F.col("n").alias("last"))
    x = k.withColumn("k", F.row_number().over(Window.partitionBy("source", "m").orderBy("first_seen_at", "id"))).join(before, ["source", "m"], "left")
    left = 1 - F.timestamp_diff("MICROSECOND", F.col("m"), F.col("first_seen_at")) / F.lit(60e6)
    estimate = F.col("k") + F.coalesce("last", F.lit(0)) * left
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("requests"), F.count_if(estimate > 2).alias("limited"))


# model upkeep ------------------------------------------------------------------------------


def _f1(rows: DataFrame, keys: list) -> DataFrame:
    hit = F.col("p") >= 0.5
    return rows.groupBy(*keys).agg(
        F.count_if((F.col("y") == 1) & hit).alias("tp"), F.count_if((F.col("y") == 0) & hit).alias("fp"), F.count_if((F.col("y") == 1) & ~hit).alias("fn"), F.count(F.lit(1)).alias("n")
    ).withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def f1_weights(spark: SparkSession, d: str) -> DataFrame:
    """Model weights after one update from a third each: 0.3 towards the shares of F1, at most 0.1 away, at least 0.1, summing to one."""
    m = F.explode(F.array(*[F.struct(F.lit(x).alias("model"), F.col(x).cast("double").alias("p")) for x in ("rf", "xg", "lg")]))
    f = _f1(_feedback(spark, d).select("y", m.alias("e")).select("y", "e.*").filter("p IS NOT NULL"), ["model"])
    all_ = Window.partitionBy()  # three rows
    target = F.when(F.sum("f1").over(all_) > 0, F.col("f1") / F.sum("f1").over(all_)).otherwise(1 / 3)
    ema = 0.3 * target + 0.7 / 3
    w = f.select("model", F.greatest(F.lit(0.1), 1 / 3 + clip(ema - 1 / 3, -0.1, 0.1)).alias("w"))
    return w.select("model", F.round(F.col("w") / F.sum("w").over(all_), 9).alias("weight"))


def degradation(spark: SparkSession, d: str) -> DataFrame:
    """Weekly F1 of the ensemble against the first four weeks' and whether it fell by more than 0.05; weeks with under 20 labels raise nothing."""
    f = _feedback(spark, d).filter("at IS NOT NULL").select("y", (F.col("ens") / 100).alias("p"), F.date_trunc("week", "at").alias("week"))
    first = f.agg(F.min("week").alias("w0"))
    x = f.join(F.broadcast(first))  # one row
    early = F.col("week") < F.col("w0") + F.expr("INTERVAL 28 DAYS")
    base = _f1(x.filter(early), []).select(F.col("f1").alias("base"))
    weeks = _f1(x, ["week"]).join(F.broadcast(base))
    return weeks.select(F.date_format("week", "yyyy-MM-dd").alias("week"), "n", F.round("f1", 9).alias("f1"), ((F.col("n") >= 20) & (F.col("base") - F.col("f1") > 0.05)).alias("degraded"))


def backtest(spark: SparkSession, d: str) -> DataFrame:
    """Per wallet: score = int(100 p) of the models' mean over its labels, majority label, and whether the verdict at 50 is right."""
    f = _feedback(spark, d).filter("rf IS NOT NULL AND xg IS NOT NULL AND lg IS NOT NULL")
    w = f.groupBy("wallet").agg(F.round(F.avg((F.col("rf") + F.col("xg") + F.col("lg")) / 3), 9).alias("p"), (F.avg("y") > 0.5).cast("int").alias("label"))
    score = F.floor(F.round(F.col("p") * 100, 6)).cast("int")
    return w.select("wallet", score.alias("score"), "label", ((score >= 50).cast("int") == F.col("label")).alias("correct"))


def fused_scores(spark: SparkSession, d: str) -> DataFrame:
    """Forest probability fused with a sequence (weight 0.4) and a graph probability (weight 0.5), weights clamped to 0..1, nulls left out."""
    f = _feedback(spark, d).filter("rf IS NOT NULL")
    seq = F.when(F.col("xg").isNull(), F.col("rf")).otherwise(0.6 * F.col("rf") + 0.4 * F.col("xg"))
    both = F.when(F.col("lg").isNull(), seq).otherwise(0.5 * seq + 0.5 * F.col("lg"))
    return f.select("id", F.round(clip(both, 0.0, 1.0), 9).alias("fused"))


def bandit_weights(spark: SparkSession, d: str, draws: int = 20_000, seed: int = 5) -> DataFrame:
    """Share of draws in which each model's Beta sample (rights + 1, wrongs + 1) is the highest; three rows reach the driver."""
    m = F.explode(F.array(*[F.struct(F.lit(x).alias("model"), F.col(x).cast("double").alias("p")) for x in ("rf", "xg", "lg")]))
    f = _feedback(spark, d).select("y", m.alias("e")).select("y", "e.*").filter("p IS NOT NULL")
    right = (F.col("p") >= 0.5).cast("int") == F.col("y")
    rows = f.groupBy("model").agg(F.count_if(right).alias("a"), F.count_if(~right).alias("b")).orderBy("model").collect()
    if not rows:
        return spark.createDataFrame([], "model string, share double")
    rng = np.random.default_rng(seed)
    won = np.argmax([rng.beta(r["a"] + 1, r["b"] + 1, draws) for r in rows], axis=0)
    return spark.createDataFrame([(r["model"], float((won == i).mean())) for i, r in enumerate(rows)], "model string, share double")


def clipped_updates(spark: SparkSession, d: str, longest: float = 1.0, least_cosine: float = 0.1) -> DataFrame:
    """Embeddings as updates against the mean of all: norm, scaled to at most ``longest``, and excluded if their cosine with the mean is below ``least_cosine``."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    mean = v.select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m")).agg(F.array_sort(F.collect_list(F.struct("p", "m"))).alias("a")).select(F.col("a.m").alias("m"))
    dot = lambda a, c: F.aggregate(F.zip_with(a, c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    x = v.join(F.broadcast(mean))  # one row
    x = x.select("vec_id", F.sqrt(dot("v", "v")).alias("norm"), F.sqrt(dot("m", "m")).alias("mn"), dot("v", "m").alias("vm"))
    cosine = F.col("vm") / (F.col("norm") * F.col("mn"))
    known = (F.col("norm") > 1e-10) & (F.col("mn") > 1e-10)
    return x.select("vec_id", F.round("norm", 7).alias("norm"), F.round(F.least(F.lit(1.0), longest / F.col("norm")), 7).alias("scale"), F.coalesce(known & (cosine < least_cosine), F.lit(False)).alias("excluded"))


def privacy_budget(spark: SparkSession, d: str) -> DataFrame:
    """Per analyst: rounds (labels), running privacy cost of 0.01 each, the total, and the round that exceeds 0.5."""
    f = _feedback(spark, d).filter("at IS NOT NULL").groupBy("analyst").agg(F.count(F.lit(1)).alias("rounds"))
    return f.select("analyst", "rounds", F.round(F.col("rounds") * 0.01, 9).alias("epsilon"), F.when(F.col("rounds") > 50, F.lit(51)).alias("exhausted_at"))


# reports -----------------------------------------------------------------------------------


def sar_context(spark: SparkSession, d: str) -> DataFrame:
    """Per wallet what a report names for the last 60 days: multi-hop and pool trades, volume, counterparties, digit chi-square and p."""
    since = _now() - F.expr("INTERVAL 60 DAYS")
    t = trades(spark, d).filter((F.col("ts") >= since) & (F.col("ts") <= _now()))
    many = t.groupBy("op").agg(F.count(F.lit(1)).alias("k")).filter("k > 1 AND op IS NOT NULL").select("op")
    paths = t.join(many, "op", "left_semi").filter("pool IS NULL")
    sides = F.array_distinct(F.array_compact(F.array("base", "counter")))
    p = paths.select(F.explode(sides).alias("wallet"), "base", "counter", "amount").select("wallet", F.when(F.col("base") == F.col("wallet"), F.col("counter")).otherwise(F.col("base")).alias("cp"), "amount")
    p = p.withColumn("cp", F.when(F.col("cp") != F.col("wallet"), F.col("cp")))
    pools = t.filter("pool IS NOT NULL").select(F.col("base").alias("wallet"), F.concat(F.lit("pool:"), "pool").alias("cp"), "amount")
    u = p.unionByName(pools)
    h = u.groupBy("wallet").agg(F.count(F.lit(1)).alias("trades"), exact_sum("amount").alias("volume"), F.countDistinct("cp").alias("counterparties"), *b.digit_counts(b.leading_digit(F.col("amount"))))
    chi = b.chi_square(b.counts(), b.total(b.counts()))
    return h.select("wallet", "trades", "volume", "counterparties", F.round(chi, 5).alias("chi2"), F.round(b.chi2_sf8(chi), 8).alias("p"))


def relationship_graph(spark: SparkSession, d: str) -> DataFrame:
    """Star edges of reported wallets (a score of 95 or more): to counterparties of trades, and to the far ends of their transfers."""
    subjects = _scores(spark, d).filter("score >= 95").select("wallet").distinct()
    t = wallet_rows(spark, d).filter("cp IS NOT NULL AND cp <> wallet").select("wallet", F.col("cp").alias("other"), F.lit("trade").alias("relationship"), F.lit("counterparty").alias("role"))
    x = transfers(spark, d).filter("wallet IS NOT NULL AND evm IS NOT NULL").select("wallet", F.col("evm").alias("other"), F.lit("bridge").alias("relationship"), F.lit("linked").alias("role"))
    return t.unionAll(x).distinct().join(subjects, "wallet", "left_semi")


# digit variants ------------------------------------------------------------------------------


def log_digits(spark: SparkSession, d: str) -> DataFrame:
    """Leading digits by the logarithm's fraction against those of the decimal text: how many amounts disagree, per digit."""
    a = trades(spark, d).select("amount", b.leading_digit(F.col("amount")).alias("digit"))
    lead = F.floor(F.pow(F.lit(10.0), F.pmod(F.log10("amount"), F.lit(1.0)))).cast("int")
    return a.filter("digit IS NOT NULL").groupBy("digit").agg(F.count(F.lit(1)).alias("amounts"), (F.count_if(F.abs(lead - F.col("digit")) > 1)).alias("far_off"))


def state_benford(spark: SparkSession, d: str) -> DataFrame:
    """Chi-square on proportions against the law rounded to three digits, per wallet, as kept counters give it."""
    h = wallet_rows(spark, d).groupBy("wallet").agg(*b.digit_counts(b.leading_digit(F.col("amount"))))
    n = b.total(b.counts())
    law = [round(e, 3) for e in b.EXPECTED]
    chi = b.total([F.pow(F.col(f"c{k}") / n - e, 2) / e for k, e in enumerate(law, 1)])
    return h.filter(n > 0).select("wallet", n.alias("n"), F.round(chi, 7).alias("chi2"))


# stores: written, read again --------------------------------------------------------------------


def tier_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Scores archived by day, read back through folder pruning for April, united with what stayed: rows and sums per tier."""
    s = _scores(spark, d).select("id", "wallet", "score", "timestamp")
    path = shared_dir(spark, "cold") + "/tier"
    hot = archive(s, "timestamp", F.lit("2026-05-01 00:00:00").cast("timestamp_ntz"), path)
    cold = read_tier(spark, path, "timestamp", dt.datetime(2026, 4, 1), dt.datetime(2026, 5, 1)).select("id", "score", F.lit("cold").alias("tier"))
    u = cold.unionByName(hot.select("id", "score", F.lit("hot").alias("tier")))
    return u.groupBy("tier").agg(F.count(F.lit(1)).alias("rows"), F.sum("score").alias("score_sum"), F.max("id").alias("last_id"))


def promoted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Cold rows of wallets that are hot again (scored from May on), promoted once each: rows per month."""
    s = _scores(spark, d).select("id", "wallet", "score", "timestamp")
    path = shared_dir(spark, "cold") + "/tier"
    hot = archive(s, "timestamp", F.lit("2026-05-01 00:00:00").cast("timestamp_ntz"), path)
    cold = read_tier(spark, path, "timestamp").select("id", "wallet", "score", "timestamp")
    back = cold.join(hot.select("wallet").distinct(), "wallet", "left_semi").dropDuplicates(["id"])
    return back.groupBy(F.date_format("timestamp", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("wallet").alias("wallets"))


def export_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Trades exported by day and pair, the later ones by manifest delta alone, then read back: rows and amounts per day."""
    t = trades(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "pair_key", "token", "trade_id", "amount")
    path = shared_dir(spark, "export") + "/trades"
    old = t.filter(F.col("day") < "2026-05-20")
    manifest = export_partitions(old, path, ["day"], None, "token")
    export_partitions(t, path, ["day"], manifest, "token")
    out = spark.read.parquet(path)
    return out.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("rows"), exact_sum("amount").alias("amount"))


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Labels written as CSV and read back as a labelled data set: rows and mean score per label."""
    f = table(spark, d, "label_feedback").select("wallet", F.col("true_label").alias("label"), "ensemble_score")
    path = shared_dir(spark, "csv") + "/labels"
    f.write.option("header", True).csv(path)
    back = labelled_csv(spark, path)
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.col("ensemble_score").cast("int")), 7).alias("mean_score"))


def event_bus(spark: SparkSession, d: str) -> DataFrame:
    """High scores published as JSON messages keyed by wallet to a topic folder, appended in two batches, consumed and counted per pair."""
    s = _scores(spark, d).filter("score >= 90")
    bus = FolderBus(spark, shared_dir(spark, "topic"))
    body = F.to_json(F.struct("id", "wallet", "asset_pair", "score"))
    for part in (s.filter("ml_flag"), s.filter("NOT ml_flag")):
        bus.publish("scores", part.select(F.col("wallet").alias("key"), body.alias("value")))
    read = bus.consume("scores").select("key", F.from_json("value", "id long, asset_pair string, score int").alias("v"))
    return read.groupBy(F.col("v.asset_pair").alias("asset_pair")).agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("key").alias("keys"), F.max("v.score").alias("top"))


def dead_letter_replay(spark: SparkSession, d: str) -> DataFrame:
    """Landed lines that failed, stored as dead letters by error class and feed, and what a replay with a mended reader accepts.

    The mended reader also takes accounts named otherwise; broken JSON stays dead.
    """
    v = F.try_parse_json("payload")
    account = F.coalesce(*[F.get_json_object("payload", f"$.{k}") for k in ("base_account", "base_account_id", "baseAccount")])
    error = F.when(v.isNull(), "json").when(F.get_json_object("payload", "$.base_account").isNull(), "no_account")
    path = shared_dir(spark, "dead") + "/letters"
    table(spark, d, "horizon_trade_raw").withColumn("error_class", error).filter("error_class IS NOT NULL").write.partitionBy("error_class").parquet(path)
    dead = spark.read.parquet(path)
    return dead.groupBy("error_class", "feed").agg(F.count(F.lit(1)).alias("lines"), F.count_if((F.col("error_class") == "no_account") & account.isNotNull()).alias("accepted"))


QUERIES = {
    f.__name__: f
    for f in (
        expired_locks, claims, case_stats, analyst_month, delivery_retries, cached_explanation, score_replay, feedback_range, short_page,
        rate_limited, f1_weights, degradation, backtest, fused_scores, bandit_weights, clipped_updates, privacy_budget, sar_context,
        relationship_graph, log_digits, state_benford, tier_round_trip, promoted_rows, export_round_trip, csv_round_trip, event_bus,
        dead_letter_replay,
    )
}

_NOWS = f"TIMESTAMP '{AS_OF}'"
_K = r"lower(trim(idempotency_key, E' \t\n\r'))"
_P3 = " UNION ALL ".join(f"SELECT y, '{m}' AS model, CAST({m} AS DOUBLE) AS p FROM fb WHERE {m} IS NOT NULL" for m in ("rf", "xg", "lg"))
_F1 = "coalesce(2 * count(*) FILTER (y = 1 AND p >= 0.5) / nullif(2 * count(*) FILTER (y = 1 AND p >= 0.5) + count(*) FILTER (y = 0 AND p >= 0.5) + count(*) FILTER (y = 1 AND p < 0.5), 0), 0)"

ORACLE = {
    "expired_locks": f"""WITH {CASES_SQL}, h AS (SELECT status, coalesce(status = 'assigned' AND lock_expires_at <= {_NOWS}, FALSE) AS hit FROM cases)
SELECT CASE WHEN hit THEN 'released' ELSE status END AS status, count(*) AS cases, count(*) FILTER (hit) AS changed FROM h GROUP BY 1""",
    "claims": f"""WITH {CASES_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY wallet, asset_pair ORDER BY assigned_at NULLS FIRST, id) AS rn FROM cases WHERE status = 'assigned' AND asset_pair IS NOT NULL),
l AS (SELECT wallet, asset_pair, arg_min(analyst, rn) AS holder FROM c WHERE lock_expires_at > {_NOWS} GROUP BY ALL)
SELECT id, c.wallet, c.asset_pair, analyst, CASE WHEN holder = analyst THEN 'renewed' WHEN holder IS NOT NULL THEN 'refused' WHEN rn = 1 THEN 'taken' ELSE 'refused' END AS outcome
FROM c LEFT JOIN l ON l.wallet = c.wallet AND l.asset_pair = c.asset_pair""",
    "case_stats": f"""WITH {CASES_SQL}, {_S}, u AS (SELECT DISTINCT wallet, asset_pair FROM s)
SELECT (SELECT round(avg((epoch_us(resolved_at) - epoch_us(assigned_at)) / 1e6), 1) FROM cases) AS mean_resolution_s,
  (SELECT count(*) FROM cases WHERE status = 'assigned' AND lock_expires_at > {_NOWS}) AS assigned, (SELECT count(*) FROM cases WHERE status = 'assigned' AND lock_expires_at <= {_NOWS}) AS expired,
  (SELECT count(*) FROM u WHERE NOT EXISTS (SELECT 1 FROM label_feedback f WHERE f.wallet = u.wallet AND f.asset_pair = u.asset_pair AND confirmed_at >= {_NOWS} - INTERVAL 7 DAY)
     AND NOT EXISTS (SELECT 1 FROM cases c WHERE c.wallet = u.wallet AND c.asset_pair = u.asset_pair AND status = 'assigned' AND lock_expires_at > {_NOWS})) AS unassigned""",
    "analyst_month": f"""SELECT count(*) FILTER (confirmed_at >= {_NOWS} - INTERVAL 1 DAY) AS today,
  round(coalesce(count(*) FILTER (true_label = 0 AND confirmed_at >= {_NOWS} - INTERVAL 30 DAY) / nullif(count(*) FILTER (true_label IN (0, 1) AND confirmed_at >= {_NOWS} - INTERVAL 30 DAY), 0), 0), 4) AS clean_rate,
  round(avg(ensemble_score * 60.0) FILTER (true_label IN (0, 1) AND confirmed_at >= {_NOWS} - INTERVAL 30 DAY), 1) AS mean_review_s FROM label_feedback""",
    "delivery_retries": f"""WITH n AS (SELECT {_K} AS k, count(*) AS attempts FROM ingestion_dedup_keys WHERE {_K} <> '' GROUP BY 1)
SELECT attempts, CASE WHEN attempts >= 8 THEN 'dead' ELSE 'pending' END AS status, CASE WHEN attempts < 8 THEN least(pow(2, attempts) * 30, 3600) END AS delay_s, count(*) AS deliveries FROM n GROUP BY 1""",
    "cached_explanation": f"""WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY wallet, asset_pair ORDER BY timestamp DESC, id DESC) AS rn FROM s)
SELECT id, CASE WHEN rn = 1 THEN '{{"wallet":"' || wallet || '","score":' || score || '}}' END AS explanation FROM r""",
    "score_replay": f"WITH {_S} SELECT id, wallet, score, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS at_time FROM s WHERE benford_flag AND timestamp >= TIMESTAMP '2026-04-01 00:00:00' ORDER BY at_time, id",
    "feedback_range": f"WITH {_F} SELECT y, ens >= 50 AS predicted, count(*) AS labels, min(id) AS first_id, max(id) AS last_id FROM fb WHERE tm >= {_NOWS} - INTERVAL 60 DAY GROUP BY 1, 2",
    "short_page": f"""WITH {_S}, p AS (SELECT id, score FROM s ORDER BY timestamp DESC, id DESC LIMIT 20), q AS (SELECT id FROM s WHERE score >= 60 ORDER BY timestamp DESC, id DESC LIMIT 20)
SELECT id, 'whole' AS page FROM q UNION ALL SELECT id, 'short' FROM p WHERE score >= 60""",
    "rate_limited": """WITH k AS (SELECT source, id, first_seen_at AS t, date_trunc('minute', first_seen_at) AS m FROM ingestion_dedup_keys), n AS (SELECT source, m, count(*) AS n FROM k GROUP BY ALL),
x AS (SELECT k.source, row_number() OVER (PARTITION BY k.source, k.m ORDER BY t, id) + coalesce(n.n, 0) * (1 - (epoch_us(t) - epoch_us(k.m)) / 60e6) AS e FROM k LEFT JOIN n ON n.source = k.source AND n.m = k.m - INTERVAL 1 MINUTE)
SELECT source, count(*) AS requests, count(*) FILTER (e > 2) AS limited FROM x GROUP BY 1""",
    "f1_weights": f"""WITH {_F}, e AS ({_P3}), f AS (SELECT model, {_F1} AS f1 FROM e GROUP BY 1), t AS (SELECT model, CASE WHEN sum(f1) OVER () > 0 THEN f1 / sum(f1) OVER () ELSE 1.0::DOUBLE / 3 END AS t FROM f),
w AS (SELECT model, greatest(0.1, 1.0::DOUBLE / 3 + least(greatest(0.3 * t + 0.7::DOUBLE / 3 - 1.0::DOUBLE / 3, -0.1), 0.1)) AS w FROM t) SELECT model, round(w / sum(w) OVER (), 9) AS weight FROM w""",
    "degradation": f"""WITH {_F}, x AS (SELECT y, ens / 100 AS p, date_trunc('week', tm) AS week FROM fb WHERE tm IS NOT NULL), b AS (SELECT {_F1} AS base FROM x WHERE week < (SELECT min(week) FROM x) + INTERVAL 28 DAY),
w AS (SELECT week, count(*) AS n, {_F1} AS f1 FROM x GROUP BY 1) SELECT strftime(week, '%Y-%m-%d') AS week, n, round(f1, 9) AS f1, n >= 20 AND base - f1 > 0.05 AS degraded FROM w, b""",
    "backtest": f"""WITH {_F}, w AS (SELECT wallet, round(avg((rf + xg + lg) / 3), 9) AS p, (avg(y) > 0.5)::INT AS label FROM fb WHERE rf IS NOT NULL AND xg IS NOT NULL AND lg IS NOT NULL GROUP BY 1),
s AS (SELECT wallet, CAST(floor(round(p * 100, 6)) AS INT) AS score, label FROM w) SELECT wallet, score, label, (score >= 50)::INT = label AS correct FROM s""",
    "fused_scores": f"""WITH {_F}, q AS (SELECT id, lg, CASE WHEN xg IS NULL THEN rf ELSE 0.6::DOUBLE * rf + 0.4::DOUBLE * xg END AS s FROM fb WHERE rf IS NOT NULL)
SELECT id, round(least(greatest(CASE WHEN lg IS NULL THEN s ELSE 0.5 * s + 0.5 * lg END, 0), 1), 9) AS fused FROM q""",
    "clipped_updates": """WITH c AS (SELECT vec_id, unnest(generate_series(1, 64)) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT p, avg(x) AS m FROM c GROUP BY 1),
v AS (SELECT vec_id, sqrt(sum(x * x)) AS norm, sqrt(sum(m * m)) AS mn, sum(x * m) AS vm FROM c JOIN m ON m.p = c.p GROUP BY 1)
SELECT vec_id, round(norm, 7) AS norm, round(least(1.0, 1.0 / norm), 7) AS scale, coalesce(norm > 1e-10 AND mn > 1e-10 AND vm / (norm * mn) < 0.1, FALSE) AS excluded FROM v""",
    "privacy_budget": f"WITH {_F} SELECT analyst, count(*) AS rounds, round(count(*) * 0.01, 9)::DOUBLE AS epsilon, CASE WHEN count(*) > 50 THEN 51 END AS exhausted_at FROM fb WHERE tm IS NOT NULL GROUP BY 1",
    "sar_context": f"""WITH {TRADES_SQL}, t AS (SELECT * FROM trades WHERE ts >= {_NOWS} - INTERVAL 60 DAY AND ts <= {_NOWS}), mo AS (SELECT op FROM t WHERE op IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
pp AS (SELECT * FROM t WHERE pool IS NULL AND op IN (SELECT op FROM mo)),
u AS (SELECT base AS wallet, nullif(counter, base) AS cp, amount FROM pp UNION ALL SELECT counter, base, amount FROM pp WHERE counter IS NOT NULL AND counter <> base UNION ALL SELECT base, 'pool:' || pool, amount FROM t WHERE pool IS NOT NULL),
g AS (SELECT wallet, cp, amount, {_DG} FROM u), h AS (SELECT wallet, count(*) AS trades, CAST(sum(CAST(amount AS DECIMAL(38,8))) AS DOUBLE) AS volume, count(DISTINCT cp) AS counterparties, count(dg) AS n, {_sql_counts()} FROM g GROUP BY 1),
x AS (SELECT *, {_CHI} AS chi FROM h) SELECT wallet, trades, volume, counterparties, round(chi, 5) AS chi2, round(exp(-chi/2) * (1 + chi/2 + pow(chi/2, 2)/2 + pow(chi/2, 3)/6), 8) AS p FROM x""",
    "relationship_graph": f"""WITH {WALLET_SQL}, {TRANSFERS_SQL}, {_S}, e AS (SELECT wallet, cp AS other, 'trade' AS relationship, 'counterparty' AS role FROM wrows WHERE cp IS NOT NULL AND cp <> wallet
UNION SELECT wallet, evm, 'bridge', 'linked' FROM transfers WHERE wallet IS NOT NULL AND evm IS NOT NULL) SELECT * FROM e WHERE wallet IN (SELECT wallet FROM s WHERE score >= 95)""",
    "log_digits": f"""WITH {TRADES_SQL}, g AS (SELECT amount, {_DG} FROM trades) SELECT dg AS digit, count(*) AS amounts, count(*) FILTER (abs(floor(pow(10, log10(amount) - floor(log10(amount)))) - dg) > 1) AS far_off FROM g WHERE dg IS NOT NULL GROUP BY 1""",
    "state_benford": f"""WITH {WALLET_SQL}, g AS (SELECT wallet, {_DG} FROM wrows), h AS (SELECT wallet, count(dg) AS n, {_sql_counts()} FROM g GROUP BY 1)
SELECT wallet, n, round({' + '.join(f'pow(c{k} / n - {round(b.EXPECTED[k - 1], 3)}::DOUBLE, 2) / {round(b.EXPECTED[k - 1], 3)}::DOUBLE' for k in range(1, 10))}, 7) AS chi2 FROM h WHERE n > 0""",
    "tier_round_trip": f"""WITH {_S}, u AS (SELECT id, score, CASE WHEN timestamp >= TIMESTAMP '2026-05-01' THEN 'hot' WHEN timestamp >= TIMESTAMP '2026-04-01' THEN 'cold' END AS tier FROM s)
SELECT tier, count(*) AS rows, CAST(sum(score) AS BIGINT) AS score_sum, max(id) AS last_id FROM u WHERE tier IS NOT NULL GROUP BY 1""",
    "promoted_rows": f"""WITH {_S} SELECT strftime(timestamp, '%Y-%m') AS month, count(*) AS rows, count(DISTINCT wallet) AS wallets FROM s
WHERE timestamp < TIMESTAMP '2026-05-01' AND wallet IN (SELECT wallet FROM s WHERE timestamp >= TIMESTAMP '2026-05-01') GROUP BY 1""",
    "export_round_trip": f"WITH {TRADES_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, CAST(sum(CAST(amount AS DECIMAL(38,8))) AS DOUBLE) AS amount FROM trades GROUP BY 1",
    "csv_round_trip": "SELECT true_label AS label, count(*) AS rows, round(avg(ensemble_score), 7) AS mean_score FROM label_feedback GROUP BY 1",
    "event_bus": f"WITH {_S} SELECT asset_pair, count(*) AS messages, count(DISTINCT wallet) AS keys, max(score) AS top FROM s WHERE score >= 90 AND ml_flag IS NOT NULL GROUP BY 1",
    "dead_letter_replay": """WITH e AS (SELECT feed, payload, CASE WHEN NOT json_valid(payload) THEN 'json' WHEN json_extract_string(payload, '$.base_account') IS NULL THEN 'no_account' END AS error_class FROM horizon_trade_raw)
SELECT error_class, feed, count(*) AS lines, count(*) FILTER (CASE WHEN error_class = 'no_account' THEN coalesce(json_extract_string(payload, '$.base_account_id'), json_extract_string(payload, '$.baseAccount')) IS NOT NULL ELSE FALSE END) AS accepted
FROM e WHERE error_class IS NOT NULL GROUP BY 1, 2""",
}
