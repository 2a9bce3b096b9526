"""Filters, joins, set operations, listings: the query layer over scores, labels, transfers and trades."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike.functions.cells import amount, micros, stripped
from marlspike.functions.stats import exact_sum, ratio
from marlspike.operators.rangejoin import band_join
from marlspike.queries.views import AS_OF, CASES_SQL, TRADES_SQL, TRANSFERS_SQL, WALLET_SQL, assignments, trades, transfers, wallet_rows
from marlspike.session import durable
from marlspike.sources.plugins import Filter, first_rejection
from marlspike.sources.tables import table

# fixed values: identifier patterns
ACCOUNT = r"^G[A-Z2-7]{55}$"
ASSET = r"^[A-Za-z0-9]{1,12}$"
EVM = r"^0x[0-9a-fA-F]{40}$"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "risk_scores").filter("wallet IS NOT NULL AND asset_pair IS NOT NULL AND score BETWEEN 0 AND 100")


_S = "s AS (SELECT * FROM risk_scores WHERE wallet IS NOT NULL AND asset_pair IS NOT NULL AND score BETWEEN 0 AND 100)"


def first_reason(rules: dict[str, F.Column]) -> F.Column:
    """Name of the first rule that rejects a row, null if none does (filters in order, short-circuit)."""
    return F.coalesce(*[F.when(rejects, F.lit(name)) for name, rejects in rules.items()])


#: Configured filters, in their order. An empty whitelist lets all pairs pass; pairs are compared by code, case-sensitively.
WHITELIST: tuple[str, ...] = ()
BLACKLIST = ("EURV/XLM", "AQUR/XLM")
LEAST = {"base": 5, "counter": 1, "price": 0}
ASSET_KINDS = ("native", "alphanum4")


def _asset_kind(code: F.Column) -> F.Column:
    return F.when(code == "XLM", "native").when(F.length(code) <= 4, "alphanum4").otherwise("alphanum12")


def filter_pipeline_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Trades by the first filter that rejects them: pair lists, minimum amounts, asset kinds of either side, excluded accounts of either side.

    Excluded are accounts of unknown age, a list of its own that is joined.
    """
    excluded = table(spark, d, "account_metadata").filter("created_at IS NULL").select("account").distinct()
    t = trades(spark, d).withColumn("other", F.coalesce("counter", "base"))
    t = t.join(excluded.select(F.col("account").alias("base"), F.lit(True).alias("bad_base")), "base", "left")
    t = t.join(excluded.select(F.col("account").alias("other"), F.lit(True).alias("bad_other")), "other", "left")
    small = lambda c, least: F.coalesce(F.col(c) < least, F.lit(False))
    chain = [Filter("pair_whitelist", lambda r: ~F.col("pair").isin(*WHITELIST))] if WHITELIST else []
    chain += [
        Filter("pair_blacklist", lambda r: F.col("pair").isin(*BLACKLIST)),
        Filter("min_volume", lambda r: small("amount", LEAST["base"]) | small("counter_amount", LEAST["counter"]) | small("price", LEAST["price"])),
        Filter("asset_type", lambda r: ~_asset_kind(F.col("base_code")).isin(*ASSET_KINDS) | ~_asset_kind(F.col("counter_code")).isin(*ASSET_KINDS)),
        Filter("excluded_account", lambda r: F.col("bad_base").isNotNull() | F.col("bad_other").isNotNull()),
    ]
    return first_rejection(t, chain).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("trades"))


def accepted_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Both outputs of the split, counted per pair."""
    reason = first_reason({"small": F.col("amount") < 5, "self": F.coalesce(F.col("base") == F.col("counter"), F.lit(False))})
    t = trades(spark, d).withColumn("reason", reason)
    return t.groupBy("pair_key").agg(F.count_if(F.expr("reason IS NULL")).alias("accepted"), F.count_if(F.expr("reason IS NOT NULL")).alias("rejected"))


def validation_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every broken rule of raw trade messages and how often it is broken."""
    value = amount(F.col("base_amount"))
    issuer = F.coalesce((F.col("base_asset_type") != "native") & F.col("base_asset_issuer").isNull(), F.lit(False))
    pool = F.coalesce(F.lower(stripped(F.col("trade_type"))).isin("liquidity_pool", "2") & F.col("liquidity_pool_id").isNull(), F.lit(False))
    rules = {
        "base_account": F.col("base_account").isNull(), "ledger_close_time": F.col("ledger_close_time").isNull(),
        "base_amount": ~F.coalesce(value > 0, F.lit(False)), "issuer": issuer, "pool_id": pool,
        "paging_token": stripped(F.col("paging_token")).isNull(),
    }
    errors = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    rows = table(spark, d, "horizon_trade").select(F.explode_outer(errors).alias("error"))
    return rows.groupBy(F.coalesce("error", F.lit("valid")).alias("error")).agg(F.count(F.lit(1)).alias("rows"))


def identifier_checks(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bridge_transfers")
    return b.groupBy("direction").agg(
        F.count_if(F.col("evm_wallet").rlike(EVM)).alias("evm_ok"), F.count_if(F.col("stellar_wallet").rlike(ACCOUNT)).alias("account_ok"),
        F.count_if(F.col("token").rlike(ASSET)).alias("token_ok"), F.count(F.lit(1)).alias("rows"),
    )


def asset_types(spark: SparkSession, d: str) -> DataFrame:
    """Asset symbol, pair sanitising and type by code length."""
    t = table(spark, d, "horizon_trade").select(
        F.concat_ws(":", F.coalesce("base_asset_code", F.lit("XLM")), "base_asset_issuer").alias("symbol"), "base_asset_code", "base_asset_issuer"
    ).distinct()
    kind = F.when(F.col("base_asset_issuer").isNull(), "native").when(F.length("base_asset_code") <= 4, "alphanum4").otherwise("alphanum12")
    return t.select("symbol", kind.alias("kind"), F.upper(F.regexp_replace("symbol", "[^A-Za-z0-9]", "_")).alias("partition_key"), F.upper("symbol").rlike(r"^[A-Z0-9/.:\-]{1,30}$").alias("sane"))


def suppressed_alerts(spark: SparkSession, d: str) -> DataFrame:
    """High scores whose wallet has no active suppression.

    A label 0 suppresses for 30 days, given on an ensemble score of 95 or more
    without an end; a suppression is active if its end is null or yet to come.
    """
    end = F.lit(AS_OF).cast("timestamp_ntz")
    expires = F.when(F.col("ensemble_score") < 95, F.col("confirmed_at") + F.expr("INTERVAL 30 DAYS"))
    rules = table(spark, d, "label_feedback").filter("true_label = 0").withColumn("expires", expires)
    active = rules.filter(F.col("expires").isNull() | (F.col("expires") > end))
    return _scores(spark, d).filter("score >= 90").join(active, "wallet", "left_anti").select("id", "wallet", "asset_pair", "score")


def json_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Keys of blocks below a height, by the number inside their JSON metadata."""
    height = F.get_json_object("metadata_json", "$.block_number").try_cast("long")
    return table(spark, d, "ingestion_dedup_keys").filter(height < 9_000_000).groupBy("source").agg(
        F.count(F.lit(1)).alias("keys"), F.max(height).alias("highest")
    )


def subscriber_match(spark: SparkSession, d: str) -> DataFrame:
    """Scores each subscriber wants: minimum score, and pair in its filter if it has one (3 configured subscribers)."""
    subs = spark.createDataFrame(
        [("all", 95, []), ("majors", 80, ["XLM/VUSD", "XLM/AQUR"]), ("euro", 60, ["EURV/VUSD"])], "subscriber string, min_score int, pairs array<string>"
    )
    s = _scores(spark, d)
    hit = (s["score"] >= subs["min_score"]) & ((F.size(subs["pairs"]) == 0) | F.array_contains(subs["pairs"], s["asset_pair"]))
    return s.join(F.broadcast(subs), hit).groupBy("subscriber").agg(F.count(F.lit(1)).alias("scores"), F.countDistinct("wallet").alias("wallets"))


def latest_scores(spark: SparkSession, d: str) -> DataFrame:
    """Newest score rows per wallet and pair; ties on the time all stay; flag filter afterwards."""
    by = Window.partitionBy("wallet", "asset_pair").orderBy(F.col("timestamp").desc())
    return _scores(spark, d).withColumn("r", F.rank().over(by)).filter("r = 1 AND benford_flag").select("id", "wallet", "asset_pair", "score", "confidence")


def latest_by_id(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).groupBy("wallet", "asset_pair").agg(F.max_by(F.struct("id", "score"), "id").alias("x")).select("wallet", "asset_pair", "x.*")


def latest_batch(spark: SparkSession, d: str) -> DataFrame:
    """All messages of the newest batch."""
    t = table(spark, d, "horizon_trade").select("delivery_id", "batch_id", "received_at")
    newest = t.agg(F.max("batch_id").alias("batch_id"))
    return t.join(F.broadcast(newest), "batch_id", "left_semi").select("delivery_id", "batch_id")


def active_assignment_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Latest score per wallet and pair with the analysts who hold it: status 'assigned' and a lock that hasn't run out."""
    now = F.lit(AS_OF).cast("timestamp_ntz")
    held = assignments(spark, d).filter((F.col("status") == "assigned") & (F.col("lock_expires_at") > now))
    held = held.filter("asset_pair IS NOT NULL").groupBy("wallet", "asset_pair").agg(F.array_join(F.array_sort(F.collect_set("analyst")), ",").alias("analysts"))
    last = _scores(spark, d).groupBy("wallet", "asset_pair").agg(F.max_by(F.struct("id", "score"), F.struct("timestamp", "id")).alias("x"))
    return last.join(held, ["wallet", "asset_pair"], "left").select("wallet", "asset_pair", "x.id", "x.score", "analysts")


def proximity_join(spark: SparkSession, d: str) -> DataFrame:
    """Every score with the other score rows of its wallet and pair less than ten seconds away; without one it stays alone."""
    s = _scores(spark, d).filter("timestamp IS NOT NULL").select("wallet", "asset_pair", F.col("id").alias("score_id"), "timestamp")
    v = s.select("wallet", "asset_pair", F.col("score_id").alias("other_id"), F.col("timestamp").alias("at"))
    return band_join(s, v, ["wallet", "asset_pair"], "timestamp", "at", 10, strict=True, how="left", also=F.col("score_id") != F.col("other_id")).select("score_id", "other_id")


def analyst_queue(spark: SparkSession, d: str) -> DataFrame:
    """Top wallets by their highest score, with whether they were reviewed in the last 30 days."""
    end = F.lit(AS_OF).cast("timestamp_ntz")
    recent = table(spark, d, "label_feedback").filter(F.col("confirmed_at") > end - F.expr("INTERVAL 30 DAYS")).select("wallet").distinct().withColumn("reviewed", F.lit(True))
    top = _scores(spark, d).groupBy("wallet").agg(F.max("score").alias("score"))
    return top.join(recent, "wallet", "left").select("wallet", "score", F.coalesce("reviewed", F.lit(False)).alias("reviewed")).orderBy(F.col("score").desc(), "wallet").limit(50)


def unassigned_anti(spark: SparkSession, d: str) -> DataFrame:
    """Scored wallets with neither a label nor a transfer."""
    s = _scores(spark, d).select("wallet").distinct()
    s = s.join(table(spark, d, "label_feedback"), "wallet", "left_anti")
    return s.join(table(spark, d, "bridge_transfers").select(F.col("stellar_wallet").alias("wallet")), "wallet", "left_anti")


def not_in(left: DataFrame, key: str, right: DataFrame, column: str) -> DataFrame:
    """Rows of ``left`` for which ``key NOT IN (SELECT column FROM right)`` is true, SQL's nulls included.

    Without rows on the right all rows stay; with a null there none does; else a
    null key is no answer and goes. An anti join and one row of counts, so
    neither side has to fit anywhere.
    """
    counts = right.agg(F.count(F.lit(1)).alias("__n"), F.count(column).alias("__k"))
    rest = left.join(right.select(F.col(column).alias("__c")).distinct(), F.col(key) == F.col("__c"), "left_anti")
    kept = rest.join(F.broadcast(counts)).filter((F.col("__n") == 0) | ((F.col("__n") == F.col("__k")) & F.col(key).isNotNull()))
    return kept.drop("__n", "__k")


def not_in_anti(spark: SparkSession, d: str) -> DataFrame:
    """Accounts whose funder isn't among the wallets with a high score; an unknown funder is no answer."""
    return not_in(table(spark, d, "account_metadata"), "funding_source", _scores(spark, d).filter("score >= 95"), "wallet").select("account")


def fan_out_semi(spark: SparkSession, d: str) -> DataFrame:
    """Digit sample of scored wallets: each trade once, however many scores its wallet has."""
    scored = _scores(spark, d).select("wallet").distinct()
    return wallet_rows(spark, d).join(scored, "wallet", "left_semi").groupBy("wallet").agg(F.count(F.lit(1)).alias("trades"), exact_sum("amount").alias("volume"))


def claim_times(spark: SparkSession, d: str) -> DataFrame:
    """Per analyst: mean seconds from score to claim over every pair of a claim and a score row of its wallet and pair.

    The pairs aren't formed: scores are counts and sums of times per wallet and
    pair, multiplied with each claim.
    """
    at = micros("timestamp")
    per = _scores(spark, d).filter("timestamp IS NOT NULL").groupBy("wallet", "asset_pair").agg(F.count(F.lit(1)).alias("n"), F.sum(at.cast("decimal(38,0)")).alias("t"))
    c = assignments(spark, d).filter("assigned_at IS NOT NULL").withColumn("a", micros("assigned_at").cast("decimal(20,0)")).join(per, ["wallet", "asset_pair"])
    wait = F.sum((F.col("a") * F.col("n") - F.col("t")).cast("decimal(38,0)")).cast("double") / F.sum("n") / 1e6
    return c.groupBy("analyst").agg(F.sum("n").alias("pairs"), F.round(wait, 2).alias("mean_wait_s"))


def cross_pair_wallets(spark: SparkSession, d: str) -> DataFrame:
    """Wallets active in two different pairs within 10 minutes, per pair of pairs.

    Of a wallet's trades in a pair and ten minutes only the first and the last
    count: in one slot all are near, in the next one the last meets the first.
    """
    size = 600_000_000
    t = micros("ts")
    slots = wallet_rows(spark, d).groupBy("wallet", "pair_key", F.floor(t / F.lit(size)).alias("slot")).agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    slots = durable(slots, "wallet-slots")
    other = slots.select(
        "wallet", F.col("pair_key").alias("pair_b"), F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot"),
        F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"),
    )
    met = slots.join(other, ["wallet", "slot"]).filter((F.col("pair_key") < F.col("pair_b")) & (F.col("lo_b") - F.col("hi") <= size) & (F.col("lo") - F.col("hi_b") <= size))
    return met.groupBy("pair_key", "pair_b").agg(F.countDistinct("wallet").alias("wallets"))


def burst_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Per wallet the share of trades that have another pair's trade of the wallet within 10 minutes."""
    rows = wallet_rows(spark, d).select("wallet", "pair_key", "ts", "trade_id")
    other = rows.select("wallet", F.col("pair_key").alias("pair_b"), F.col("ts").alias("ts_b")).distinct()
    near = band_join(rows, other, ["wallet"], "ts", "ts_b", 600, how="left_semi", also=F.col("pair_key") != F.col("pair_b"))
    hits = near.groupBy("wallet").agg(F.count(F.lit(1)).alias("k"))
    return rows.groupBy("wallet").agg(F.count(F.lit(1)).alias("n")).join(hits, "wallet", "left").select(
        "wallet", F.round(F.coalesce(F.col("k") / F.col("n"), F.lit(0.0)), 9).alias("overlap")
    )


def bridge_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Per EVM wallet the share of inbound transfers with an outbound one within 24 hours."""
    t = transfers(spark, d)
    came = t.filter("direction = 'evm_to_stellar'").select("evm", "transfer_id", "ts")
    went = t.filter("direction = 'stellar_to_evm'").select("evm", F.col("ts").alias("ts_out"))
    back = band_join(came, went, ["evm"], "ts", "ts_out", 86_400, how="left_semi").groupBy("evm").agg(F.count(F.lit(1)).alias("k"))
    return came.groupBy("evm").agg(F.count(F.lit(1)).alias("n")).join(back, "evm", "left").select(
        "evm", "n", F.round(F.coalesce(F.col("k") / F.col("n"), F.lit(0.0)), 9).alias("frequency")
    )


def bridge_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Ordered round trips per EVM wallet: out, then back within 24 h with at least 95 % of the amount; scored."""
    t = _moved(spark, d).filter("usd > 0")
    out = t.filter("direction = 'stellar_to_evm'").select("evm", F.col("ts").alias("t0"), F.col("usd").alias("u0"))
    back = t.filter("direction = 'evm_to_stellar'").select("evm", F.col("ts").alias("t1"), F.col("usd").alias("u1"))
    r = F.least("u0", "u1") / F.greatest("u0", "u1")
    m = band_join(out, back, ["evm"], "t0", "t1", 86_400, also=F.col("t1") >= F.col("t0")).withColumn("r", r).filter("r >= 0.95")
    gap = F.timestamp_diff("MICROSECOND", F.col("t0"), F.col("t1")) / F.lit(86_400e6)
    s = m.withColumn("s", 0.5 * F.col("r") + 0.3 * (1 - gap) + 0.2 / 2)
    agg = s.groupBy("evm").agg(F.max("s").alias("best"), F.count(F.lit(1)).alias("n"))
    bonus = F.least(F.lit(0.3), 0.05 * (F.col("n") - 1))
    return agg.select("evm", "n", F.round(F.least(F.lit(1.0), F.col("best") + bonus), 8).alias("score"))


#: Planted transfers that stand beside the given ones in the link queries, as a round trip is rare in small tables:
#: transfer, id, direction, EVM wallet, account, USD, minutes after 2027-01-01.
PLANTED = [
    ("planted-1", -1, "stellar_to_evm", "0xplanted", "GPLANTED", 1000.0, 0), ("planted-2", -2, "evm_to_stellar", "0xplanted", "GPLANTED", 998.0, 3),
    ("planted-3", -3, "stellar_to_evm", "0xplanted", "GPLANTED", 500.0, 600), ("planted-4", -4, "evm_to_stellar", "0xplanted", "GPLANTED", 499.0, 640),
    ("planted-5", -5, "stellar_to_evm", "0xother", "GPLANTED", 70.0, 900), ("planted-6", -6, "evm_to_stellar", "0xother", "GPLANTED", 10.0, 2000),
]
_PLANTED_SQL = f"""{TRANSFERS_SQL}, moved AS (SELECT transfer_id, id, direction, evm, wallet, usd, ts FROM transfers UNION ALL
SELECT t, i, d, e, w, u::DOUBLE, TIMESTAMP '2027-01-01' + to_minutes(m) FROM (VALUES {', '.join(map(str, PLANTED))}) v(t, i, d, e, w, u, m))"""


def _moved(spark: SparkSession, d: str) -> DataFrame:
    """Transfers with the planted ones."""
    p = spark.createDataFrame(PLANTED, "transfer_id string, id long, direction string, evm string, wallet string, usd double, m int")
    p = p.withColumn("ts", F.timestamp_add("MINUTE", F.col("m"), F.lit("2027-01-01 00:00:00").cast("timestamp_ntz")))
    names = ["transfer_id", "id", "direction", "evm", "wallet", "usd", "ts"]
    return transfers(spark, d).select(*names).unionByName(p.select(*names))


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Transfers between an account and an EVM wallet, reported once, with both ends known."""
    return _moved(spark, d).filter("wallet IS NOT NULL AND evm IS NOT NULL")


def opposite_transfers(spark: SparkSession, d: str) -> DataFrame:
    """Per account and EVM wallet: pairs of transfers in opposite directions, pairs with both amounts, least seconds between such two.

    Pairs are counted as a product; the two that are nearest lie next to each
    other in time, so no pair is formed.
    """
    t = _links(spark, d)
    by = Window.partitionBy("wallet", "evm").orderBy("ts", "id")
    gap = F.when(F.lag("direction").over(by) != F.col("direction"), F.timestamp_diff("MICROSECOND", F.lag("ts").over(by), F.col("ts")) / F.lit(1e6))
    out, paid = F.col("direction") == "stellar_to_evm", F.coalesce(F.col("usd") > 0, F.lit(False))
    agg = t.withColumn("gap", gap).groupBy("wallet", "evm").agg(
        (F.count_if(out) * F.count_if(~out)).alias("pairs"), (F.count_if(out & paid) * F.count_if(~out & paid)).alias("amount_pairs"), F.min("gap").alias("least_gap_s"),
    )
    return agg.filter("pairs > 0")


def wallet_link_score(spark: SparkSession, d: str) -> DataFrame:
    """Confidence that an account and an EVM wallet have one owner: product of four likelihood ratios through the logistic function.

    Timing: a Gaussian (300 s) of the least time between opposite transfers over
    an even one of an hour, at least 1e-9; amounts: 10 if two opposite transfers
    differ by at most 0.5 % of the earlier report; direction: 1 + 4 x the share of changes of
    direction; addresses: 1.5 if their last four characters agree. What there is
    nothing for counts 1. Amounts are matched by an equi-join on their logarithm's
    bucket, so only near ones meet.
    """
    t = _links(spark, d)
    by = Window.partitionBy("wallet", "evm").orderBy("ts", "id")
    turn = F.lag("direction").over(by) != F.col("direction")
    gap = F.when(turn, F.timestamp_diff("MICROSECOND", F.lag("ts").over(by), F.col("ts")) / F.lit(1e6))
    agg = t.select("*", turn.alias("turn"), gap.alias("gap")).groupBy("wallet", "evm").agg(F.count(F.lit(1)).alias("n"), F.count_if("turn").alias("turns"), F.min("gap").alias("gap"))
    paid = t.filter("usd > 0").withColumn("b", F.floor(F.log("usd") / math.log(1.01)))
    one = paid.select("wallet", "evm", "b", F.col("id").alias("i"), F.col("direction").alias("di"), F.col("usd").alias("u"))
    two = paid.select("wallet", "evm", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"), F.col("id").alias("j"), F.col("direction").alias("dj"), F.col("usd").alias("v"))
    near = one.join(two, ["wallet", "evm", "b"]).filter((F.col("i") < F.col("j")) & (F.col("di") != F.col("dj")) & (F.abs(F.col("u") - F.col("v")) / F.col("u") <= 0.005))
    agg = agg.join(near.select("wallet", "evm").distinct().withColumn("same", F.lit(True)), ["wallet", "evm"], "left")
    z = F.col("gap") / 300
    timing = F.when(F.col("gap").isNull(), 1.0).otherwise(F.greatest(F.exp(-0.5 * z * z) / (1 / 3600 + 1e-9), F.lit(1e-9)))
    direction = F.when(F.col("n") < 2, 1.0).otherwise(1 + 4 * F.col("turns") / (F.col("n") - 1))
    address = F.when((F.length("wallet") >= 6) & (F.length("evm") >= 6) & (F.lower(F.right("wallet", F.lit(4))) == F.lower(F.right("evm", F.lit(4)))), 1.5).otherwise(1.0)
    odds = timing * F.when(F.col("same"), 10.0).otherwise(1.0) * direction * address
    p = 1 / (1 + F.exp(-F.log(odds)))
    level = F.when(p >= 0.9, "CONFIRMED").when(p >= 0.7, "PROBABLE").otherwise("REJECTED")
    return agg.select("wallet", "evm", "n", F.round(p, 8).alias("confidence"), level.alias("level"))


def accepted_links(spark: SparkSession, d: str) -> DataFrame:
    """All links of confidence 0.7 or more."""
    return wallet_link_score(spark, d).filter("confidence >= 0.7")


def evm_trade_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Per EVM wallet: volume, distinct accounts, concentration of its transfer counts."""
    per = transfers(spark, d).groupBy("evm", "wallet").agg(F.count(F.lit(1)).alias("k"), F.sum("usd").alias("v"))
    return per.groupBy("evm").agg(
        F.round(F.sum("v"), 2).alias("usd"), F.countDistinct("wallet").alias("accounts"),
        F.round(F.sum(F.col("k") * F.col("k")) / (F.sum("k") * F.sum("k")), 9).alias("hhi"),
    )


def idempotent_keys(spark: SparkSession, d: str) -> DataFrame:
    """Identity hash per bridge report and verdict: first report new, later ones duplicate, older than the replay window rejected."""
    key = F.sha2(F.concat_ws("|", F.lit("bridge"), F.lower("transfer_id"), F.lower("tx_hash_evm")), 256)
    rows = table(spark, d, "bridge_transfers").withColumn("key", key)
    by = Window.partitionBy("key").orderBy("id")
    stale = F.col("timestamp") < F.lit("2026-01-15 00:00:00").cast("timestamp_ntz")
    verdict = F.when(stale, "REPLAY_REJECTED").when(F.row_number().over(by) > 1, "DUPLICATE").otherwise("NEW")
    return rows.select(verdict.alias("verdict"), "key").groupBy("verdict").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("key").alias("keys"))


def dedup_statistics(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "ingestion_dedup_keys").select("source", F.lower(stripped(F.col("idempotency_key"))).alias("k"))
    return k.groupBy("source").agg(F.count("k").alias("seen"), F.countDistinct("k").alias("distinct_keys"), F.round(ratio(F.count("k") - F.countDistinct("k"), F.count("k")), 9).alias("duplicate_rate"))


def tier_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Recent and archived scores united; where both hold a wallet, pair and time the recent tier's row stays."""
    s = _scores(spark, d)
    hot = s.filter("id % 3 <> 0").withColumn("tier", F.lit(0))
    cold = s.filter("id % 2 = 0").withColumn("tier", F.lit(1))
    by = Window.partitionBy("wallet", "asset_pair", "timestamp").orderBy("tier", "id")
    u = hot.unionByName(cold).withColumn("r", F.row_number().over(by)).filter("r = 1")
    return u.groupBy("tier").agg(F.count(F.lit(1)).alias("rows"), F.sum("score").alias("score_sum"))


def wallet_intersection(spark: SparkSession, d: str) -> DataFrame:
    r = wallet_rows(spark, d)
    return r.filter("pair_key = 'VUSD/XLM'").select("wallet").intersect(r.filter("pair_key = 'EURV/VUSD'").select("wallet"))


def shared_cluster_size(spark: SparkSession, d: str) -> DataFrame:
    """Per pair: wallets, and how many of them also trade another pair."""
    pairs = wallet_rows(spark, d).select("wallet", "pair_key").distinct()
    n = pairs.groupBy("wallet").agg(F.count(F.lit(1)).alias("k"))
    return pairs.join(n, "wallet").groupBy("pair_key").agg(F.count(F.lit(1)).alias("wallets"), F.count_if(F.expr("k > 1")).alias("shared"))


def distinct_accounts(spark: SparkSession, d: str) -> DataFrame:
    return wallet_rows(spark, d).select("wallet").distinct()


def distinct_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Export partitions: date and pair, with the count and highest token that tell whether one changed."""
    return trades(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "pair_key").agg(F.count(F.lit(1)).alias("rows"), F.max("token").alias("max_token"))


def scored_not_reviewed(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("wallet").distinct().exceptAll(table(spark, d, "label_feedback").select("wallet").distinct())


def audit_trail_union(spark: SparkSession, d: str) -> DataFrame:
    """Events of all kinds per wallet in one tagged list, counted with first and last time."""
    parts = [
        _scores(spark, d).select("wallet", F.lit("score").alias("kind"), F.col("timestamp").alias("at")),
        table(spark, d, "label_feedback").select("wallet", F.lit("label").alias("kind"), F.col("confirmed_at").alias("at")),
        transfers(spark, d).select("wallet", F.lit("transfer").alias("kind"), F.col("ts").alias("at")),
        wallet_rows(spark, d).select("wallet", F.lit("trade").alias("kind"), F.col("ts").alias("at")),
    ]
    u = reduce(DataFrame.unionByName, parts)
    fmt = "yyyy-MM-dd HH:mm:ss"
    return u.filter("wallet IS NOT NULL").groupBy("wallet", "kind").agg(
        F.count(F.lit(1)).alias("events"), F.date_format(F.min("at"), fmt).alias("first"), F.date_format(F.max("at"), fmt).alias("last")
    )


def top_k_page(spark: SparkSession, d: str) -> DataFrame:
    """Third page of twenty: by score, then newest, then id."""
    return _scores(spark, d).orderBy(F.col("score").desc(), F.col("timestamp").desc(), F.col("id").desc()).offset(40).limit(20).select("id", "wallet", "score")


def latest_row_per_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "label_feedback").groupBy("wallet").agg(F.max_by(F.struct("id", "true_label", "ensemble_score"), F.struct("confirmed_at", "id")).alias("x")).select("wallet", "x.*")


def due_queue(spark: SparkSession, d: str) -> DataFrame:
    """Oldest pending work first: keys seen once, before a given time."""
    k = table(spark, d, "ingestion_dedup_keys").select("id", F.lower(stripped(F.col("idempotency_key"))).alias("k"), "first_seen_at").filter("k IS NOT NULL")
    once = k.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("first_seen_at", "id")).alias("m")).filter("n = 1")
    return once.select("m.first_seen_at", "m.id").filter("first_seen_at <= TIMESTAMP_NTZ'2026-03-01 00:00:00'").orderBy("first_seen_at", "id").limit(25).select("id")


def score_export(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a date range from a minimum on, per day and flag pattern."""
    s = _scores(spark, d).filter("timestamp >= TIMESTAMP_NTZ'2026-02-01 00:00:00' AND timestamp < TIMESTAMP_NTZ'2026-04-01 00:00:00' AND score >= 50")
    return s.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "benford_flag", "ml_flag").agg(F.count(F.lit(1)).alias("rows"), F.max("score").alias("top"))


def cosine_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Nearest five vectors of every vector whose id is divisible by 20, by cosine, oneself excluded.

    The stated query set against all rows, in blocks: queries are cut into blocks
    of about 512, rows into chunks of about 4,096; every chunk meets every block
    as one pair of arrays and keeps its best five per query before the merge.
    """
    import numpy as np
    import pyarrow as pa

    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = vectors.filter("vec_id % 20 = 0")
    n_blocks, n_chunks = max(1, -(-asked.count() // 512)), max(1, vectors.count() // 4096)
    part = F.struct("vec_id", "embedding")
    blocks = asked.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("b")).agg(F.collect_list(part).alias("q"))
    chunks = vectors.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n_chunks)).alias("c")).agg(F.collect_list(part).alias("v"))
    pairs = chunks.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(blocks, "b").select("q", "v")

    def unit(items):
        ids = np.array([x["vec_id"] for x in items])
        m = np.array([x["embedding"] for x in items], dtype=np.float64)
        return ids, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def best(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, asked_rows = unit(batch.column("q")[row].as_py())
                vid, rows = unit(batch.column("v")[row].as_py())
                sim = asked_rows @ rows.T
                sim[ids[:, None] == vid[None, :]] = -2
                for i in range(len(ids)):
                    top = np.lexsort((vid, -sim[i]))[:5]
                    top = top[sim[i][top] > -2]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(top), ids[i])), pa.array(vid[top]), pa.array(sim[i][top])], names=["query", "vec_id", "cosine"]
                    )

    near = pairs.mapInArrow(best, "query long, vec_id long, cosine double")
    by = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "vec_id")
    return near.withColumn("place", F.row_number().over(by)).filter("place <= 5").select("query", "place", "vec_id", F.round("cosine", 6).alias("cosine"))


def krum_scores(spark: SparkSession, d: str) -> DataFrame:
    """Krum over the ten label centroids: sum of the n-f-2 smallest squared distances (f = 2); the n-f of least score are selected.

    Needs 2f + 2 < n. One row per class and dimension: classes are a handful.
    """
    cells = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    centre = cells.groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    other = centre.toDF("other", "p", "y")
    dist = centre.join(other, "p").filter("label <> other").groupBy("label", "other").agg(F.sum(F.pow(F.col("x") - F.col("y"), 2)).alias("d2"))
    n, f = dist.select("label").distinct().count(), 2
    if 2 * f + 2 >= n:
        raise ValueError(f"{n} vectors can't bear {f} bad ones")
    by = Window.partitionBy("label").orderBy("d2", "other")
    score = dist.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= n - f - 2).groupBy("label").agg(F.round(F.sum("d2"), 8).alias("krum"))
    return score.withColumn("selected", F.row_number().over(Window.orderBy("krum", "label")) <= n - f)


def paging_token_order(spark: SparkSession, d: str) -> DataFrame:
    """Tokens split into ledger and operation; highest per day by number, not by text."""
    part = F.split("token", "-")
    t = trades(spark, d).filter("token IS NOT NULL").select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), "token", F.coalesce(part[0].try_cast("long"), F.lit(0)).alias("ledger"), F.coalesce(F.get(part, F.lit(1)).try_cast("int"), F.lit(0)).alias("op")
    )
    return t.groupBy("day").agg(F.max(F.struct("ledger", "op")).alias("m"), F.count(F.lit(1)).alias("rows")).select("day", "m.ledger", "m.op", "rows")


def counterparty_hash(spark: SparkSession, d: str) -> DataFrame:
    """First 32 bits of the account's SHA-256 as a number, counted per low byte."""
    h = F.conv(F.substring(F.sha2("wallet", 256), 1, 8), 16, 10).cast("long")
    return distinct_accounts(spark, d).select((h % 16).alias("bucket"), h.alias("h")).groupBy("bucket").agg(F.count(F.lit(1)).alias("accounts"), F.max("h").alias("top"))


def raw_trade_parse(spark: SparkSession, d: str) -> DataFrame:
    """Landed JSON parsed with a declared schema: code default, price from n/d, unusable lines apart."""
    schema = "id string, base_account string, base_asset_code string, price struct<n:long,d:long>, base_amount string"
    raw = table(spark, d, "horizon_trade_raw").select("feed", F.try_parse_json("payload").alias("v"), "payload")
    p = raw.select("feed", F.col("v").isNotNull().alias("ok"), F.from_json("payload", schema).alias("j"))
    return p.groupBy("feed").agg(
        F.count_if("ok").alias("parsed"), F.count_if(~F.col("ok")).alias("unusable"),
        F.count_if(F.col("ok") & F.coalesce("j.base_asset_code", F.lit("XLM")).isNotNull() & F.col("j.base_account").isNull()).alias("no_account"),
    )


def pools_by_volume(spark: SparkSession, d: str) -> DataFrame:
    """Pools that carry at least 1,000 units of volume, with traders."""
    return trades(spark, d).filter("pool IS NOT NULL").groupBy("pool").agg(exact_sum("amount").alias("volume"), F.countDistinct("base").alias("traders")).filter("volume >= 1000")


def export_casts(spark: SparkSession, d: str) -> DataFrame:
    """Export types: decimal(22,7) amounts, issuer default, native/credit type; totals per type."""
    t = table(spark, d, "horizon_trade").select(
        F.when(F.col("base_asset_issuer").isNull(), "native").otherwise("credit").alias("asset_type"),
        amount(F.col("base_amount")).cast("decimal(22,7)").alias("amount"), F.coalesce("base_asset_issuer", F.lit("")).alias("issuer"),
    )
    return t.groupBy("asset_type").agg(F.sum("amount").cast("double").alias("amount"), F.countDistinct("issuer").alias("issuers"))


def asset_risk_ranking(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("wallet", "asset_pair").orderBy(F.col("timestamp").desc(), F.col("id").desc())
    last = _scores(spark, d).withColumn("r", F.row_number().over(by)).filter("r = 1")
    return last.groupBy("asset_pair").agg(F.round(F.avg("score"), 4).alias("mean_score"), F.count(F.lit(1)).alias("wallets"))


def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    end = F.lit(AS_OF).cast("timestamp_ntz")
    s = _scores(spark, d)
    return s.select(F.explode(F.array(F.lit(24), F.lit(168), F.lit(720))).alias("hours"), "wallet", "timestamp").filter(
        (F.col("timestamp") > F.timestamp_add("HOUR", -F.col("hours"), end)) & (F.col("timestamp") <= end)
    ).groupBy("hours").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("wallet").alias("wallets"))


def quota_counters(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "ingestion_dedup_keys")
    return k.groupBy("source", F.date_format("first_seen_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("calls"), F.countDistinct(F.to_date("first_seen_at")).alias("days"))


def override_scores(spark: SparkSession, d: str) -> DataFrame:
    """Latest score per wallet with its override: labelled 0 by anyone allows (0), labelled 1 by three or more denies (100)."""
    f = table(spark, d, "label_feedback").groupBy("wallet").agg(F.count_if(F.expr("true_label = 0")).alias("c0"), F.count_if(F.expr("true_label = 1")).alias("c1"))
    s = _scores(spark, d).groupBy("wallet").agg(F.max_by("score", F.struct("timestamp", "id")).alias("score"))
    final = F.when(F.coalesce("c1", F.lit(0)) >= 3, 100).when(F.coalesce("c0", F.lit(0)) >= 1, 0).otherwise(F.col("score"))
    return s.join(f, "wallet", "left").select("wallet", "score", final.alias("final_score"))


QUERIES = {
    f.__name__: f
    for f in (
        filter_pipeline_reasons, accepted_rejected, validation_errors, identifier_checks, asset_types, suppressed_alerts,
        json_predicate, subscriber_match, latest_scores, latest_by_id, latest_batch,
        active_assignment_left_join, proximity_join, analyst_queue, unassigned_anti, not_in_anti, fan_out_semi, claim_times,
        cross_pair_wallets, burst_overlap, bridge_round_trip, bridge_correlation, opposite_transfers, wallet_link_score,
        accepted_links, evm_trade_pattern, idempotent_keys, dedup_statistics, tier_union_dedup, wallet_intersection,
        shared_cluster_size, distinct_accounts, distinct_partitions, scored_not_reviewed, audit_trail_union, top_k_page,
        latest_row_per_key, due_queue, score_export, cosine_top_k, krum_scores, paging_token_order, counterparty_hash,
        raw_trade_parse, pools_by_volume, export_casts, asset_risk_ranking, audit_summary, quota_counters, override_scores,
    )
}

_B = r"E' \t\n\r\f'"
_AMT = f"CASE WHEN regexp_matches(trim(base_amount, {_B}), '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(trim(base_amount, {_B}) AS DECIMAL(38,18)) END"
_LINK = f"""WITH {_PLANTED_SQL}, l AS (SELECT * FROM moved WHERE wallet IS NOT NULL AND evm IS NOT NULL),
pr AS (SELECT a.wallet, a.evm, min(abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1e6) AS gap, bool_or(a.usd > 0 AND b.usd > 0 AND abs(a.usd - b.usd) / a.usd <= 0.005) AS same
  FROM l a JOIN l b ON a.wallet = b.wallet AND a.evm = b.evm AND a.id < b.id AND a.direction <> b.direction GROUP BY ALL),
tr AS (SELECT wallet, evm, (direction <> lag(direction) OVER (PARTITION BY wallet, evm ORDER BY ts, id))::INT AS turn FROM l),
g AS (SELECT wallet, evm, count(*) AS n, coalesce(sum(turn), 0) AS turns FROM tr GROUP BY ALL),
o AS (SELECT g.wallet, g.evm, n, (CASE WHEN gap IS NULL THEN 1.0 ELSE greatest(exp(-0.5 * pow(gap / 300, 2)) / (1.0::DOUBLE / 3600 + 1e-9), 1e-9) END)
  * (CASE WHEN same THEN 10.0 ELSE 1.0 END) * (CASE WHEN n < 2 THEN 1.0 ELSE 1 + 4 * turns / (n - 1) END)
  * (CASE WHEN length(g.wallet) >= 6 AND length(g.evm) >= 6 AND lower(right(g.wallet, 4)) = lower(right(g.evm, 4)) THEN 1.5 ELSE 1.0 END) AS odds
  FROM g LEFT JOIN pr ON pr.wallet = g.wallet AND pr.evm = g.evm),
p AS (SELECT *, 1 / (1 + exp(-ln(odds))) AS p FROM o),
link AS (SELECT wallet, evm, n, round(p, 8) AS confidence, CASE WHEN p >= 0.9 THEN 'CONFIRMED' WHEN p >= 0.7 THEN 'PROBABLE' ELSE 'REJECTED' END AS level FROM p)"""

ORACLE = {
    "filter_pipeline_reasons": f"""WITH {TRADES_SQL}, k AS (SELECT *, CASE WHEN base_code = 'XLM' THEN 'native' WHEN length(base_code) <= 4 THEN 'alphanum4' ELSE 'alphanum12' END AS bk,
  CASE WHEN counter_code = 'XLM' THEN 'native' WHEN length(counter_code) <= 4 THEN 'alphanum4' ELSE 'alphanum12' END AS ck FROM trades),
x AS (SELECT account FROM account_metadata WHERE created_at IS NULL)
SELECT CASE WHEN pair IN ('EURV/XLM', 'AQUR/XLM') THEN 'pair_blacklist' WHEN amount < 5 OR coalesce(counter_amount < 1, FALSE) OR coalesce(price < 0, FALSE) THEN 'min_volume'
  WHEN bk = 'alphanum12' OR ck = 'alphanum12' THEN 'asset_type' WHEN base IN (FROM x) OR coalesce(counter IN (FROM x), FALSE) THEN 'excluded_account' ELSE 'accepted' END AS reason, count(*) AS trades
FROM k GROUP BY 1""",
    "accepted_rejected": f"""WITH {TRADES_SQL}, r AS (SELECT pair_key, amount < 5 OR coalesce(base = counter, FALSE) AS bad FROM trades)
SELECT pair_key, count(*) FILTER (NOT bad) AS accepted, count(*) FILTER (bad) AS rejected FROM r GROUP BY 1""",
    "validation_errors": f"""WITH e AS (SELECT base_account IS NULL AS e1, ledger_close_time IS NULL AS e2, NOT coalesce({_AMT} > 0, FALSE) AS e3,
  coalesce(base_asset_type <> 'native' AND base_asset_issuer IS NULL, FALSE) AS e4,
  coalesce(lower(trim(trade_type, {_B})) IN ('liquidity_pool', '2') AND liquidity_pool_id IS NULL, FALSE) AS e5, nullif(trim(paging_token, {_B}), '') IS NULL AS e6 FROM horizon_trade)
SELECT * FROM (SELECT 'base_account' AS error, count(*) AS rows FROM e WHERE e1 UNION ALL SELECT 'ledger_close_time', count(*) FROM e WHERE e2
UNION ALL SELECT 'base_amount', count(*) FROM e WHERE e3 UNION ALL SELECT 'issuer', count(*) FROM e WHERE e4 UNION ALL SELECT 'pool_id', count(*) FROM e WHERE e5
UNION ALL SELECT 'paging_token', count(*) FROM e WHERE e6 UNION ALL SELECT 'valid', count(*) FROM e WHERE NOT (e1 OR e2 OR e3 OR e4 OR e5 OR e6)) WHERE rows > 0""",
    "identifier_checks": """SELECT direction, count(*) FILTER (regexp_matches(evm_wallet, '^0x[0-9a-fA-F]{40}$')) AS evm_ok,
  count(*) FILTER (regexp_matches(stellar_wallet, '^G[A-Z2-7]{55}$')) AS account_ok, count(*) FILTER (regexp_matches(token, '^[A-Za-z0-9]{1,12}$')) AS token_ok, count(*) AS rows
FROM bridge_transfers GROUP BY 1""",
    "asset_types": """WITH t AS (SELECT DISTINCT concat_ws(':', coalesce(base_asset_code, 'XLM'), base_asset_issuer) AS symbol, base_asset_code AS c, base_asset_issuer AS i FROM horizon_trade)
SELECT symbol, CASE WHEN i IS NULL THEN 'native' WHEN length(c) <= 4 THEN 'alphanum4' ELSE 'alphanum12' END AS kind, upper(regexp_replace(symbol, '[^A-Za-z0-9]', '_', 'g')) AS partition_key,
  regexp_matches(upper(symbol), '^[A-Z0-9/.:\\-]{1,30}$') AS sane FROM t""",
    "suppressed_alerts": f"""WITH {_S}, r AS (SELECT wallet, CASE WHEN ensemble_score < 95 THEN confirmed_at + INTERVAL 30 DAY END AS expires FROM label_feedback WHERE true_label = 0)
SELECT id, wallet, asset_pair, score FROM s WHERE score >= 90 AND NOT EXISTS (
  SELECT 1 FROM r WHERE r.wallet = s.wallet AND (expires IS NULL OR expires > TIMESTAMP '{AS_OF}'))""",
    "json_predicate": """WITH k AS (SELECT source, TRY_CAST(json_extract_string(metadata_json, '$.block_number') AS BIGINT) AS h FROM ingestion_dedup_keys)
SELECT source, count(*) AS keys, max(h) AS highest FROM k WHERE h < 9000000 GROUP BY 1""",
    "subscriber_match": f"""WITH {_S}, sub AS (SELECT * FROM (VALUES ('all', 95, NULL), ('majors', 80, ['XLM/VUSD', 'XLM/AQUR']), ('euro', 60, ['EURV/VUSD'])) v(subscriber, m, p))
SELECT subscriber, count(*) AS scores, count(DISTINCT wallet) AS wallets FROM s JOIN sub ON score >= m AND (p IS NULL OR list_contains(p, asset_pair)) GROUP BY 1""",
    "latest_scores": f"""WITH {_S}, m AS (SELECT wallet, asset_pair, max(timestamp) AS t FROM s GROUP BY ALL)
SELECT s.id, s.wallet, s.asset_pair, score, confidence FROM s JOIN m ON s.wallet = m.wallet AND s.asset_pair = m.asset_pair AND s.timestamp = m.t WHERE benford_flag""",
    "latest_by_id": f"WITH {_S} SELECT wallet, asset_pair, max(id) AS id, arg_max(score, id) AS score FROM s GROUP BY 1, 2",
    "latest_batch": "SELECT delivery_id, batch_id FROM horizon_trade WHERE batch_id = (SELECT max(batch_id) FROM horizon_trade)",
    "active_assignment_left_join": f"""WITH {_S}, {CASES_SQL}, h AS (SELECT wallet, asset_pair, string_agg(DISTINCT analyst, ',' ORDER BY analyst) AS analysts FROM cases
  WHERE status = 'assigned' AND lock_expires_at > TIMESTAMP '{AS_OF}' AND asset_pair IS NOT NULL GROUP BY ALL),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wallet, asset_pair ORDER BY timestamp DESC, id DESC) AS rn FROM s) WHERE rn = 1)
SELECT l.wallet, l.asset_pair, id, score, analysts FROM l LEFT JOIN h ON h.wallet = l.wallet AND h.asset_pair = l.asset_pair""",
    "proximity_join": f"""WITH {_S} SELECT s.id AS score_id, v.id AS other_id FROM s LEFT JOIN s v ON v.wallet = s.wallet AND v.asset_pair = s.asset_pair AND v.id <> s.id
AND abs(epoch_us(s.timestamp) - epoch_us(v.timestamp)) < 10000000 WHERE s.timestamp IS NOT NULL""",
    "analyst_queue": f"""WITH {_S} SELECT wallet, max(score) AS score, EXISTS (SELECT 1 FROM label_feedback f WHERE f.wallet = s.wallet AND confirmed_at > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS reviewed
FROM s GROUP BY wallet ORDER BY score DESC, wallet LIMIT 50""",
    "unassigned_anti": f"""WITH {_S} SELECT DISTINCT wallet FROM s WHERE NOT EXISTS (SELECT 1 FROM label_feedback f WHERE f.wallet = s.wallet)
AND NOT EXISTS (SELECT 1 FROM bridge_transfers b WHERE b.stellar_wallet = s.wallet)""",
    "not_in_anti": f"WITH {_S} SELECT account FROM account_metadata WHERE funding_source NOT IN (SELECT wallet FROM s WHERE score >= 95)",
    "fan_out_semi": f"WITH {WALLET_SQL}, {_S} SELECT wallet, count(*) AS trades, CAST(sum(CAST(amount AS DECIMAL(38,8))) AS DOUBLE) AS volume FROM wrows WHERE wallet IN (SELECT wallet FROM s) GROUP BY 1",
    "claim_times": f"""WITH {_S}, {CASES_SQL} SELECT analyst, count(*) AS pairs, round(CAST(sum(CAST(epoch_us(assigned_at) - epoch_us(timestamp) AS HUGEINT)) AS DOUBLE) / count(*) / 1e6, 2) AS mean_wait_s
FROM cases c JOIN s ON s.wallet = c.wallet AND s.asset_pair = c.asset_pair WHERE assigned_at IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1""",
    "cross_pair_wallets": f"""WITH {WALLET_SQL}, r AS (SELECT DISTINCT wallet, pair_key, ts FROM wrows)
SELECT a.pair_key, b.pair_key AS pair_b, count(DISTINCT a.wallet) AS wallets FROM r a JOIN r b ON a.wallet = b.wallet AND a.pair_key < b.pair_key
AND b.ts BETWEEN a.ts - INTERVAL 10 MINUTE AND a.ts + INTERVAL 10 MINUTE GROUP BY 1, 2""",
    "burst_overlap": f"""WITH {WALLET_SQL} SELECT wallet, round(avg((EXISTS (SELECT 1 FROM wrows b WHERE b.wallet = a.wallet AND b.pair_key <> a.pair_key
AND b.ts BETWEEN a.ts - INTERVAL 10 MINUTE AND a.ts + INTERVAL 10 MINUTE))::INT), 9) AS overlap FROM wrows a GROUP BY 1""",
    "bridge_round_trip": f"""WITH {TRANSFERS_SQL} SELECT evm, count(*) AS n, round(avg((EXISTS (SELECT 1 FROM transfers b WHERE b.direction = 'stellar_to_evm' AND b.evm = a.evm
AND b.ts BETWEEN a.ts - INTERVAL 24 HOUR AND a.ts + INTERVAL 24 HOUR))::INT), 9) AS frequency FROM transfers a WHERE direction = 'evm_to_stellar' GROUP BY 1""",
    "bridge_correlation": f"""WITH {_PLANTED_SQL}, m AS (SELECT a.evm, least(a.usd, b.usd) / greatest(a.usd, b.usd) AS r, (epoch_us(b.ts) - epoch_us(a.ts)) / 86400e6 AS gap
FROM moved a JOIN moved b ON a.evm = b.evm AND a.direction = 'stellar_to_evm' AND b.direction = 'evm_to_stellar' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR
WHERE a.usd > 0 AND b.usd > 0),
g AS (SELECT evm, max(0.5*r + 0.3*(1 - gap) + 0.1) AS best, count(*) AS n FROM m WHERE r >= 0.95 GROUP BY 1)
SELECT evm, n, round(least(1.0, best + least(0.3, 0.05*(n - 1))), 8) AS score FROM g""",
    "opposite_transfers": f"""WITH {_PLANTED_SQL}, l AS (SELECT * FROM moved WHERE wallet IS NOT NULL AND evm IS NOT NULL)
SELECT a.wallet, a.evm, count(*) AS pairs, count(*) FILTER (a.usd > 0 AND b.usd > 0) AS amount_pairs, min(abs(epoch_us(b.ts) - epoch_us(a.ts)) / 1e6) AS least_gap_s
FROM l a JOIN l b ON a.wallet = b.wallet AND a.evm = b.evm AND a.direction = 'stellar_to_evm' AND b.direction <> a.direction GROUP BY 1, 2""",
    "wallet_link_score": f"{_LINK} SELECT * FROM link",
    "accepted_links": f"{_LINK} SELECT * FROM link WHERE confidence >= 0.7",
    "evm_trade_pattern": f"""WITH {TRANSFERS_SQL}, p AS (SELECT evm, wallet, count(*) AS k, sum(usd) AS v FROM transfers GROUP BY ALL)
SELECT evm, round(sum(v), 2) AS usd, count(DISTINCT wallet) AS accounts, round(sum(k*k) / (sum(k)*sum(k)), 9) AS hhi FROM p GROUP BY 1""",
    "idempotent_keys": """WITH k AS (SELECT *, sha256(concat_ws('|', 'bridge', lower(transfer_id), lower(tx_hash_evm))) AS key FROM bridge_transfers),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS rn FROM k)
SELECT CASE WHEN timestamp < TIMESTAMP '2026-01-15 00:00:00' THEN 'REPLAY_REJECTED' WHEN rn > 1 THEN 'DUPLICATE' ELSE 'NEW' END AS verdict, count(*) AS rows, count(DISTINCT key) AS keys FROM r GROUP BY 1""",
    "dedup_statistics": f"""WITH k AS (SELECT source, lower(nullif(trim(idempotency_key, {_B}), '')) AS k FROM ingestion_dedup_keys)
SELECT source, count(k) AS seen, count(DISTINCT k) AS distinct_keys, round(coalesce((count(k) - count(DISTINCT k)) / nullif(count(k), 0), 0), 9) AS duplicate_rate FROM k GROUP BY 1""",
    "tier_union_dedup": f"""WITH {_S}, u AS (SELECT *, 0 AS tier FROM s WHERE id % 3 <> 0 UNION ALL SELECT *, 1 FROM s WHERE id % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY wallet, asset_pair, timestamp ORDER BY tier, id) AS rn FROM u)
SELECT tier, count(*) AS rows, CAST(sum(score) AS BIGINT) AS score_sum FROM r WHERE rn = 1 GROUP BY 1""",
    "wallet_intersection": f"WITH {WALLET_SQL} SELECT wallet FROM wrows WHERE pair_key = 'VUSD/XLM' INTERSECT SELECT wallet FROM wrows WHERE pair_key = 'EURV/VUSD'",
    "shared_cluster_size": f"""WITH {WALLET_SQL}, p AS (SELECT DISTINCT wallet, pair_key FROM wrows), n AS (SELECT wallet, count(*) AS k FROM p GROUP BY 1)
SELECT pair_key, count(*) AS wallets, count(*) FILTER (k > 1) AS shared FROM p JOIN n ON n.wallet = p.wallet GROUP BY 1""",
    "distinct_accounts": f"WITH {WALLET_SQL} SELECT DISTINCT wallet FROM wrows",
    "distinct_partitions": f"WITH {TRADES_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, pair_key, count(*) AS rows, max(token) AS max_token FROM trades GROUP BY 1, 2",
    "scored_not_reviewed": f"WITH {_S} SELECT DISTINCT wallet FROM s WHERE wallet NOT IN (SELECT wallet FROM label_feedback WHERE wallet IS NOT NULL)",
    "audit_trail_union": f"""WITH {WALLET_SQL}, {_S}, {TRANSFERS_SQL}, u AS (SELECT wallet, 'score' AS kind, timestamp AS tm FROM s UNION ALL SELECT wallet, 'label', confirmed_at FROM label_feedback
UNION ALL SELECT wallet, 'transfer', ts FROM transfers UNION ALL SELECT wallet, 'trade', ts FROM wrows)
SELECT wallet, kind, count(*) AS events, strftime(min(tm), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(tm), '%Y-%m-%d %H:%M:%S') AS last FROM u WHERE wallet IS NOT NULL GROUP BY 1, 2""",
    "top_k_page": f"WITH {_S} SELECT id, wallet, score FROM s ORDER BY score DESC, timestamp DESC, id DESC LIMIT 20 OFFSET 40",
    "latest_row_per_key": """SELECT wallet, id, true_label, ensemble_score FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY confirmed_at DESC, id DESC) AS rn FROM label_feedback) WHERE rn = 1""",
    "due_queue": f"""WITH k AS (SELECT id, lower(nullif(trim(idempotency_key, {_B}), '')) AS k, first_seen_at FROM ingestion_dedup_keys),
o AS (SELECT k, count(*) AS n, min(first_seen_at) AS t, min(id) AS id FROM k WHERE k IS NOT NULL GROUP BY 1)
SELECT id FROM o WHERE n = 1 AND t <= TIMESTAMP '2026-03-01 00:00:00' ORDER BY t, id LIMIT 25""",
    "score_export": f"""WITH {_S} SELECT strftime(timestamp, '%Y-%m-%d') AS day, benford_flag, ml_flag, count(*) AS rows, max(score) AS top FROM s
WHERE timestamp >= TIMESTAMP '2026-02-01 00:00:00' AND timestamp < TIMESTAMP '2026-04-01 00:00:00' AND score >= 50 GROUP BY 1, 2, 3""",
    "cosine_top_k": """SELECT query, CAST(place AS INT) AS place, vec_id, round(cosine, 6) AS cosine FROM (
SELECT q.vec_id AS query, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS place
FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) WHERE place <= 5""",
    "krum_scores": """WITH c AS (SELECT label, unnest(generate_series(1, 64)) AS p, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, p, avg(x::DOUBLE) AS x FROM c GROUP BY ALL),
dd AS (SELECT a.label, b.label AS other, sum(pow(a.x - b.x, 2)) AS d2 FROM m a JOIN m b ON a.p = b.p AND a.label <> b.label GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d2, other) AS r FROM dd), n AS (SELECT count(DISTINCT label) AS n FROM embeddings),
k AS (SELECT label, round(sum(d2), 8) AS krum FROM r, n WHERE r <= n - 4 GROUP BY 1)
SELECT label, krum, row_number() OVER (ORDER BY krum, label) <= n - 2 AS selected FROM k, n""",
    "paging_token_order": f"""WITH {TRADES_SQL}, t AS (SELECT strftime(ts, '%Y-%m-%d') AS day, coalesce(TRY_CAST(split_part(token, '-', 1) AS BIGINT), 0) AS ledger, coalesce(TRY_CAST(split_part(token, '-', 2) AS INT), 0) AS op FROM trades WHERE token IS NOT NULL),
r AS (SELECT *, count(*) OVER (PARTITION BY day) AS rows, row_number() OVER (PARTITION BY day ORDER BY ledger DESC, op DESC) AS rn FROM t)
SELECT day, ledger, op, rows FROM r WHERE rn = 1""",
    "counterparty_hash": f"""WITH {WALLET_SQL}, h AS (SELECT CAST('0x' || substr(sha256(wallet), 1, 8) AS BIGINT) AS h FROM (SELECT DISTINCT wallet FROM wrows))
SELECT h % 16 AS bucket, count(*) AS accounts, max(h) AS top FROM h GROUP BY 1""",
    "raw_trade_parse": """SELECT feed, count(*) FILTER (json_valid(payload)) AS parsed, count(*) FILTER (NOT json_valid(payload)) AS unusable,
  count(*) FILTER (CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.base_account') IS NULL ELSE FALSE END) AS no_account FROM horizon_trade_raw GROUP BY 1""",
    "pools_by_volume": f"WITH {TRADES_SQL} SELECT pool, CAST(sum(CAST(amount AS DECIMAL(38,8))) AS DOUBLE) AS volume, count(DISTINCT base) AS traders FROM trades WHERE pool IS NOT NULL GROUP BY 1 HAVING sum(amount) >= 1000",
    "export_casts": f"""SELECT CASE WHEN base_asset_issuer IS NULL THEN 'native' ELSE 'credit' END AS asset_type, CAST(sum(CAST({_AMT} AS DECIMAL(22,7))) AS DOUBLE) AS amount,
  count(DISTINCT coalesce(base_asset_issuer, '')) AS issuers FROM horizon_trade GROUP BY 1""",
    "asset_risk_ranking": f"""WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY wallet, asset_pair ORDER BY timestamp DESC, id DESC) AS rn FROM s)
SELECT asset_pair, round(avg(score), 4) AS mean_score, count(*) AS wallets FROM r WHERE rn = 1 GROUP BY 1""",
    "audit_summary": f"""WITH {_S}, h AS (SELECT unnest([24, 168, 720]) AS hours)
SELECT hours, count(*) AS events, count(DISTINCT wallet) AS wallets FROM s JOIN h ON timestamp > TIMESTAMP '{AS_OF}' - to_hours(hours) AND timestamp <= TIMESTAMP '{AS_OF}' GROUP BY 1""",
    "quota_counters": "SELECT source, strftime(first_seen_at, '%Y-%m') AS month, count(*) AS calls, count(DISTINCT CAST(first_seen_at AS DATE)) AS days FROM ingestion_dedup_keys GROUP BY 1, 2",
    "override_scores": f"""WITH {_S}, f AS (SELECT wallet, count(*) FILTER (true_label = 0) AS c0, count(*) FILTER (true_label = 1) AS c1 FROM label_feedback GROUP BY 1),
l AS (SELECT wallet, score FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY timestamp DESC, id DESC) AS rn FROM s) WHERE rn = 1)
SELECT l.wallet, score, CASE WHEN coalesce(c1, 0) >= 3 THEN 100 WHEN coalesce(c0, 0) >= 1 THEN 0 ELSE score END AS final_score FROM l LEFT JOIN f USING (wallet)""",
}
