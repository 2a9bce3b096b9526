"""Per-wallet trade, timing, volume and evasion features.

Every family is an aggregate or window over the wallet rows; families are
hash-partitioned by wallet alike, so assembling them needs no further shuffle of
trades.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike.functions import benford as b
from marlspike.functions.stats import clip, exact_sum, ratio, safe_corr
from marlspike.operators.neighbours import with_neighbours
from marlspike.operators.quantiles import exact_quantiles
from marlspike.queries.views import ACTIVITY_SQL, AS_OF, TRADES_SQL, WALLET_SQL, activity, trades, wallet_rows
from marlspike.sources.tables import table


def _seconds(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1e6)


def _rows(spark: SparkSession, d: str, rows: DataFrame | None) -> DataFrame:
    """The wallet rows, or those a caller has at hand for several families."""
    return wallet_rows(spark, d) if rows is None else rows


def counterparty_concentration(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """Largest counterparty's share of a wallet's volume."""
    per = _rows(spark, d, rows).groupBy("wallet", "cp").agg(F.sum("amount").alias("v"))
    named = per.groupBy("wallet").agg(F.max(F.when(F.col("cp").isNotNull(), F.col("v"))).alias("top"), F.sum("v").alias("all"))
    return named.select("wallet", F.round(ratio(F.col("top"), F.col("all")), 8).alias("concentration"))


def volume_per_counterparty(spark: SparkSession, d: str) -> DataFrame:
    agg = wallet_rows(spark, d).groupBy("wallet").agg(F.sum("amount").alias("v"), F.countDistinct("cp").alias("k"))
    return agg.select("wallet", F.round(ratio(F.col("v"), F.col("k")), 4).alias("volume_per_counterparty"))


def self_matching(spark: SparkSession, d: str) -> DataFrame:
    """Share of trades with oneself, per wallet and over all trades (wallet null)."""
    same = F.coalesce((F.col("base") == F.col("counter")).cast("double"), F.lit(0.0))
    per = wallet_rows(spark, d).groupBy("wallet").agg(F.round(F.avg(same), 9).alias("rate"))
    whole = trades(spark, d).agg(F.round(F.avg(same), 9).alias("rate")).select(F.lit(None).cast("string").alias("wallet"), "rate")
    return per.unionAll(whole)


def cancellation_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of a user's events that are errors (the activity view's cancellations)."""
    return activity(spark, d).groupBy("wallet").agg(F.round(F.avg((F.col("pair") == "error").cast("double")), 9).alias("rate"))


def intra_minute_clustering(spark: SparkSession, d: str) -> DataFrame:
    minutes = wallet_rows(spark, d).groupBy("wallet", F.date_trunc("minute", "ts").alias("m")).agg(F.count(F.lit(1)).alias("c"))
    return minutes.groupBy("wallet").agg(
        F.round(F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c"), 9).alias("clustering")
    )


def off_hours_ratio(spark: SparkSession, d: str) -> DataFrame:
    return wallet_rows(spark, d).groupBy("wallet").agg(F.round(F.avg(F.hour("ts").between(0, 5).cast("double")), 9).alias("off_hours"))


def volume_spike_batch(spark: SparkSession, d: str) -> DataFrame:
    """Share of hours, empty ones included, above mean + 2 sample deviations (wallet's span of activity)."""
    hours = activity(spark, d).groupBy("wallet", F.date_trunc("hour", "ts").alias("h")).agg(F.sum("amount").alias("v"))
    per = hours.groupBy("wallet").agg(
        F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"),
        (F.timestamp_diff("HOUR", F.min("h"), F.max("h")) + 1).alias("n"),
    )
    # empty hours add nothing to the sums: no spine of hours is laid out
    mean, n = F.col("s") / F.col("n"), F.col("n")
    var = F.when(n > 1, F.greatest(F.lit(0.0), (F.col("q") - n * mean * mean) / (n - 1)))
    limits = per.select("wallet", "n", (mean + 2 * F.sqrt(var)).alias("limit"))
    return hours.join(limits, "wallet").groupBy("wallet").agg(
        F.round(F.coalesce(F.count_if(F.col("v") > F.col("limit")) / F.max("n"), F.lit(0.0)), 9).alias("spikes")
    )


def volume_spike_stream(spark: SparkSession, d: str) -> DataFrame:
    """Share of active hours above mean + 2 population deviations."""
    hours = activity(spark, d).groupBy("wallet", F.date_trunc("hour", "ts").alias("h")).agg(F.sum("amount").alias("v"))
    by = Window.partitionBy("wallet")
    marked = hours.select("wallet", "v", (F.avg("v").over(by) + 2 * F.stddev_pop("v").over(by)).alias("limit"))
    return marked.groupBy("wallet").agg(F.round(F.avg((F.col("v") > F.col("limit")).cast("double")), 9).alias("spikes"))


def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    """Distinct counterparties (oneself not counted) over all other accounts."""
    rows = wallet_rows(spark, d)
    accounts = rows.agg(F.countDistinct("wallet").alias("all"))
    per = rows.groupBy("wallet").agg(F.countDistinct(F.when(F.col("cp") != F.col("wallet"), F.col("cp"))).alias("k"))
    # one row
    return per.join(F.broadcast(accounts)).select("wallet", F.round(ratio(F.col("k"), F.col("all") - 1), 10).alias("centrality"))


def hhi_concentration(spark: SparkSession, d: str) -> DataFrame:
    """Sum of squared shares of accounts in each pool's volume."""
    per = trades(spark, d).filter("pool IS NOT NULL").groupBy("pool", "base").agg(F.sum("amount").alias("v"))
    return per.groupBy("pool").agg(
        F.round(F.sum(F.col("v") * F.col("v")) / (F.sum("v") * F.sum("v")), 9).alias("hhi"), F.count(F.lit(1)).alias("accounts")
    )


def pool_trade_ratio(spark: SparkSession, d: str) -> DataFrame:
    agg = wallet_rows(spark, d).groupBy("wallet").agg(
        F.sum(F.when(F.col("kind") == "liquidity_pool", F.col("amount")).otherwise(0.0)).alias("p"), F.sum("amount").alias("v")
    )
    return agg.select("wallet", F.round(ratio(F.col("p"), F.col("v")), 8).alias("pool_ratio"))


def path_payment_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Operations with several hops: share among a wallet's trades, mean hops, share that returns to its asset."""
    hops = trades(spark, d).groupBy("op").agg(
        F.count(F.lit(1)).alias("hops"), F.min("base").alias("wallet"),
        F.min_by("base_code", F.struct("token", "trade_id")).alias("first"), F.max_by("counter_code", F.struct("token", "trade_id")).alias("last"),
    )
    many = F.col("hops") > 1
    return hops.groupBy("wallet").agg(
        F.round(F.sum(F.when(many, F.col("hops")).otherwise(0)) / F.sum("hops"), 9).alias("path_share"),
        F.round(F.avg(F.col("hops").cast("double")), 9).alias("mean_hops"),
        F.round(F.coalesce(F.avg(F.when(many, (F.col("first") == F.col("last")).cast("double"))), F.lit(0.0)), 9).alias("returns"),
    )


def funding_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Share of a wallet's counterparties that have its funding source; unknown gives 0."""
    known = table(spark, d, "account_metadata").select("account", "funding_source")
    pairs = wallet_rows(spark, d).filter("cp IS NOT NULL AND cp <> wallet").select("wallet", "cp").distinct()
    joined = pairs.join(known.toDF("wallet", "f1"), "wallet", "left").join(known.toDF("cp", "f2"), "cp", "left")
    return joined.groupBy("wallet").agg(
        F.round(F.avg(F.coalesce((F.col("f1") == F.col("f2")).cast("double"), F.lit(0.0))), 9).alias("similarity")
    )


def account_age(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """Days between an account's creation and its last trade; unknown accounts have 0."""
    last = _rows(spark, d, rows).groupBy("wallet").agg(F.max("ts").alias("last"))
    known = table(spark, d, "account_metadata").select(F.col("account").alias("wallet"), "created_at")
    return last.join(known, "wallet", "left").select(
        "wallet", F.coalesce(F.greatest(_seconds(F.col("last"), F.col("created_at")) / 86400, F.lit(0.0)), F.lit(0.0)).alias("age_days")
    )


def round_trip_frequency(spark: SparkSession, d: str, rows: DataFrame | None = None, ahead: int = 5) -> DataFrame:
    """Share of a wallet's trades undone by one of its next five (gives back what was got)."""
    side = F.col("base") == F.col("wallet")
    rows = _rows(spark, d, rows).select(
        "wallet", "ts", "trade_id",
        F.when(side, F.col("base_code")).otherwise(F.col("counter_code")).alias("gave"),
        F.when(side, F.col("counter_code")).otherwise(F.col("base_code")).alias("got"),
    )
    cut, by = _near(rows, 0, ahead)
    following = F.collect_list(F.struct("gave", "got")).over(by.rowsBetween(1, ahead))
    undone = F.exists(following, lambda x: (x["gave"] == F.col("got")) & (x["got"] == F.col("gave")))
    own = cut.withColumn("u", undone).filter("__own")
    return own.groupBy("wallet").agg(
        F.round(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.avg(F.col("u").cast("double"))), 9).alias("round_trips")
    )


def pool_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Share of an account's pool trades followed within an hour by one of the other side in the same pool and pair."""
    rows = trades(spark, d).filter("pool IS NOT NULL").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    by = Window.partitionBy("pool", "base", "pair_key").orderBy("s").rangeBetween(0, 3_600_000_000)
    other = F.when(
        F.col("base_is_seller"), F.count_if(~F.col("base_is_seller")).over(by)
    ).otherwise(F.count_if(F.col("base_is_seller")).over(by))
    return rows.withColumn("o", other).groupBy("pool", "base").agg(F.round(F.avg((F.col("o") > 0).cast("double")), 9).alias("ratio"))


def _near(rows: DataFrame, back: int, ahead: int) -> tuple[DataFrame, Window]:
    """The wallet rows cut into weeks with their neighbours, and the window that orders them."""
    cut = with_neighbours(rows, ["wallet"], ["ts", "trade_id"], F.date_trunc("week", "ts"), back, ahead)
    return cut, Window.partitionBy("wallet", "__chunk").orderBy("ts", "trade_id")


def _gaps(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """wallet with gap, the gap before, and the same for differences of gaps."""
    cut, by = _near(_rows(spark, d, rows).select("wallet", "ts", "trade_id"), 3, 0)
    rows = cut.withColumn("gap", _seconds(F.col("ts"), F.lag("ts").over(by)))
    out = rows.withColumn("before", F.lag("gap").over(by)).withColumn("jump", F.col("gap") - F.col("before")).withColumn(
        "jump_before", F.lag("jump").over(by)
    )
    return out.filter("__own")


def interval_autocorr(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """Lag-1 autocorrelation of gaps between trades, mapped to 0..1; constant gaps give 1, few trades 0."""
    both = F.col("before").isNotNull()
    agg = _gaps(spark, d, rows).groupBy("wallet").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("gap").alias("sd"),
        safe_corr(F.when(both, F.col("gap")), F.when(both, F.col("before"))).alias("r"),
    )
    score = F.when(F.col("n") < 4, 0.0).when(F.col("sd") <= 1e-12, 1.0).otherwise(clip((F.coalesce("r", F.lit(0.0)) + 1) / 2, 0.0, 1.0))
    return agg.select("wallet", F.round(score, 6).alias("regularity"))


def jitter_autocorr(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    both = F.col("jump_before").isNotNull()
    agg = _gaps(spark, d, rows).groupBy("wallet").agg(
        F.count(F.lit(1)).alias("n"), safe_corr(F.when(both, F.col("jump")), F.when(both, F.col("jump_before"))).alias("r")
    )
    return agg.select("wallet", F.round(F.when(F.col("n") < 5, 0.0).otherwise(F.coalesce("r", F.lit(0.0))), 6).alias("jitter"))


def counterparty_rotation(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    return _rows(spark, d, rows).groupBy("wallet").agg(F.round(F.countDistinct("cp") / F.count(F.lit(1)), 9).alias("rotation"))


def decoy_signature(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """Share of neighbouring trades that go from the lowest to the highest quarter of the wallet's amounts."""
    rows = _rows(spark, d, rows)
    quarters = exact_quantiles(rows, "wallet", "amount", {"low": 0.25, "high": 0.75})
    cut, by = _near(rows.select("wallet", "ts", "trade_id", "amount"), 0, 1)
    steps = cut.select("wallet", "amount", "__own", F.lead("amount").over(by).alias("next")).filter("__own AND next IS NOT NULL")
    low, high = F.col("low"), F.col("high")
    hit = (F.col("amount") <= low) & (F.col("next") >= high) & (low < high)
    hits = steps.join(quarters, "wallet").groupBy("wallet").agg(F.round(F.count_if(hit) / (F.max("n") - 1), 9).alias("decoys"))
    return quarters.select("wallet").join(hits, "wallet", "left").select("wallet", F.coalesce("decoys", F.lit(0.0)).alias("decoys"))


def iat_cv(spark: SparkSession, d: str) -> DataFrame:
    """Variation of gaps between trades; fewer than two gaps give 1."""
    agg = _gaps(spark, d).groupBy("wallet").agg(F.count("gap").alias("k"), F.stddev_pop("gap").alias("sd"), F.avg("gap").alias("m"))
    return agg.select("wallet", F.round(F.when(F.col("k") < 2, 1.0).otherwise(F.col("sd") / (F.col("m") + 1e-9)), 6).alias("cv"))


def burst_synchrony(spark: SparkSession, d: str) -> DataFrame:
    """Mean positive correlation of hourly event counts over pairs of event types, empty hours included.

    From sums, squares and products of the counts: hours without events add
    nothing, so the dense grid is never made.
    """
    rows = activity(spark, d)
    span = rows.agg((F.timestamp_diff("HOUR", F.date_trunc("hour", F.min("ts")), F.date_trunc("hour", F.max("ts"))) + 1).alias("n"))
    hours = rows.groupBy("pair", F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    one = hours.groupBy("pair").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    both = hours.toDF("p1", "h", "c1").join(hours.toDF("p2", "h", "c2"), "h").filter("p1 < p2").groupBy("p1", "p2").agg(
        F.sum(F.col("c1") * F.col("c2")).alias("xy")
    )
    names = one.select(F.col("pair").alias("p1"), F.col("s").alias("s1"), F.col("q").alias("q1"))
    others = one.select(F.col("pair").alias("p2"), F.col("s").alias("s2"), F.col("q").alias("q2"))
    x = both.join(names, "p1").join(others, "p2").join(F.broadcast(span))
    n = F.col("n")
    cov = F.col("xy") / n - (F.col("s1") / n) * (F.col("s2") / n)
    sd = F.sqrt(F.col("q1") / n - F.pow(F.col("s1") / n, 2)) * F.sqrt(F.col("q2") / n - F.pow(F.col("s2") / n, 2))
    r = F.when(sd > 1e-12, F.greatest(cov / sd, F.lit(0.0))).otherwise(0.0)
    return x.select("p1", "p2", F.round(r, 6).alias("synchrony"))


def _ordered_signals(rows: DataFrame) -> DataFrame:
    """The signals of ``evasion_parts`` that need a wallet's trades in order, with their number."""
    side = F.col("base") == F.col("wallet")
    legs = rows.select(
        "wallet", "ts", "trade_id", "amount", F.when(side, F.col("base_code")).otherwise(F.col("counter_code")).alias("gave"), F.when(side, F.col("counter_code")).otherwise(F.col("base_code")).alias("got"),
    )
    cut, by = _near(legs, 3, 5)
    gaps = cut.withColumn("gap", _seconds(F.col("ts"), F.lag("ts").over(by))).withColumn("before", F.lag("gap").over(by)).withColumn("jump", F.col("gap") - F.col("before"))
    following = F.collect_list(F.struct("gave", "got")).over(by.rowsBetween(1, 5))
    undone = F.exists(following, lambda x: (x["gave"] == F.col("got")) & (x["got"] == F.col("gave")))
    seen = gaps.select("*", F.lag("jump").over(by).alias("jump_before"), F.lead("amount").over(by).alias("next"), undone.alias("undone")).filter("__own")
    q = exact_quantiles(rows, "wallet", "amount", {"low": 0.25, "high": 0.75}).drop("n")
    decoy = (F.col("amount") <= F.col("low")) & (F.col("next") >= F.col("high")) & (F.col("low") < F.col("high"))
    near, far = F.col("before").isNotNull(), F.col("jump_before").isNotNull()
    agg = seen.join(q, "wallet").groupBy("wallet").agg(
        F.count(F.lit(1)).alias("n"), F.count("gap").alias("k"), F.stddev_pop("gap").alias("sd"), F.avg("gap").alias("m"), F.stddev_pop("jump").alias("jsd"),
        safe_corr(F.when(near, F.col("gap")), F.when(near, F.col("before"))).alias("r"), safe_corr(F.when(far, F.col("jump")), F.when(far, F.col("jump_before"))).alias("j"),
        F.count_if(decoy).alias("decoy"), F.avg(F.col("undone").cast("double")).alias("undone"),
    )
    n, half = F.col("n"), lambda r: clip((F.coalesce(r, F.lit(0.0)) + 1) / 2, 0.0, 1.0)
    return agg.select(
        "wallet", "n", F.round(F.when(n < 4, 0.0).when(F.col("sd") <= 1e-12, 1.0).otherwise(half(F.col("r"))), 6).alias("regularity"),
        F.round(F.when(n < 4, 0.0).otherwise(F.col("decoy") / (n - 1)), 9).alias("decoys"), F.round(F.when((n < 5) | (F.col("jsd") <= 1e-12) | F.col("j").isNull(), 0.0).otherwise(half(F.col("j"))), 6).alias("jitter"),
        F.round(F.when(F.col("k") < 2, 1.0).otherwise(F.col("sd") / (F.col("m") + 1e-9)), 6).alias("gap_variation"), F.round(F.when(n < 2, 0.0).otherwise(F.col("undone")), 9).alias("round_trips"),
    )


def evasion_parts(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """Ordered signals of each wallet in one pass over its trades with their neighbours: regularity, rotation, decoys, jitter, gap variation, round trips.

    Each is 0 where a wallet has too few trades for it. Jitter is the lag-1
    autocorrelation of the gaps' differences mapped to 0..1.
    """
    rows = _rows(spark, d, rows)
    turn = rows.groupBy("wallet", "cp").agg(F.count(F.lit(1)).alias("c")).groupBy("wallet").agg((F.count("cp") / F.sum("c")).alias("rotation"))
    return _ordered_signals(rows).join(turn, "wallet").select(
        "wallet", "regularity", F.round(F.when(F.col("n") < 2, 0.0).otherwise(F.col("rotation")), 9).alias("rotation"), "decoys", "jitter", "gap_variation", "round_trips"
    )


#: Weights of the evasion signals.
EVASION = {"conformity": 0.20, "regularity": 0.25, "rotation": 0.20, "decoys": 0.15, "jitter": 0.20}


def conformity(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """How much closer a wallet's digits lie to the law than to those of a log-normal fit of its amounts, 0..1; 0 for under five trades.

    One fixed sample of 5,000 standard normal numbers stands for all fits; each
    Arrow batch is one array operation.
    """
    h = _rows(spark, d, rows).groupBy("wallet").agg(*b.digit_counts(b.leading_digit(F.col("amount"))), F.avg(F.log("amount")).alias("m"), F.coalesce(F.stddev_pop(F.log("amount")), F.lit(0.0)).alias("s"), F.count(F.lit(1)).alias("n")).filter("n >= 5")
    law = np.array(b.EXPECTED)

    @F.pandas_udf("double")
    def suspicion(c: pd.Series, m: pd.Series, s: pd.Series) -> pd.Series:
        z = np.random.default_rng(0).standard_normal(5000)
        seen = np.array(c.tolist(), float).reshape(-1, 9)
        seen = np.maximum(seen / np.maximum(seen.sum(axis=1, keepdims=True), 1), 1e-9)
        drawn = np.empty_like(seen)
        for i, (mean, sd) in enumerate(zip(m, s)):
            log = (mean + z * max(sd, 1e-6)) / np.log(10)
            lead = np.clip((10 ** (log - np.floor(log))).astype(int), 1, 9)
            drawn[i] = np.bincount(lead, minlength=10)[1:]
        drawn = np.maximum(drawn / np.maximum(drawn.sum(axis=1, keepdims=True), 1), 1e-9)
        kl = lambda q: (seen * np.log(seen / q)).sum(axis=1) / seen.sum(axis=1)
        return pd.Series(np.clip(1 - kl(law) / (kl(drawn) + 1e-9), 0, 1))

    return h.select("wallet", suspicion(F.array(*[f"c{k}" for k in range(1, 10)]), "m", "s").alias("conformity"))


def evasion_composite(spark: SparkSession, d: str) -> DataFrame:
    """Weighted sum of conformity, regularity, rotation, decoys and jitter (0.20, 0.25, 0.20, 0.15, 0.20)."""
    x = evasion_parts(spark, d).join(conformity(spark, d), "wallet", "left").fillna(0.0, ["conformity"])
    total = None
    for name, w in EVASION.items():
        total = F.lit(w) * F.col(name) if total is None else total + F.lit(w) * F.col(name)
    return x.select("wallet", F.round(total, 5).alias("evasion"))


#: Trailing windows of the vector's digit statistics, in hours before the clock.
_SPANS = {"24h": 24, "7d": 168, "30d": 720}


def feature_vector(spark: SparkSession, d: str) -> DataFrame:
    """All wallet families side by side, 0 where a family has nothing to say.

    What needs no order comes from one aggregate per wallet and counterparty,
    rolled up per wallet: additive counts, volumes and digit histograms of all
    windows, the top counterparty, distinct ones. Minutes are rolled up likewise.
    What needs order comes from one pass over trades with their neighbours. The
    families meet by wallet; each has a row per wallet at most.
    """
    rows = wallet_rows(spark, d)
    dg, age = b.leading_digit(F.col("amount")), F.timestamp_diff("MICROSECOND", F.col("ts"), F.lit(AS_OF).cast("timestamp_ntz"))
    same, pool = F.coalesce(F.col("base") == F.col("counter"), F.lit(False)), F.col("kind") == "liquidity_pool"
    money = F.col("amount").cast("decimal(38,8)")
    names = [f"c{k}" for k in range(1, 10)]
    windows = {"": F.lit(True)} | {f"_{w}": (age >= 0) & (age < h * 3_600_000_000) for w, h in _SPANS.items()}
    digits = [F.count_if((dg == k) & inside).alias(f"{c}{w}") for w, inside in windows.items() for k, c in enumerate(names, 1)]
    per = rows.groupBy("wallet", "cp").agg(
        F.count(F.lit(1)).alias("n"), F.sum(money).alias("v"), F.count_if(same).alias("same"), F.count_if(F.hour("ts").between(0, 5)).alias("off"), F.count_if(pool).alias("pooled"),
        F.sum(F.when(pool, money).otherwise(0)).alias("pv"), F.max("ts").alias("last"), *digits,
    )
    core = per.groupBy("wallet").agg(
        F.sum("n").alias("trades"), F.sum("v").cast("double").alias("volume"), F.count("cp").alias("counterparties"), F.count_if(F.col("cp") != F.col("wallet")).alias("others"),
        F.max(F.when(F.col("cp").isNotNull(), F.col("v"))).cast("double").alias("top"), F.sum("pv").cast("double").alias("pv"), F.max("last").alias("last"),
        *[F.sum(c).alias(c) for c in ("same", "off", "pooled")], *[F.sum(f"{c}{w}").alias(f"{c}{w}") for w in windows for c in names],
    )
    known = table(spark, d, "account_metadata").select(F.col("account").alias("wallet"), "created_at")
    accounts = core.agg(F.count(F.lit(1)).alias("accounts"))
    minutes = rows.groupBy("wallet", F.date_trunc("minute", "ts").alias("m")).agg(F.count(F.lit(1)).alias("c"))
    dense = minutes.groupBy("wallet").agg(F.round(F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c"), 9).alias("minute_clustering"))

    def stats(w: str) -> list[Column]:
        c = [F.col(f"{x}{w}") for x in names]
        n = b.total(c)
        return [F.round(b.chi_square(c, n), 5).alias(f"chi2{w}"), F.round(b.mean_deviation(c, n), 8).alias(f"mad{w}"), F.round(b.max_z(c, n), 5).alias(f"max_z{w}"), F.round(F.coalesce(b.ks_statistic(c, n), F.lit(0.0)), 7).alias(f"ks{w}"), F.round(F.coalesce(b.kuiper_statistic(c, n), F.lit(0.0)), 7).alias(f"kuiper{w}")]

    n = F.col("trades")
    # one row of the number of accounts
    core = core.join(known, "wallet", "left").join(F.broadcast(accounts)).select(
        "wallet", "trades", "volume", "counterparties", F.round(F.col("same") / n, 9).alias("self_matching"), F.round(F.col("off") / n, 9).alias("off_hours"), F.round(F.col("pooled") / n, 9).alias("pool_share"),
        F.round(ratio(F.col("top"), F.col("volume")), 7).alias("concentration"), F.round(ratio(F.col("volume"), F.col("counterparties")), 4).alias("volume_per_counterparty"),
        F.round(ratio(F.col("others"), F.col("accounts") - 1), 9).alias("centrality"), F.round(ratio(F.col("pv"), F.col("volume")), 7).alias("pool_ratio"), F.round(F.when(n < 2, 0.0).otherwise(F.col("counterparties") / n), 9).alias("rotation"),
        F.round(F.coalesce(F.greatest(_seconds(F.col("last"), F.col("created_at")) / 86400, F.lit(0.0)), F.lit(0.0)), 7).alias("age_days"), *[x for w in windows for x in stats(w)],
    )
    return core.join(dense, "wallet", "left").join(_ordered_signals(rows).drop("n"), "wallet", "left").fillna(0.0)


def consistency_rules(spark: SparkSession, d: str) -> DataFrame:
    """Contradictions within a wallet's vector, as names in order: high volume over few counterparties' share, ring without round trips, chi-square without deviation, young but central."""
    from marlspike.queries.graphs import ring_membership

    rings = ring_membership(spark, d).select(F.col("account").alias("wallet"), F.lit(1.0).alias("ring")).distinct()
    v = feature_vector(spark, d).join(rings, "wallet", "left").fillna(0.0, ["ring"])
    rules = [
        F.when((F.col("volume_per_counterparty") > 100) & (F.col("concentration") < 0.05), F.lit("high_volume_low_counterparty")),
        F.when((F.col("ring") > 0.5) & (F.col("round_trips") < 0.01), F.lit("ring_member_no_round_trips")),
        F.when((F.col("chi2_24h") > 50) & (F.col("mad_24h") < 0.001), F.lit("chi_sq_mad_contradiction")),
        F.when((F.col("age_days") < 7) & (F.col("centrality") > 0.3), F.lit("new_account_high_centrality")),
    ]
    return v.select("wallet", F.array_join(F.array_compact(F.array(*rules)), ",").alias("flags")).filter("flags <> ''")


QUERIES = {
    f.__name__: f
    for f in (
        counterparty_concentration, volume_per_counterparty, self_matching, cancellation_rate, intra_minute_clustering,
        off_hours_ratio, volume_spike_batch, volume_spike_stream, degree_centrality, hhi_concentration, pool_trade_ratio,
        path_payment_ratios, funding_similarity, account_age, round_trip_frequency, pool_round_trip, interval_autocorr,
        jitter_autocorr, counterparty_rotation, decoy_signature, iat_cv, burst_synchrony, evasion_parts, conformity, evasion_composite, feature_vector, consistency_rules,
    )
}

_DGS = "CASE WHEN amount > 0 THEN CAST(nullif(regexp_extract(CAST(amount AS VARCHAR), '[1-9]'), '') AS INT) END"
_CONC = "SELECT wallet, round(coalesce(max(v) FILTER (cp IS NOT NULL) / nullif(sum(v), 0), 0), 8) AS concentration FROM (SELECT wallet, cp, sum(amount) AS v FROM wrows GROUP BY ALL) GROUP BY wallet"
_ROT = "SELECT wallet, round(count(DISTINCT cp) / count(*), 9) AS rotation FROM wrows GROUP BY wallet"
_AGE = "SELECT wallet, coalesce(greatest((epoch_us(last) - epoch_us(created_at)) / 1e6 / 86400, 0), 0) AS age_days FROM (SELECT wallet, max(ts) AS last FROM wrows GROUP BY 1) LEFT JOIN account_metadata ON account = wallet"
_LEGS = "legs AS (SELECT wallet, ts, trade_id, CASE WHEN base = wallet THEN base_code ELSE counter_code END AS gave, CASE WHEN base = wallet THEN counter_code ELSE base_code END AS got FROM wrows)"
_TRIP_WINDOW = " OR ".join(
    f"(lead(gave, {k}) OVER w = got AND lead(got, {k}) OVER w = gave)" for k in range(1, 6)
)
_TRIP = f"SELECT wallet, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE avg(coalesce(u, FALSE)::INT) END, 9) AS round_trips FROM (SELECT wallet, {_TRIP_WINDOW} AS u FROM legs WINDOW w AS (PARTITION BY wallet ORDER BY ts, trade_id)) GROUP BY wallet"
_GAP = """gaps AS (SELECT *, lag(jump) OVER w AS jump_before FROM (SELECT *, gap - before AS jump FROM (
  SELECT *, lag(gap) OVER w AS before FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap FROM wrows
    WINDOW w AS (PARTITION BY wallet ORDER BY ts, trade_id)) WINDOW w AS (PARTITION BY wallet ORDER BY ts, trade_id)))
  WINDOW w AS (PARTITION BY wallet ORDER BY ts, trade_id))"""


def _corr(x: str, y: str, where: str) -> str:
    return (
        f"CASE WHEN count(*) FILTER ({where}) > 1 AND stddev_pop({x}) FILTER ({where}) > 1e-12 AND stddev_pop({y}) FILTER ({where}) > 1e-12 "
        f"THEN covar_pop({x}, {y}) FILTER ({where}) / (stddev_pop({x}) FILTER ({where}) * stddev_pop({y}) FILTER ({where})) END"
    )


_REG = f"""SELECT wallet, round(CASE WHEN n < 4 THEN 0.0 WHEN sd <= 1e-12 THEN 1.0 ELSE least(greatest((coalesce(r, 0) + 1) / 2, 0), 1) END, 6) AS regularity
FROM (SELECT wallet, count(*) AS n, stddev_pop(gap) AS sd, {_corr('gap', 'before', 'before IS NOT NULL')} AS r FROM gaps GROUP BY wallet)"""
_JIT = f"""SELECT wallet, round(CASE WHEN n < 5 THEN 0.0 ELSE coalesce(r, 0) END, 6) AS jitter
FROM (SELECT wallet, count(*) AS n, {_corr('jump', 'jump_before', 'jump_before IS NOT NULL')} AS r FROM gaps GROUP BY wallet)"""
_DEC = """SELECT q.wallet, round(coalesce(count(*) FILTER (amount <= lo AND nx >= hi AND lo < hi) / nullif(max(n) - 1, 0), 0), 9) AS decoys
FROM (SELECT wallet, quantile_cont(amount, 0.25) AS lo, quantile_cont(amount, 0.75) AS hi, count(*) AS n FROM wrows GROUP BY 1) q
JOIN (SELECT wallet, amount, lead(amount) OVER (PARTITION BY wallet ORDER BY ts, trade_id) AS nx FROM wrows) s ON s.wallet = q.wallet GROUP BY q.wallet"""

_PARTS = f"""f1 AS ({_REG}), f2 AS ({_ROT}), f3 AS ({_DEC}), f5 AS ({_TRIP}), nn AS (SELECT wallet, count(*) AS n FROM wrows GROUP BY 1),
f4 AS (SELECT wallet, round(CASE WHEN count(*) < 5 OR coalesce(stddev_pop(jump), 0) <= 1e-12 THEN 0.0 ELSE coalesce(least(greatest(({_corr('jump', 'jump_before', 'jump_before IS NOT NULL')} + 1) / 2, 0), 1), 0) END, 6) AS jitter,
  round(CASE WHEN count(gap) < 2 THEN 1.0 ELSE stddev_pop(gap) / (avg(gap) + 1e-9) END, 6) AS gap_variation FROM gaps GROUP BY 1),
parts AS (SELECT nn.wallet, regularity, CASE WHEN n < 2 THEN 0 ELSE rotation END AS rotation, CASE WHEN n < 4 THEN 0 ELSE decoys END AS decoys, jitter, gap_variation, round_trips
  FROM nn JOIN f1 USING (wallet) JOIN f2 USING (wallet) JOIN f3 USING (wallet) JOIN f4 USING (wallet) JOIN f5 USING (wallet))"""
_WSQL = {"": ""} | {f"_{w}": f" AND age >= 0 AND age < {h * 3_600_000_000}" for w, h in _SPANS.items()}


def _wstats(w: str) -> str:
    c = [f"c{k}{w}" for k in range(1, 10)]
    n, e = "(" + " + ".join(c) + ")", b.EXPECTED
    run, gaps = 0.0, []
    for k in range(9):
        run += e[k]
        gaps.append(f"(({' + '.join(c[: k + 1])}) / {n} - {run!r})")
    z = ", ".join(f"greatest(abs({x} / {n} - {v!r}) - 1 / (2 * {n}), 0) / sqrt({v * (1 - v)!r} / {n})" for x, v in zip(c, e))
    return (
        f"CASE WHEN {n} > 0 THEN round({' + '.join(f'pow({x} - {n} * {v!r}, 2) / ({n} * {v!r})' for x, v in zip(c, e))}, 5) ELSE 0 END AS chi2{w}, "
        f"CASE WHEN {n} > 0 THEN round(({' + '.join(f'abs({x} / {n} - {v!r})' for x, v in zip(c, e))}) / 9, 8) ELSE 0 END AS mad{w}, CASE WHEN {n} > 0 THEN round(greatest({z}), 5) ELSE 0 END AS max_z{w}, "
        f"CASE WHEN {n} >= 5 THEN round(greatest({', '.join(f'abs{g}' for g in gaps)}), 7) ELSE 0 END AS ks{w}, CASE WHEN {n} >= 5 THEN round(greatest({', '.join(gaps)}, 0) + greatest({', '.join('-' + g for g in gaps)}, 0), 7) ELSE 0 END AS kuiper{w}"
    )


ORACLE = {
    "counterparty_concentration": f"WITH {WALLET_SQL} {_CONC}",
    "volume_per_counterparty": f"WITH {WALLET_SQL} SELECT wallet, round(coalesce(sum(amount) / nullif(count(DISTINCT cp), 0), 0), 4) AS volume_per_counterparty FROM wrows GROUP BY 1",
    "self_matching": f"""WITH {WALLET_SQL} SELECT wallet, round(avg(coalesce(base = counter, FALSE)::INT), 9) AS rate FROM wrows GROUP BY 1
UNION ALL SELECT NULL, round(avg(coalesce(base = counter, FALSE)::INT), 9) FROM trades""",
    "cancellation_rate": f"WITH {ACTIVITY_SQL} SELECT wallet, round(avg((pair = 'error')::INT), 9) AS rate FROM activity GROUP BY 1",
    "intra_minute_clustering": f"""WITH {WALLET_SQL} SELECT wallet, round(sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c), 9) AS clustering
FROM (SELECT wallet, date_trunc('minute', ts) AS m, count(*) AS c FROM wrows GROUP BY ALL) GROUP BY 1""",
    "off_hours_ratio": f"WITH {WALLET_SQL} SELECT wallet, round(avg((hour(ts) BETWEEN 0 AND 5)::INT), 9) AS off_hours FROM wrows GROUP BY 1",
    "volume_spike_batch": f"""WITH {ACTIVITY_SQL}, hv AS (SELECT wallet, date_trunc('hour', ts) AS h, sum(amount) AS v FROM activity GROUP BY ALL),
span AS (SELECT wallet, min(h) AS lo, max(h) AS hi FROM hv GROUP BY 1),
grid AS (SELECT wallet, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS h FROM span),
dense AS (SELECT g.wallet, g.h, coalesce(v, 0) AS v FROM grid g LEFT JOIN hv ON hv.wallet = g.wallet AND hv.h = g.h),
lim AS (SELECT wallet, avg(v) + 2 * stddev_samp(v) AS l, count(*) AS n FROM dense GROUP BY 1)
SELECT d.wallet, round(coalesce(count(*) FILTER (d.v > l) / max(n), 0), 9) AS spikes FROM dense d JOIN lim ON lim.wallet = d.wallet GROUP BY 1""",
    "volume_spike_stream": f"""WITH {ACTIVITY_SQL}, hv AS (SELECT wallet, date_trunc('hour', ts) AS h, sum(amount) AS v FROM activity GROUP BY ALL),
m AS (SELECT wallet, v, avg(v) OVER (PARTITION BY wallet) + 2 * stddev_pop(v) OVER (PARTITION BY wallet) AS l FROM hv)
SELECT wallet, round(avg((v > l)::INT), 9) AS spikes FROM m GROUP BY 1""",
    "degree_centrality": f"""WITH {WALLET_SQL} SELECT wallet, round(count(DISTINCT cp) FILTER (cp <> wallet) / ((SELECT count(DISTINCT wallet) FROM wrows) - 1), 10) AS centrality
FROM wrows GROUP BY 1""",
    "hhi_concentration": f"""WITH {TRADES_SQL} SELECT pool, round(sum(v*v) / (sum(v)*sum(v)), 9) AS hhi, count(*) AS accounts
FROM (SELECT pool, base, sum(amount) AS v FROM trades WHERE pool IS NOT NULL GROUP BY ALL) GROUP BY 1""",
    "pool_trade_ratio": f"""WITH {WALLET_SQL} SELECT wallet, round(coalesce(sum(CASE WHEN kind = 'liquidity_pool' THEN amount ELSE 0 END) / nullif(sum(amount), 0), 0), 8) AS pool_ratio
FROM wrows GROUP BY 1""",
    "path_payment_ratios": f"""WITH {TRADES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY op ORDER BY token NULLS FIRST, trade_id) AS a,
  row_number() OVER (PARTITION BY op ORDER BY token DESC NULLS LAST, trade_id DESC) AS z FROM trades),
o AS (SELECT op, count(*) AS hops, min(base) AS wallet, max(base_code) FILTER (a = 1) AS f, max(counter_code) FILTER (z = 1) AS l FROM r GROUP BY op)
SELECT wallet, round(sum(CASE WHEN hops > 1 THEN hops ELSE 0 END) / sum(hops), 9) AS path_share, round(avg(hops), 9) AS mean_hops,
  round(coalesce(avg((f = l)::INT) FILTER (hops > 1), 0), 9) AS returns FROM o GROUP BY wallet""",
    "funding_similarity": f"""WITH {WALLET_SQL}, p AS (SELECT DISTINCT wallet, cp FROM wrows WHERE cp IS NOT NULL AND cp <> wallet)
SELECT p.wallet, round(avg(coalesce(a.funding_source = b.funding_source, FALSE)::INT), 9) AS similarity
FROM p LEFT JOIN account_metadata a ON a.account = p.wallet LEFT JOIN account_metadata b ON b.account = p.cp GROUP BY 1""",
    "account_age": f"WITH {WALLET_SQL} {_AGE}",
    "round_trip_frequency": f"WITH {WALLET_SQL}, {_LEGS} {_TRIP}",
    "pool_round_trip": f"""WITH {TRADES_SQL}, p AS (SELECT * FROM trades WHERE pool IS NOT NULL)
SELECT a.pool, a.base, round(avg((EXISTS (SELECT 1 FROM p b WHERE b.pool = a.pool AND b.base = a.base AND b.pair_key = a.pair_key
  AND b.base_is_seller <> a.base_is_seller AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR))::INT), 9) AS ratio FROM p a GROUP BY 1, 2""",
    "interval_autocorr": f"WITH {WALLET_SQL}, {_GAP} {_REG}",
    "jitter_autocorr": f"WITH {WALLET_SQL}, {_GAP} {_JIT}",
    "counterparty_rotation": f"WITH {WALLET_SQL} {_ROT}",
    "decoy_signature": f"WITH {WALLET_SQL} {_DEC}",
    "iat_cv": f"""WITH {WALLET_SQL}, {_GAP} SELECT wallet, round(CASE WHEN count(gap) < 2 THEN 1.0 ELSE stddev_pop(gap) / (avg(gap) + 1e-9) END, 6) AS cv FROM gaps GROUP BY 1""",
    "burst_synchrony": f"""WITH {ACTIVITY_SQL}, hc AS (SELECT pair, date_trunc('hour', ts) AS h, count(*) AS c FROM activity GROUP BY ALL),
g AS (SELECT unnest(generate_series((SELECT min(h) FROM hc), (SELECT max(h) FROM hc), INTERVAL 1 HOUR)) AS h),
dn AS (SELECT p.pair, g.h, coalesce(c, 0)::DOUBLE AS c FROM (SELECT DISTINCT pair FROM hc) p CROSS JOIN g LEFT JOIN hc ON hc.pair = p.pair AND hc.h = g.h)
SELECT a.pair AS p1, b.pair AS p2, round(greatest(coalesce(covar_pop(a.c, b.c) / nullif(stddev_pop(a.c) * stddev_pop(b.c), 0), 0), 0), 6) AS synchrony
FROM dn a JOIN dn b ON a.h = b.h AND a.pair < b.pair GROUP BY 1, 2""",
    "feature_vector": f"""WITH {WALLET_SQL}, {_GAP}, {_LEGS}, dg AS (SELECT *, {_DGS} AS dg, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts) AS age FROM wrows), {_PARTS},
hist AS (SELECT wallet, {', '.join(f"count(*) FILTER (dg = {k}{c}) AS c{k}{w}" for w, c in _WSQL.items() for k in range(1, 10))} FROM dg GROUP BY 1),
core AS (SELECT wallet, count(*) AS trades, CAST(sum(CAST(amount AS DECIMAL(38,8))) AS DOUBLE) AS volume, count(DISTINCT cp) AS counterparties, round(avg(coalesce(base = counter, FALSE)::INT), 9) AS self_matching,
  round(avg((hour(ts) BETWEEN 0 AND 5)::INT), 9) AS off_hours, round(avg((kind = 'liquidity_pool')::INT), 9) AS pool_share, round(CAST(sum(CASE WHEN kind = 'liquidity_pool' THEN CAST(amount AS DECIMAL(38,8)) ELSE 0 END) AS DOUBLE) / CAST(sum(CAST(amount AS DECIMAL(38,8))) AS DOUBLE), 7) AS pool_ratio,
  round(count(DISTINCT cp) FILTER (cp <> wallet) / ((SELECT count(DISTINCT wallet) FROM wrows) - 1), 9) AS centrality FROM dg GROUP BY wallet),
conc AS (SELECT wallet, round(coalesce(CAST(max(v) FILTER (cp IS NOT NULL) AS DOUBLE) / CAST(sum(v) AS DOUBLE), 0), 7) AS concentration FROM (SELECT wallet, cp, sum(CAST(amount AS DECIMAL(38,8))) AS v FROM wrows GROUP BY ALL) GROUP BY 1),
mc AS (SELECT wallet, round(sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c), 9) AS minute_clustering FROM (SELECT wallet, date_trunc('minute', ts) AS m, count(*) AS c FROM wrows GROUP BY ALL) GROUP BY 1)
SELECT core.*, concentration, round(coalesce(volume / nullif(counterparties, 0), 0), 4) AS volume_per_counterparty, round(age_days, 7) AS age_days, {', '.join(_wstats(w) for w in _WSQL)}, minute_clustering, regularity, rotation, decoys, jitter, gap_variation, round_trips
FROM core JOIN hist USING (wallet) JOIN conc USING (wallet) JOIN mc USING (wallet) JOIN parts USING (wallet) LEFT JOIN ({_AGE}) USING (wallet)""",
    "evasion_parts": f"WITH {WALLET_SQL}, {_GAP}, {_LEGS}, {_PARTS} SELECT * FROM parts",
}


def _rules_sql() -> str:
    from marlspike.queries.graphs import ORACLE as graph_sql

    return f"""WITH v AS (SELECT f.*, coalesce(r.ring, 0) AS ring FROM ({ORACLE['feature_vector']}) f LEFT JOIN (SELECT DISTINCT account, 1.0 AS ring FROM ({graph_sql['ring_membership']})) r ON r.account = f.wallet),
g AS (SELECT wallet, concat_ws(',', CASE WHEN volume_per_counterparty > 100 AND concentration < 0.05 THEN 'high_volume_low_counterparty' END, CASE WHEN ring > 0.5 AND round_trips < 0.01 THEN 'ring_member_no_round_trips' END,
  CASE WHEN chi2_24h > 50 AND mad_24h < 0.001 THEN 'chi_sq_mad_contradiction' END, CASE WHEN coalesce(age_days, 0) < 7 AND centrality > 0.3 THEN 'new_account_high_centrality' END) AS flags FROM v) SELECT wallet, flags FROM g WHERE flags <> ''"""


ORACLE["consistency_rules"] = _rules_sql()
