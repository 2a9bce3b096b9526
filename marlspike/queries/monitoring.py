"""Time series, drift, evaluation and scoring queries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike.functions.aggregates import bounded_heap
from marlspike.functions.cells import micros
from marlspike.functions.stats import clip, ratio, safe_corr
from marlspike.operators.neighbours import with_neighbours
from marlspike.operators.pairsets import common_wallets
from marlspike.queries.views import ACTIVITY_SQL, AS_OF, TRADES_SQL, WALLET_SQL, activity, trades, wallet_rows
from marlspike.session import durable
from marlspike.sources.tables import table

_FEED = "random_forest double, xgboost double, lightgbm double"


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    """Usable labels with the models' scores: id, wallet, y, ens, rf, xg, lg, at, analyst."""
    m = F.from_json("model_scores_json", _FEED)
    return table(spark, d, "label_feedback").filter(F.col("true_label").isin(0, 1)).select(
        "id", "wallet", F.col("true_label").alias("y"), F.col("ensemble_score").alias("ens"), m["random_forest"].alias("rf"),
        m["xgboost"].alias("xg"), m["lightgbm"].alias("lg"), F.col("confirmed_at").alias("at"), F.lower(F.trim("analyst_id")).alias("analyst"),
    )


_F = """fb AS (SELECT id, wallet, true_label AS y, ensemble_score AS ens, CAST(json_extract(model_scores_json, '$.random_forest') AS DOUBLE) AS rf,
  CAST(json_extract(model_scores_json, '$.xgboost') AS DOUBLE) AS xg, CAST(json_extract(model_scores_json, '$.lightgbm') AS DOUBLE) AS lg,
  confirmed_at AS tm, lower(trim(analyst_id)) AS analyst FROM label_feedback WHERE true_label IN (0, 1))"""


def _confusion(y: Column, hit: Column) -> list[Column]:
    return [
        F.count_if((y == 1) & hit).alias("tp"), F.count_if((y == 0) & hit).alias("fp"),
        F.count_if((y == 1) & ~hit).alias("fn"), F.count_if((y == 0) & ~hit).alias("tn"),
    ]


def _rates() -> list[Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 9).alias("f1")]


def volume_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Four-hour volumes of the last 30 days, one column per activity type, empty cells zero."""
    end = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    a = activity(spark, d).filter((F.col("ts") > end - F.expr("INTERVAL 30 DAYS")) & (F.col("ts") <= end))
    kinds = ["click", "error", "purchase", "signup", "view"]
    w = F.window("ts", "4 hours")["start"]
    m = a.groupBy(F.date_format(w, "yyyy-MM-dd HH:mm").alias("slice")).pivot("pair", kinds).agg(F.sum("amount")).fillna(0.0)
    return m.select("slice", *[F.round(k, 4).alias(k) for k in kinds])


def daily_ranks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Daily volumes of pairs with at least 10 active days as ranks: pair_key, day, n, all, e; and pair_key, n, all, s.

    ``e``: rank of an active day above that of the pair's days without trades;
    ``n`` and ``all`` count the active days and the calendar's; ``s`` is ``all``
    times the ranks' variance.
    """
    daily = trades(spark, d).groupBy("pair_key", F.to_date("ts").alias("day")).agg(F.round(F.sum("amount"), 6).alias("v"))
    daily = durable(daily, "daily-volumes")
    calendar = daily.agg(F.countDistinct("day").alias("all"))
    by = Window.partitionBy("pair_key")
    active = daily.filter("v > 0").withColumn("n", F.count(F.lit(1)).over(by)).filter("n >= 10")
    # one row
    ranked = active.join(F.broadcast(calendar)).withColumn("r", F.rank().over(by.orderBy("v")) + (F.count(F.lit(1)).over(Window.partitionBy("pair_key", "v")) - 1) / 2)
    e = durable(ranked.select("pair_key", "day", "n", "all", (F.col("r") + (F.col("all") - F.col("n") - 1) / 2).alias("e")), "daily-ranks")
    per = e.groupBy("pair_key").agg(F.max("n").alias("n"), F.max("all").alias("all"), (F.sum(F.col("e") * F.col("e")) - F.max("all") * F.max("n") * F.max("n") / 4).alias("s"))
    return e, per


def _rank_r() -> Column:
    """Rank correlation of n, s and n_b, s_b with the product sum ab of common days."""
    cov = F.coalesce("ab", F.lit(0.0)) - F.col("all") * F.col("n") * F.col("n_b") / 4
    return F.round(F.when((F.col("s") > 0) & (F.col("s_b") > 0), cov / F.sqrt(F.col("s") * F.col("s_b"))), 6)


def spearman_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation (average ranks) of daily volumes of pairs with at least 10 active days; days without trades count as zero.

    ``days``: days on which both are active. A pair's zeros share one rank, so with
    ranks taken relative to it only common active days add to a product sum; the
    rest is in closed form. All sums are of halves and exact.
    """
    e, per = daily_ranks(spark, d)
    # one row per pair and day: at most the calendar's days per pair
    common = e.select("pair_key", "day", F.col("e").alias("ea")).join(e.select(F.col("pair_key").alias("other"), "day", F.col("e").alias("eb")), "day").filter("pair_key < other")
    sums = common.groupBy("pair_key", "other").agg(F.sum(F.col("ea") * F.col("eb")).alias("ab"), F.count(F.lit(1)).alias("days"))
    every = per.join(per.select(F.col("pair_key").alias("other"), F.col("n").alias("n_b"), F.col("s").alias("s_b")), F.col("pair_key") < F.col("other"))
    return every.join(sums, ["pair_key", "other"], "left").select("pair_key", "other", F.coalesce("days", F.lit(0)).alias("days"), _rank_r().alias("r"))


def rank_correlations(pairs: DataFrame, e: DataFrame, per: DataFrame) -> DataFrame:
    """(pair_key, other, r) as in ``spearman_pairs`` for the given pairs of pairs alone; the one with fewer days is looked up in the other."""
    known = pairs.join(per, "pair_key").join(per.select(F.col("pair_key").alias("other"), F.col("n").alias("n_b"), F.col("s").alias("s_b")), "other")
    less = F.col("n") <= F.col("n_b")
    given = pairs.columns
    sides = known.select(*given, F.when(less, F.col("pair_key")).otherwise(F.col("other")).alias("few"), F.when(less, F.col("other")).otherwise(F.col("pair_key")).alias("many"))
    common = sides.join(e.select(F.col("pair_key").alias("few"), "day", F.col("e").alias("ea")), "few").join(e.select(F.col("pair_key").alias("many"), "day", F.col("e").alias("eb")), ["many", "day"])
    sums = common.groupBy("pair_key", "other").agg(F.sum(F.col("ea") * F.col("eb")).alias("ab"))
    return known.join(sums, ["pair_key", "other"], "left").select("pair_key", "other", _rank_r().alias("r"))


def shared_wallets(spark: SparkSession, d: str) -> DataFrame:
    """Wallets that two pairs share, for all pairs with a common wallet.

    Counted in blocks of pairs; the combinations of a wallet's pairs are never rows.
    """
    p = durable(wallet_rows(spark, d).select("wallet", "pair_key").distinct(), "wallet-pairs")
    number = lambda c: durable(numbered(p.select(c).distinct(), c), f"numbered-{c}")
    return common_wallets(number("pair_key"), number("wallet"), p)


def causal_panel(spark: SparkSession, d: str) -> DataFrame:
    """Hourly panel per activity type: last value, its next change, rolling deviation of three hours, treated flag."""
    a = activity(spark, d)
    h = a.groupBy("pair", F.date_trunc("hour", "ts").alias("h")).agg(
        F.max_by("amount", F.struct("ts", "event_id")).alias("last"), F.sum("amount").alias("volume"), F.max((F.col("wallet") % 7 == 0).cast("int")).alias("treated")
    )
    by = Window.partitionBy("pair").orderBy("h")
    return h.select(
        "pair", F.date_format("h", "yyyy-MM-dd HH").alias("hour"), "treated", F.col("volume"), F.round(F.lead("last").over(by) - F.col("last"), 6).alias("next_change"),
        F.round(F.coalesce(F.stddev_samp("last").over(by.rowsBetween(-2, 0)), F.lit(0.0)), 6).alias("volatility"),
    )


def treatment_effect(spark: SparkSession, d: str) -> DataFrame:
    """Doubly robust effect of treated hours on the next change, per activity type.

    Each panel (hours of a type) is fitted in one grouped call: ridge logistic
    propensities clipped to 0.05..0.95, linear outcomes per arm, AIPW mean. Fewer
    than six hours or a single arm give 0.
    """
    panel = causal_panel(spark, d).filter("next_change IS NOT NULL").withColumn("hod", F.substring("hour", 12, 2).cast("double"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["pair"].iloc[0]
        t = pdf["treated"].to_numpy(float)
        if len(pdf) < 6 or t.min() == t.max():
            return pd.DataFrame({"pair": [name], "hours": [len(pdf)], "effect": [0.0]})
        x = pdf[["hod", "volatility", "volume"]].to_numpy(float)
        sd = x.std(axis=0)
        x = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)])
        y, beta = pdf["next_change"].to_numpy(float), np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-x @ beta))
            beta += np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-3 * np.eye(x.shape[1]), x.T @ (t - p) - 1e-3 * beta)
        p = np.clip(1 / (1 + np.exp(-x @ beta)), 0.05, 0.95)
        mu = [x @ np.linalg.lstsq(x[t == k], y[t == k], rcond=None)[0] for k in (0, 1)]
        effect = np.mean(mu[1] - mu[0] + t * (y - mu[1]) / p - (1 - t) * (y - mu[0]) / (1 - p))
        return pd.DataFrame({"pair": [name], "hours": [len(pdf)], "effect": [float(effect)]})

    return panel.groupBy("pair").applyInPandas(fit, "pair string, hours long, effect double")


def five_minute_bins(spark: SparkSession, d: str) -> DataFrame:
    """Per activity type the 2,016 five-minute bins up to its newest event: count and log volume, zeros included."""
    a = activity(spark, d)
    newest = a.groupBy("pair").agg(F.max("ts").alias("hi"))
    lo = F.col("hi") - F.expr("INTERVAL 168 HOURS")
    inside = a.join(newest, "pair").filter(F.col("ts") >= lo)
    b = F.floor(F.timestamp_diff("MICROSECOND", lo, F.col("ts")) / F.lit(300_000_000)).cast("int")
    binned = inside.withColumn("bin", b).filter("bin < 2016").groupBy("pair", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("v"))
    spine = newest.select("pair", F.explode(F.sequence(F.lit(0), F.lit(2015))).alias("bin"))
    return spine.join(binned, ["pair", "bin"], "left").select(
        "pair", "bin", F.coalesce("n", F.lit(0)).alias("events"), F.round(F.coalesce(F.log10(F.col("v") + 1e-9), F.lit(0.0)), 8).alias("log_volume")
    )


def ffill_bfill(spark: SparkSession, d: str) -> DataFrame:
    """Daily score of every scored pair, gaps filled forward, then backward, then with 20."""
    s = table(spark, d, "risk_scores").filter("asset_pair IS NOT NULL AND timestamp IS NOT NULL")
    pairs = s.select("asset_pair").distinct()
    daily = s.filter("score BETWEEN 0 AND 100").groupBy("asset_pair", F.to_date("timestamp").alias("day")).agg(F.avg("score").alias("m"))
    span = s.agg(F.min(F.to_date("timestamp")).alias("a"), F.max(F.to_date("timestamp")).alias("b"))
    # pairs times the calendar, which is one row until it is laid out
    grid = pairs.join(F.broadcast(span)).select("asset_pair", F.explode(F.sequence("a", "b")).alias("day"))
    by = Window.partitionBy("asset_pair").orderBy("day")
    g = grid.join(daily, ["asset_pair", "day"], "left")
    filled = F.coalesce(
        F.last("m", True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.first("m", True).over(by.rowsBetween(0, Window.unboundedFollowing)), F.lit(20.0)
    )
    return g.select("asset_pair", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(filled, 6).alias("score"))


def score_steps(s: DataFrame, span: DataFrame) -> DataFrame:
    """Where the filled, standardised daily scores of each pair that isn't constant change: asset_pair, start, step, first.

    Filled as in ``ffill_bfill``, a series stays the same from one scored day to the
    next, so scored days are all it takes, however long the calendar is. Its first
    run begins with the calendar; there ``step`` is the value itself.
    """
    daily = s.filter("score BETWEEN 0 AND 100").groupBy("asset_pair", F.to_date("timestamp").alias("day")).agg(F.round(F.avg("score"), 6).alias("score"))
    by = Window.partitionBy("asset_pair")
    order = by.orderBy("day")
    runs = daily.join(F.broadcast(span)).select(
        "asset_pair", "score", F.lag("score").over(order).alias("last"), (F.row_number().over(order) == 1).alias("first"),
        F.when(F.row_number().over(order) == 1, F.col("a")).otherwise(F.col("day")).alias("start"), F.coalesce(F.lead("day").over(order), F.date_add("b", 1)).alias("end"),
    )
    days = F.datediff("end", "start")
    mean = F.sum(F.col("score") * days).over(by) / F.sum(days).over(by)
    moving = runs.withColumn("mean", mean).withColumn("moves", F.min("score").over(by) < F.max("score").over(by)).filter("moves")
    sd = F.sqrt(F.sum((F.col("score") - F.col("mean")) * (F.col("score") - F.col("mean")) * days).over(by) / F.sum(days).over(by))
    steps = moving.select("asset_pair", "start", ((F.col("score") - F.when(F.col("first"), F.col("mean")).otherwise(F.col("last"))) / sd).alias("step"), "first")
    return steps.filter("first OR step <> 0")


def pairwise_corr(spark: SparkSession, d: str) -> DataFrame:
    """Mean correlation of a pair's filled daily scores with all others; constant series correlate with none.

    Correlation is the mean product of standardised scores, so the sum over all
    others is one product with each day's total less the pair's own part (1): no
    pair of pairs is formed. That product is summed by parts: less the sum of each
    step times the totals of all days before it, as all totals together are 0. No
    row per day of the calendar is formed either.
    """
    s = table(spark, d, "risk_scores").filter("asset_pair IS NOT NULL AND timestamp IS NOT NULL")
    span = s.agg(F.min(F.to_date("timestamp")).alias("a"), F.max(F.to_date("timestamp")).alias("b"))
    steps = durable(score_steps(s, span), "score-steps")
    # one row per day on which a series changes
    order = Window.orderBy("start")
    totals = steps.groupBy("start").agg(F.sum("step").alias("step")).select("start", F.sum("step").over(order).alias("total"))
    gained = totals.select("start", (F.lag("total").over(order) * F.datediff("start", F.lag("start").over(order))).alias("gained"))
    before = gained.select("start", F.sum("gained").over(order).alias("before"))
    products = steps.filter("NOT first").join(before, "start").groupBy("asset_pair").agg((-F.sum(F.col("step") * F.col("before"))).alias("p"))
    # one row each
    count = steps.agg((F.count_if("first") - 1).alias("others"))
    r = products.join(F.broadcast(count)).join(F.broadcast(span))
    mean = F.when(F.col("others") > 0, (F.col("p") / (F.datediff("b", "a") + 1) - 1) / F.col("others"))
    return s.select("asset_pair").distinct().join(r.select("asset_pair", F.round(mean, 5).alias("mean_r")), "asset_pair", "left")


def sliding_sequences(spark: SparkSession, d: str) -> DataFrame:
    """The sequence of 30 daily values up to each day (stride 1) per pair, zeros in front where there are fewer days.

    Written out are how many zeros stand in front, the sum over the sequence and its
    sum weighted by position (1 to 30), both in millionths, and its last value.
    """
    by = Window.partitionBy("asset_pair").orderBy("day").rowsBetween(-29, 0)
    s = ffill_bfill(spark, d).withColumn("seq", F.collect_list("score").over(by))
    millionths = F.transform("seq", lambda x: F.round(x * 1_000_000).cast("long"))
    padded = F.concat(F.array_repeat(F.lit(0).cast("long"), 30 - F.size("seq")), millionths)
    weighted = F.aggregate(F.transform(padded, lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    total = F.aggregate(padded, F.lit(0).cast("long"), lambda a, x: a + x)
    return s.select("asset_pair", "day", (30 - F.size("seq")).alias("padding"), total.alias("total"), weighted.alias("weighted"), F.element_at("seq", -1).alias("last"))


def trade_sequences(spark: SparkSession, d: str, steps: int = 200) -> DataFrame:
    """Last 200 trades of each wallet as vectors of five numbers, numbered so that the newest has position 199.

    log1p of the amount, 1 for the buyer, log1p of the seconds since the trade
    before (0 for the first), the pair's place among all pairs in order of name
    over their number, second of day over 86,400. Positions in front of the
    first stand for zeros, as in a padded sequence.
    """
    rows = wallet_rows(spark, d).withColumn("buys", ((F.col("base") == F.col("wallet")) != F.coalesce("base_is_seller", F.lit(False))).cast("double"))
    cut = with_neighbours(rows.select("wallet", "ts", "trade_id", "amount", "pair", "buys"), ["wallet"], ["ts", "trade_id"], F.date_trunc("week", "ts"), 1, 0)
    by = Window.partitionBy("wallet", "__chunk").orderBy("ts", "trade_id")
    r = cut.withColumn("gap", F.timestamp_diff("SECOND", F.lag("ts").over(by), F.col("ts"))).filter("__own")
    heap = bounded_heap(F.struct("ts", "trade_id", "amount", "gap", "pair", "buys"), steps, largest=True)
    last = r.groupBy("wallet").agg(heap.alias("h")).select("wallet", F.posexplode("h").alias("back", "x")).select("wallet", (steps - 1 - F.col("back")).alias("position"), "x.*")
    vocabulary = numbered(trades(spark, d).select("pair").distinct(), "pair")
    sec = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))) / F.lit(86400.0)
    return last.join(vocabulary, "pair").select(
        "wallet", "position", F.round(F.log1p("amount"), 7).alias("log_amount"), "buys",
        F.round(F.log1p(F.greatest(F.coalesce("gap", F.lit(0)), F.lit(0)).cast("double")), 7).alias("log_gap"),
        F.round(F.col("number") / F.col("all"), 9).alias("pair_share"), F.round(sec, 7).alias("time_of_day"),
    )


def numbered(values: DataFrame, column: str) -> DataFrame:
    """(column, number, all): distinct values numbered from 0 in their order, and how many there are.

    Values are spread over ranges by their first two characters, counted, and
    numbered within these; no list of all of them is sorted in one place.
    """
    part = values.select(column, F.substring(column, 1, 2).alias("__h"))
    sizes = part.groupBy("__h").agg(F.count(F.lit(1)).alias("k"))
    # one row per two characters
    before = sizes.select("__h", (F.sum("k").over(Window.orderBy("__h")) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy()).alias("all"))
    within = F.row_number().over(Window.partitionBy("__h").orderBy(column)) - 1
    return part.withColumn("w", within).join(before, "__h").select(column, (F.col("w") + F.col("before")).alias("number"), "all")


def alert_state_machine(spark: SparkSession, d: str) -> DataFrame:
    """Alerts over a wallet's scores in order of (timestamp, id): open at 80, escalate 10 above the last, resolve after three below.

    Every score counts. An alert is open as long as one of the last three scores
    was high, so the state before a score follows from the three before it, and a
    wallet is cut into weeks with those rows handed on. Escalations are high too.
    """
    s = table(spark, d, "risk_scores").filter("wallet IS NOT NULL AND score BETWEEN 0 AND 100 AND timestamp IS NOT NULL").select("wallet", "timestamp", "id", "score")
    cut = with_neighbours(s, ["wallet"], ["timestamp", "id", "score"], F.date_trunc("week", "timestamp"), 3, 0)
    by = Window.partitionBy("wallet", "__chunk").orderBy("timestamp", "id", "score")
    before = [F.coalesce(F.lag("score", k).over(by) >= 80, F.lit(False)) for k in (1, 2, 3)]
    x = cut.select("*", F.lag("score").over(by).alias("last"), *[b.alias(f"high{k}") for k, b in enumerate(before, 1)]).filter("__own")
    high, was = F.col("score") >= 80, F.col("high1") | F.col("high2") | F.col("high3")
    ends = ~high & F.col("high3") & ~F.col("high1") & ~F.col("high2")
    return x.groupBy("wallet").agg(
        F.max_by((was | high) & ~ends, F.struct("timestamp", "id", "score")).alias("open"), F.count_if(high & ~was).cast("int").alias("opened"),
        F.count_if(was & high & (F.col("score") > F.col("last") + 10)).cast("int").alias("escalated"), F.count_if(ends).cast("int").alias("resolved"),
    )


def stored_chain(spark: SparkSession, d: str) -> DataFrame:
    """Labels as an event log with the chain hash each was stored with: wallet, id, at, payload, chain_hash.

    The hash of an event covers the stored hash before it in the wallet and the
    payload. Events whose id ends in 7 were altered after they had been stored,
    so that there is something to find. A wallet's labels are as many as its
    analysts gave: they are folded in order within one row.
    """
    f = _feedback(spark, d).withColumn("payload", F.concat_ws("|", "wallet", F.col("y").cast("string"), F.col("ens").cast("string")))
    one = f.groupBy("wallet").agg(F.array_sort(F.collect_list(F.struct("at", "id", "payload"))).alias("events"))
    link = "struct<at:timestamp_ntz,id:bigint,payload:string,chain_hash:string>"
    chained = F.aggregate(
        "events", F.array().cast(f"array<{link}>"),
        lambda done, e: F.concat(done, F.array(F.struct(
            e["at"].alias("at"), e["id"].alias("id"), e["payload"].alias("payload"),
            F.sha2(F.concat_ws("|", F.coalesce(F.get(done, F.size(done) - 1)["chain_hash"], F.lit("genesis")), e["payload"]), 256).alias("chain_hash"),
        ))),
    )
    out = one.select("wallet", F.explode(chained).alias("e")).select("wallet", "e.*")
    return out.withColumn("payload", F.when(F.col("id") % 10 == 7, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))


def hash_chain_verify(spark: SparkSession, d: str) -> DataFrame:
    """Per wallet: events, how many hashes don't follow from the stored hash before and the payload, and the first such event.

    Each link needs only the stored hash before it, so one broken link doesn't
    hide what follows.
    """
    by = Window.partitionBy("wallet").orderBy("at", "id")
    expected = F.sha2(F.concat_ws("|", F.coalesce(F.lag("chain_hash").over(by), F.lit("genesis")), "payload"), 256)
    c = stored_chain(spark, d).withColumn("bad", expected != F.col("chain_hash"))
    return c.groupBy("wallet").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("bad").alias("broken"), F.min_by(F.when(F.col("bad"), F.col("id")), F.when(F.col("bad"), F.struct("at", "id"))).alias("first_broken"),
    )


def time_decay(spark: SparkSession, d: str) -> DataFrame:
    """Weight of each analyst's labels: confidence (ensemble score over 100) x e^(-0.05 days before the clock)."""
    age = F.timestamp_diff("MICROSECOND", F.col("at"), F.lit(AS_OF).cast("timestamp_ntz")) / F.lit(86400e6)
    w = F.col("ens") / 100 * F.exp(-0.05 * age)
    return _feedback(spark, d).groupBy("analyst").agg(F.round(F.sum(w), 6).alias("weight"), F.round(F.sum(F.col("y") * w), 6).alias("positive"))


def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Five expanding folds over the span of labels: training before the fold's cut, validation a fold long after a gap of seven days.

    Folds without a row on either side don't come out.
    """
    f = _feedback(spark, d)
    span = f.agg(F.min(micros("at")).alias("lo"), F.max(micros("at")).alias("hi"))
    # one row
    x = f.withColumn("t", micros("at")).join(F.broadcast(span)).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(5))))
    each = (F.col("hi") - F.col("lo")) / 6
    cut = F.col("lo") + each * F.col("fold")
    start = cut + 7 * 86400e6
    return x.groupBy("fold").agg(
        F.count_if(F.col("t") < cut).alias("train"), F.count_if((F.col("t") >= start) & (F.col("t") < start + each)).alias("validate"),
        F.count_if((F.col("t") >= cut) & (F.col("t") < start)).alias("purged"),
    ).filter("train > 0 AND validate > 0")


def cusum(spark: SparkSession, d: str) -> DataFrame:
    """CUSUM of every label's error in order of time: S = max(0, S + e - mean - 0.1) after the first quarter, whose mean it is; alarm above 5.

    Per day: labels after the reference, S at the day's end, its highest value,
    and whether it exceeds the limit. S is the running sum less its running
    minimum; sums and minima of days are put together before they are laid over
    a day's labels, so no more than a day is ordered in one place.
    """
    e = (F.col("y") != (F.col("ens") >= 50).cast("int")).cast("double")
    rows = _feedback(spark, d).filter("at IS NOT NULL").select(F.to_date("at").alias("day"), "at", "id", F.coalesce(e, F.lit(0.0)).alias("e"))
    within = Window.partitionBy("day").orderBy("at", "id")
    rows = rows.withColumn("k", F.row_number().over(within))
    # one row per calendar day
    days = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    place = days.select("day", (F.sum("n").over(Window.orderBy("day")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    at = rows.join(F.broadcast(place), "day").withColumn("i", F.col("k") + F.col("before"))
    quarter = F.greatest(F.lit(1), F.floor(F.col("all") / 4))
    mean = at.filter((F.col("all") >= 4) & (F.col("i") <= quarter)).agg(F.avg("e").alias("mu"))
    tail = at.filter((F.col("all") >= 4) & (F.col("i") > quarter)).join(F.broadcast(mean)).withColumn("x", F.col("e") - F.col("mu") - 0.1)
    tail = tail.withColumn("p", F.sum("x").over(within)).withColumn("low", F.min("p").over(within))
    ends = tail.groupBy("day").agg(F.sum("x").alias("sum"), F.min("p").alias("least"))
    order = Window.orderBy("day")
    ends = ends.withColumn("start", F.sum("sum").over(order) - F.col("sum"))
    ends = ends.withColumn("floor", F.least(F.lit(0.0), F.coalesce(F.min(F.col("start") + F.col("least")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))))
    s = tail.join(F.broadcast(ends.select("day", "start", "floor")), "day")
    value = F.col("start") + F.col("p") - F.least(F.col("floor"), F.col("start") + F.col("low"))
    return s.withColumn("s", value).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("labels"), F.round(F.max_by("s", "i"), 6).alias("cusum"), F.round(F.max("s"), 6).alias("highest"), (F.max("s") > 5).alias("alarm"),
    )


#: Page-Hinkley: tolerated deviation, and the limit at which it fires.
PH_DELTA, PH_LIMIT = 0.005, 50.0


def page_hinkley_fold(values: Column, delta: float = PH_DELTA, limit: float = PH_LIMIT) -> Column:
    """State after an array of values: n, mean, sum, low, detections, last detection; the sums start anew when it fires."""
    state = "struct<n:int,mean:double,sum:double,low:double,fired:int,last:int>"
    start = F.struct(*[F.lit(0).alias(c) if c in ("n", "fired", "last") else F.lit(0.0).alias(c) for c in ("n", "mean", "sum", "low", "fired", "last")]).cast(state)

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        total = s["sum"] + (x - mean - delta)
        low = F.least(s["low"], total)
        fires = (total - low) > limit
        return F.struct(
            n.alias("n"), mean.alias("mean"), F.when(fires, 0.0).otherwise(total).alias("sum"), F.when(fires, 0.0).otherwise(low).alias("low"),
            (s["fired"] + fires.cast("int")).alias("fired"), F.when(fires, n).otherwise(s["last"]).alias("last"),
        ).cast(state)

    return F.aggregate(values, start, step)


def page_hinkley(spark: SparkSession, d: str) -> DataFrame:
    """Page-Hinkley detector per activity type over its daily means: statistic at the end, detections, day number of the last one.

    A series is as long as the calendar; it is folded in one row.
    """
    daily = activity(spark, d).groupBy("pair", F.to_date("ts").alias("day")).agg(F.round(F.avg("amount"), 10).alias("x"))
    series = daily.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("day", "x"))).alias("s"))
    f = series.select("pair", page_hinkley_fold(F.col("s.x")).alias("f"))
    return f.select("pair", F.col("f.n").alias("days"), F.round(F.col("f.sum") - F.col("f.low"), 6).alias("statistic"), F.col("f.fired").alias("detections"), F.col("f.last").alias("last_detection"))


def adwin(spark: SparkSession, d: str) -> DataFrame:
    """Change points of daily mean values per activity type: window split where halves' means differ beyond the bound."""
    daily = activity(spark, d).groupBy("pair", F.to_date("ts").alias("day")).agg(F.avg("amount").alias("x"))

    def detect(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("day")["x"].to_numpy(float)
        start, changes = 0, 0
        for end in range(2, len(x) + 1):
            w = x[start:end]
            cut = False
            for k in range(3, len(w) - 2):
                m = 1 / (1 / k + 1 / (len(w) - k))
                eps = np.sqrt(2 / m * w.var() * np.log(2 * len(w) / 0.002)) + 2 / (3 * m) * np.log(2 * len(w) / 0.002)
                if abs(w[:k].mean() - w[k:].mean()) > eps:
                    start, cut = start + k, True
                    break
            changes += cut
        return pd.DataFrame({"pair": [pdf["pair"].iloc[0]], "changes": [changes], "window": [len(x) - start]})

    return daily.groupBy("pair").applyInPandas(detect, "pair string, changes long, window long")


def _psi_sides(spark: SparkSession, d: str) -> DataFrame:
    """Reference and current values per model: labels before and after the middle of March."""
    f = _feedback(spark, d)
    side = F.when(F.col("at") < F.lit("2026-03-15 00:00:00").cast("timestamp_ntz"), "ref").otherwise("cur")
    return f.select(side.alias("side"), F.explode(F.array(*[F.struct(F.lit(m).alias("feature"), F.col(m).cast("double").alias("x")) for m in ("rf", "xg", "lg", "ens")])).alias("e")).select("side", "e.*").filter("x IS NOT NULL")


def _psi(binned: DataFrame, eps: float) -> DataFrame:
    tot = binned.groupBy("feature").agg(F.sum("ref").alias("nr"), F.sum("cur").alias("nc"))
    p, q = F.greatest(F.col("ref") / F.col("nr"), F.lit(eps)), F.greatest(F.col("cur") / F.col("nc"), F.lit(eps))
    return binned.join(tot, "feature").groupBy("feature").agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def psi_equal_width(spark: SparkSession, d: str) -> DataFrame:
    """Population stability per feature over ten equal bins of the common range."""
    s = _psi_sides(spark, d)
    r = s.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10), F.lit(9))
    spine = r.select("feature", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bin"))
    binned = s.join(r, "feature").filter("hi > lo").groupBy("feature", b.cast("int").alias("bin")).agg(F.count_if(F.expr("side = 'ref'")).alias("ref"), F.count_if(F.expr("side = 'cur'")).alias("cur"))
    full = spine.join(binned, ["feature", "bin"], "left").fillna(0)
    return _psi(full, 1e-10).select("feature", F.round(F.greatest("psi", F.lit(0.0)), 7).alias("psi"))


def psi_quantile(spark: SparkSession, d: str) -> DataFrame:
    """The same over deciles of the reference; values outside are dropped."""
    s = _psi_sides(spark, d)
    edges = s.filter("side = 'ref'").groupBy("feature").agg(F.array_distinct(F.percentile("x", F.array(*[F.lit(i / 10) for i in range(11)]))).alias("q"))
    j = s.join(edges, "feature").filter((F.size("q") >= 3) & (F.col("x") >= F.col("q")[0]) & (F.col("x") <= F.element_at("q", -1)))
    b = F.least(F.size(F.filter("q", lambda e: e <= F.col("x"))), F.size("q") - 1)
    binned = j.groupBy("feature", b.alias("bin")).agg(F.count_if(F.expr("side = 'ref'")).alias("ref"), F.count_if(F.expr("side = 'cur'")).alias("cur"))
    return _psi(binned, 1e-6).select("feature", F.round("psi", 7).alias("psi"))


#: PSI limits (warning, error, critical) of a feature; others than the default are overrides.
PSI_LIMITS = {"": (0.10, 0.20, 0.25), "ens": (0.05, 0.15, 0.20)}


def psi_level(feature: Column, psi: Column) -> Column:
    """OK, WARNING, ERROR or CRITICAL by the feature's limits."""
    def by(limits: tuple) -> Column:
        return F.when(psi >= limits[2], "CRITICAL").when(psi >= limits[1], "ERROR").when(psi >= limits[0], "WARNING").otherwise("OK")

    out = by(PSI_LIMITS[""])
    for name, limits in PSI_LIMITS.items():
        if name:
            out = F.when(feature == name, by(limits)).otherwise(out)
    return out


def drift_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Level per feature, and whether at least three features drifted."""
    p = psi_equal_width(spark, d)
    level = psi_level(F.col("feature"), F.col("psi"))
    return p.agg(F.count_if(F.expr("psi > 0.2")).alias("drifted"), (F.count_if(F.expr("psi > 0.2")) >= 3).alias("drift"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "feature", level))), ",").alias("levels"))


def psi_history(spark: SparkSession, d: str) -> DataFrame:
    """PSI of each model's scores per day of labels from the middle of March on, against the labels before: feature, day, psi, level.

    Ten equal bins over the reference's range; values outside fall into the first
    and the last.
    """
    edge = F.lit("2026-03-15 00:00:00").cast("timestamp_ntz")
    f = _feedback(spark, d).filter("at IS NOT NULL")
    x = f.select("at", F.explode(F.array(*[F.struct(F.lit(m).alias("feature"), F.col(m).cast("double").alias("x")) for m in ("rf", "xg", "lg", "ens")])).alias("e")).select("at", "e.*").filter("x IS NOT NULL")
    ref, cur = x.filter(F.col("at") < edge), x.filter(F.col("at") >= edge)
    r = ref.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).filter("hi > lo")
    b = F.greatest(F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10), F.lit(9)), F.lit(0)).cast("int")
    # features times ten bins, and days times these
    base = ref.join(r, "feature").groupBy("feature", b.alias("bin")).agg(F.count(F.lit(1)).alias("ref"))
    now = cur.join(r, "feature").groupBy("feature", F.to_date("at").alias("day"), b.alias("bin")).agg(F.count(F.lit(1)).alias("cur"))
    grid = now.select("feature", "day").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(9))))
    full = grid.join(base, ["feature", "bin"], "left").join(now, ["feature", "day", "bin"], "left").fillna(0, ["ref", "cur"])
    by = Window.partitionBy("feature", "day")
    p, q = F.greatest(F.col("ref") / F.sum("ref").over(by), F.lit(1e-10)), F.greatest(F.col("cur") / F.sum("cur").over(by), F.lit(1e-10))
    psi = full.select("feature", "day", ((q - p) * F.log(q / p)).alias("t")).groupBy("feature", "day").agg(F.round(F.greatest(F.sum("t"), F.lit(0.0)), 7).alias("psi"))
    return psi.select("feature", F.date_format("day", "yyyy-MM-dd").alias("day"), "psi", psi_level(F.col("feature"), F.col("psi")).alias("level"))


def psi_latest(spark: SparkSession, d: str) -> DataFrame:
    """Newest PSI per feature."""
    return psi_history(spark, d).groupBy("feature").agg(F.max_by(F.struct("day", "psi", "level"), "day").alias("x")).select("feature", "x.*")


def psi_trend(spark: SparkSession, d: str) -> DataFrame:
    """Per feature: newest PSI minus the last one from before the newest 24 hours, else minus the first within; null with a single value.

    Rising above 0.02, falling below -0.02, else stable.
    """
    h = psi_history(spark, d).withColumn("at", F.to_date("day"))
    newest = h.agg(F.max("at").alias("newest"))
    inside = F.col("at") >= F.col("newest")
    x = h.join(F.broadcast(newest)).groupBy("feature").agg(
        F.max_by(F.when(inside, F.col("psi")), F.when(inside, F.col("at"))).alias("now"), F.max_by(F.when(~inside, F.col("psi")), F.when(~inside, F.col("at"))).alias("before"),
        F.min_by(F.when(inside, F.col("psi")), F.when(inside, F.col("at"))).alias("first"), F.count_if(inside).alias("k"),
    )
    delta = F.round(F.col("now") - F.coalesce("before", F.when(F.col("k") > 1, F.col("first"))), 7)
    return x.select("feature", delta.alias("delta"), F.when(delta > 0.02, "RISING").when(delta < -0.02, "FALLING").otherwise("STABLE").alias("trend"))


def ks_two_sample(spark: SparkSession, d: str) -> DataFrame:
    """Largest gap between the two sides' distribution functions per feature.

    Counts are summed per distinct value first; the running sums are over
    distinct values.
    """
    v = _psi_sides(spark, d).groupBy("feature", "x").agg(F.count_if(F.expr("side = 'ref'")).alias("r"), F.count_if(F.expr("side = 'cur'")).alias("c"))
    by, all_ = Window.partitionBy("feature").orderBy("x"), Window.partitionBy("feature")
    gap = F.abs(F.sum("r").over(by) / F.sum("r").over(all_) - F.sum("c").over(by) / F.sum("c").over(all_))
    g = v.select("feature", gap.alias("gap"), F.sum("r").over(all_).alias("nr"), F.sum("c").over(all_).alias("nc"))
    return g.groupBy("feature").agg(F.round(F.max("gap"), 9).alias("ks"), F.max("nr").alias("reference"), F.max("nc").alias("current"))


def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = _feedback(spark, d).groupBy("analyst").agg(*_confusion(F.col("y"), F.col("ens") >= 50))
    return c.select("analyst", "tp", "fp", "fn", "tn", *_rates())


def auc_roc(spark: SparkSession, d: str) -> DataFrame:
    """Area under the ROC curve and average precision of each model, ties shared.

    Counts per distinct score first, then running sums over distinct scores:
    within slices of a thousandth of the range, laid over the slices' totals.
    """
    f = _feedback(spark, d).select("y", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (F.col(m).cast("double") / (100 if m == "ens" else 1)).alias("s")) for m in ("rf", "xg", "lg", "ens")])).alias("e"))
    v = f.select("y", "e.*").filter("s IS NOT NULL").groupBy("model", "s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).withColumn("slice", F.floor(F.col("s") * 1000))
    # a thousand slices per model
    totals = v.groupBy("model", "slice").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
    up = Window.partitionBy("model").orderBy("slice")
    all_ = Window.partitionBy("model")
    totals = totals.select(
        "model", "slice", (F.sum("sn").over(up) - F.col("sn")).alias("n_below"), (F.sum("sp").over(up) - F.col("sp")).alias("p_below"),
        F.sum("sp").over(all_).alias("np"), F.sum("sn").over(all_).alias("nn"),
    )
    by = Window.partitionBy("model", "slice").orderBy("s")
    x = v.join(totals, ["model", "slice"]).select(
        "model", "p", "n", "np", "nn", (F.col("n_below") + F.sum("n").over(by) - F.col("n")).alias("below"), (F.col("p_below") + F.sum("p").over(by) - F.col("p")).alias("p_under"),
    )
    hits, all_up = F.col("np") - F.col("p_under"), F.col("np") - F.col("p_under") + F.col("nn") - F.col("below")
    x = x.select("model", "p", "np", "nn", (F.col("p") * (F.col("below") + F.col("n") / 2)).alias("wins"), (hits / all_up).alias("prec"))
    return x.groupBy("model").agg(
        F.round(ratio(F.sum("wins"), F.max("np") * F.max("nn")), 9).alias("auc"), F.round(ratio(F.sum(F.col("p") * F.col("prec")), F.max("np")), 9).alias("average_precision")
    )


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    t = _feedback(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(k) for k in (50, 60, 70, 80, 90)])))
    return t.groupBy("threshold").agg(*_confusion(F.col("y"), F.col("ens") >= F.col("threshold"))).select("threshold", "tp", "fp", "fn", "tn", *_rates())


def divergence_report(spark: SparkSession, d: str) -> DataFrame:
    """Divergence of two models: count, mean, nearest-rank 95th percentile, share above 0.5."""
    x = _feedback(spark, d).select(F.abs(F.col("rf") - F.col("xg")).alias("v")).filter("v IS NOT NULL")
    return x.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY v)"), 9).alias("p95"),
        F.round(F.avg((F.col("v") > 0.5).cast("double")), 9).alias("above"),
    )


def vote_tally(spark: SparkSession, d: str) -> DataFrame:
    """Latest vote of each analyst per wallet. A proposal passes with more than half of all analysts for it; a dispute with three votes or more is upheld by two thirds of them."""
    f = _feedback(spark, d)
    v = f.groupBy("wallet", "analyst").agg(F.max_by("y", F.struct("at", "id")).alias("y"))
    people = f.agg(F.countDistinct("analyst").alias("people"))
    t = v.groupBy("wallet").agg(F.count_if(F.expr("y = 1")).alias("approve"), F.count(F.lit(1)).alias("votes")).join(F.broadcast(people))
    passed = F.when(F.col("approve") >= F.floor(F.col("people") * 0.5) + 1, "passed").otherwise("rejected")
    dispute = F.when(F.col("votes") < 3, "open").when(F.col("approve") * 3 >= F.col("votes") * 2, "upheld").otherwise("dismissed")
    return t.select("wallet", "approve", "votes", passed.alias("proposal"), dispute.alias("dispute"))


def beta_weights(spark: SparkSession, d: str) -> DataFrame:
    """Model weights from feedback: mode of a Beta posterior with prior (2, 2), normalised."""
    f = _feedback(spark, d).select("y", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in ("rf", "xg", "lg")])).alias("e")).select("y", "e.*").filter("p IS NOT NULL")
    good = F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))
    a = f.groupBy("model").agg((2 + F.sum(good)).alias("a"), (2 + F.sum(1 - good)).alias("b"))
    mode = F.greatest((F.col("a") - 1) / (F.col("a") + F.col("b") - 2), F.lit(1e-9))
    m = a.withColumn("m", mode)
    # one row per model
    return m.select("model", F.round(F.col("m") / F.sum("m").over(Window.partitionBy()), 9).alias("weight"))


def heatmap_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Mean model score per week, one column per model, empty cells zero."""
    f = _feedback(spark, d)
    week = F.date_format(F.date_trunc("week", "at"), "yyyy-MM-dd")
    return f.groupBy(week.alias("week")).agg(*[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 8).alias(m) for m in ("rf", "xg", "lg")])


def risk_score_blend(spark: SparkSession, d: str) -> DataFrame:
    """Score per wallet: 30 % capped digit deviation, 70 % mean model probability, rounded half to even."""
    from marlspike.functions import benford as b

    h = wallet_rows(spark, d).groupBy("wallet").agg(*b.digit_counts(b.leading_digit(F.col("amount"))))
    n = b.total(b.counts())
    mad = h.select("wallet", F.round(b.mean_deviation(b.counts(), n), 9).alias("mad"))
    p = _feedback(spark, d).groupBy("wallet").agg(F.round(F.avg((F.col("rf") + F.col("xg") + F.col("lg")) / 3), 9).alias("p"))
    s = 0.3 * F.least(F.col("mad") / 0.015, F.lit(1.0)) * 100 + 0.7 * F.col("p") * 100
    return mad.join(p, "wallet").select("wallet", F.greatest(F.least(F.bround(s, 0), F.lit(100.0)), F.lit(0.0)).cast("int").alias("score"), (F.col("mad") > 0.015).alias("benford_flag"), (F.col("p") >= 0.5).alias("ml_flag"))


def adversarial_boost(spark: SparkSession, d: str) -> DataFrame:
    """Ensemble score with the disagreement of models as boost above 0.6, at most 20 points."""
    f = _feedback(spark, d).filter("rf IS NOT NULL AND xg IS NOT NULL AND lg IS NOT NULL AND ens IS NOT NULL")
    m = (F.col("rf") + F.col("xg") + F.col("lg")) / 3
    sd = F.sqrt((F.pow(F.col("rf") - m, 2) + F.pow(F.col("xg") - m, 2) + F.pow(F.col("lg") - m, 2)) / 3)
    spread = F.least(F.lit(1.0), F.round(sd, 9) * 2.5)
    boost = F.when(spread > 0.6, 20 * (spread - 0.6) / 0.4).otherwise(0.0)
    return f.select("id", F.round(F.least(F.lit(100.0), F.col("ens") + boost), 9).alias("score"), F.round(1 - sd, 7).alias("confidence"))


def conformal_quantile(spark: SparkSession, d: str) -> DataFrame:
    """Split-conformal quantiles of the residual |y - score| at several levels, and their coverage."""
    f = _feedback(spark, d).select(F.abs(F.col("y") - F.col("ens") / 100).alias("e")).filter("e IS NOT NULL")
    n = f.count()
    # positions of the sorted residuals, found among counts per distinct residual
    v = f.groupBy(F.round("e", 4).alias("e")).agg(F.count(F.lit(1)).alias("c"))
    run = v.withColumn("upto", F.sum("c").over(Window.orderBy("e")))  # at most 101 distinct residuals
    levels = [0.05, 0.1, 0.2]
    return run.agg(
        *[F.min(F.when(F.col("upto") >= min(n, int(np.ceil((n + 1) * (1 - a)))), F.col("e"))).alias(f"q{int(a * 100):02d}") for a in levels]
    ).select(F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"q{int(a * 100):02d}").alias("quantile")) for a in levels])).alias("x")).select("x.*")


#: RAPS: weight of the rank penalty, ranks without one, share of sets that may miss.
RAPS_WEIGHT, RAPS_FREE, RAPS_MISS = 0.2, 2, 0.10


def _raps(spark: SparkSession, d: str) -> DataFrame:
    """Labels with the RAPS score of each of three classes (clean, wash, unsure) as s0, s1, s2; the true class has s_true.

    A class's score is the probability of all classes as probable or more in
    descending order, itself included (equal ones in class order), plus the
    weight times the ranks beyond the free ones.
    """
    f = _feedback(spark, d).filter("ens IS NOT NULL")
    p = F.col("ens") / 100
    probs = [("0", F.round((1 - p) * 0.9, 9)), ("1", F.round(p * 0.9, 9)), ("2", F.lit(0.1))]
    scores = []
    for i, (k, x) in enumerate(probs):
        ahead = [(q, (q > x) if j > i else (q >= x)) for j, (_, q) in enumerate(probs) if j != i]
        rank = sum((a.cast("int") for _, a in ahead), F.lit(1))
        mass = sum((F.when(a, q).otherwise(0.0) for q, a in ahead), x)
        scores.append(F.round(mass + RAPS_WEIGHT * F.greatest(rank - RAPS_FREE, F.lit(0)), 9).alias(f"s{k}"))
    s = f.select("id", "y", *scores)
    return s.withColumn("s_true", F.when(F.col("y") == 0, F.col("s0")).otherwise(F.col("s1")))


def raps_sets(spark: SparkSession, d: str) -> DataFrame:
    """Prediction sets at the calibrated threshold: how many of each size, and how many hold the true class.

    The threshold is the least score at or above the quantile's place among the
    sorted scores of the true classes, found among counts per distinct score
    (there are as many as distinct ensemble scores).
    """
    s = durable(_raps(spark, d), "raps")
    n = s.count()
    level = min(1.0, math.ceil((1 - RAPS_MISS) * (1 + 1 / n)) / (1 + 1 / n)) if n else 1.0
    place = math.ceil((n - 1) * level - 1e-9) + 1
    run = s.groupBy("s_true").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy("s_true")))
    limit = run.filter(F.col("upto") >= place).agg(F.min("s_true").alias("q"))
    sets = s.join(F.broadcast(limit)).select("s_true", "q", sum(((F.col(f"s{k}") <= F.col("q")).cast("int") for k in range(3)), F.lit(0)).alias("set_size"))
    return sets.groupBy("set_size").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("s_true") <= F.col("q")).alias("covered"), F.max("q").alias("threshold"))


def score_classes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "risk_scores").filter("score BETWEEN 0 AND 100")
    k = F.when(F.col("score") <= 33, 0).when(F.col("score") <= 66, 1).otherwise(2)
    return s.groupBy(k.alias("class")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("confidence"), 8).alias("confidence"))


def error_budget(spark: SparkSession, d: str) -> DataFrame:
    """Budget left per analyst: (1 - actual / allowed error) * 100 with 10 % allowed; no labels give 100."""
    f = _feedback(spark, d).groupBy("analyst").agg(F.avg((F.col("y") != (F.col("ens") >= 50).cast("int")).cast("double")).alias("e"))
    return f.select("analyst", F.round((1 - F.col("e") / 0.1) * 100, 2).alias("budget"))


def evasion_counts(spark: SparkSession, d: str) -> DataFrame:
    """Positives scored below a threshold, in the newest 30 days and before."""
    f = _feedback(spark, d).filter("y = 1")
    fresh = F.col("at") > F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 30 DAYS")
    return f.groupBy(fresh.alias("recent")).agg(F.count_if(F.expr("ens < 50")).alias("evaded"), F.count(F.lit(1)).alias("positives"), F.round(F.avg((F.col("ens") < 50).cast("double")), 9).alias("rate"))


def weighted_vector_mean(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean of the embeddings per label: weights 1 + id mod 5, elementwise, clipped to -1..1."""
    v = table(spark, d, "embeddings").select("label", (1 + F.col("vec_id") % 5).cast("double").alias("w"), F.posexplode("embedding").alias("p", "x"))
    m = v.groupBy("label", "p").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("m"))
    return m.select("label", F.col("p").alias("dim"), F.round(clip(F.col("m"), -1.0, 1.0), 8).alias("mean"))


def weight_share_cap(spark: SparkSession, d: str) -> DataFrame:
    """Analysts' shares of labels, none above 8 %: excess is spread over the others, in closed form by sorted prefix sums."""
    f = _feedback(spark, d).groupBy("analyst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    # one row per analyst
    desc = Window.orderBy(F.col("w").desc(), "analyst")
    total = F.sum("w").over(Window.partitionBy())
    x = f.select("analyst", "w", F.row_number().over(desc).alias("k"), F.sum("w").over(desc).alias("top"), total.alias("all"))
    cap = 0.08
    # with the k largest clamped, the rest is scaled by (1 - k cap) / (all - top); k is the least for which the next fits
    nxt = F.lead("w").over(desc)
    fits = F.coalesce(nxt * (1 - F.col("k") * cap) / (F.col("all") - F.col("top")) <= cap, F.lit(True))
    none = F.max("w").over(Window.partitionBy()) / F.col("all") <= cap
    y = x.select("*", F.when(none, 0).otherwise(F.min(F.when(fits, F.col("k"))).over(Window.partitionBy())).alias("clamped"))
    z = y.withColumn("rest", F.col("all") - F.coalesce(F.max(F.when(F.col("k") == F.col("clamped"), F.col("top"))).over(Window.partitionBy()), F.lit(0.0)))
    share = F.when(F.col("k") <= F.col("clamped"), cap).otherwise(F.col("w") * (1 - F.col("clamped") * cap) / F.col("rest"))
    return z.select("analyst", F.round(share, 9).alias("share"))


def importance_stability(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of the ten most traded pairs in two halves of time; an absent pair has rank 11."""
    t = trades(spark, d)
    half = F.col("ts") < F.lit("2026-03-15 00:00:00").cast("timestamp_ntz")
    n = t.groupBy("pair_key").agg(F.count_if(half).alias("a"), F.count_if(~half).alias("b"))
    ra = n.filter("a > 0").orderBy(F.col("a").desc(), "pair_key").limit(10).withColumn("ra", F.row_number().over(Window.orderBy(F.col("a").desc(), "pair_key"))).select("pair_key", "ra")
    rb = n.filter("b > 0").orderBy(F.col("b").desc(), "pair_key").limit(10).withColumn("rb", F.row_number().over(Window.orderBy(F.col("b").desc(), "pair_key"))).select("pair_key", "rb")
    j = ra.join(rb, "pair_key", "full").select(F.coalesce("ra", F.lit(11)).cast("double").alias("ra"), F.coalesce("rb", F.lit(11)).cast("double").alias("rb"))
    return j.agg(F.count(F.lit(1)).alias("pairs"), F.round(safe_corr(F.col("ra"), F.col("rb")), 8).alias("rho"))


def partial_correlations(spark: SparkSession, d: str) -> DataFrame:
    """Partial correlation of each model with the label given the other two, from one pass of moments."""
    f = _feedback(spark, d).filter("rf IS NOT NULL AND xg IS NOT NULL AND lg IS NOT NULL")
    names = ["y", "rf", "xg", "lg"]
    row = f.agg(*[safe_corr(F.col(a), F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i + 1 :]], F.count(F.lit(1)).alias("n")).first()
    m = np.eye(4)
    for i, a in enumerate(names):
        for j, b in enumerate(names[i + 1 :], i + 1):
            m[i, j] = m[j, i] = row[f"{a}_{b}"] or 0.0
    inv = np.linalg.pinv(m)
    out = []
    for i, name in enumerate(names[1:], 1):
        r = float(-inv[0, i] / np.sqrt(inv[0, 0] * inv[i, i]))
        z = 0.5 * float(np.log((1 + r) / (1 - r))) * np.sqrt(max(0, row["n"] - 2 - 3))
        out.append((name, round(r, 8), bool(abs(z) > 2.5758)))
    return spark.createDataFrame(out, "model string, partial double, dependent boolean")


def logistic_scores(spark: SparkSession, d: str) -> DataFrame:
    """Logistic regression of the label on the three models, trained here: accuracy on later labels, coefficients' sum."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    f = _feedback(spark, d).filter("rf IS NOT NULL AND xg IS NOT NULL AND lg IS NOT NULL")
    v = VectorAssembler(inputCols=["rf", "xg", "lg"], outputCol="features").transform(f)
    edge = F.lit("2026-04-01 00:00:00").cast("timestamp_ntz")
    model = LogisticRegression(labelCol="y", regParam=0.01, maxIter=50).fit(v.filter(F.col("at") < edge))
    p = model.transform(v.filter(F.col("at") >= edge)).select("y", vector_to_array("probability")[1].alias("p"))
    return p.agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("y") == (F.col("p") >= 0.5).cast("int")).cast("double")).alias("accuracy"), F.avg("p").alias("mean_p"))


QUERIES = {
    f.__name__: f
    for f in (
        volume_matrix, spearman_pairs, shared_wallets, causal_panel, treatment_effect, five_minute_bins, ffill_bfill, pairwise_corr,
        sliding_sequences, trade_sequences, alert_state_machine, hash_chain_verify, time_decay, walk_forward, cusum, page_hinkley,
        adwin, psi_equal_width, psi_quantile, drift_verdict, psi_trend, ks_two_sample, confusion_metrics, auc_roc, threshold_sweep,
        divergence_report, vote_tally, beta_weights, heatmap_pivot, risk_score_blend, adversarial_boost, conformal_quantile,
        raps_sets, score_classes, error_budget, evasion_counts, weighted_vector_mean, weight_share_cap, importance_stability,
        partial_correlations, logistic_scores,
        psi_history, psi_latest,
    )
}

_RATE = """round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
  round(coalesce(2*tp / nullif(2*tp + fp + fn, 0), 0), 9) AS f1"""


def _conf(hit: str) -> str:
    return (
        f"count(*) FILTER (y = 1 AND {hit}) AS tp, count(*) FILTER (y = 0 AND {hit}) AS fp, "
        f"count(*) FILTER (y = 1 AND NOT {hit}) AS fn, count(*) FILTER (y = 0 AND NOT {hit}) AS tn"
    )


_SIDES = f"""{_F}, sides AS (SELECT * FROM (
  {' UNION ALL '.join(f"SELECT CASE WHEN tm < TIMESTAMP '2026-03-15 00:00:00' THEN 'ref' ELSE 'cur' END AS side, '{m}' AS feature, CAST({m} AS DOUBLE) AS x FROM fb" for m in ('rf', 'xg', 'lg', 'ens'))}
) WHERE x IS NOT NULL)"""
_PSI = """t AS (SELECT feature, sum(ref) AS nr, sum(cur) AS nc FROM full_ GROUP BY 1),
pq AS (SELECT f.feature, greatest(ref / nr, {eps}) AS p, greatest(cur / nc, {eps}) AS q FROM full_ f JOIN t ON t.feature = f.feature),
psi AS (SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM pq GROUP BY 1)"""
_PSI_W = f"""WITH {_SIDES}, r AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM sides GROUP BY 1),
b AS (SELECT s.feature, least(floor((x - lo) / (hi - lo) * 10), 9)::INT AS bin, count(*) FILTER (side = 'ref') AS ref, count(*) FILTER (side = 'cur') AS cur FROM sides s JOIN r ON r.feature = s.feature WHERE hi > lo GROUP BY ALL),
full_ AS (SELECT g.feature, g.bin, coalesce(ref, 0) AS ref, coalesce(cur, 0) AS cur FROM (SELECT feature, unnest(generate_series(0, 9)) AS bin FROM r) g LEFT JOIN b ON b.feature = g.feature AND b.bin = g.bin),
{_PSI.format(eps='1e-10')}, w AS (SELECT feature, round(greatest(psi, 0), 7) AS psi FROM psi)"""
_LEVEL = """CASE WHEN feature = 'ens' THEN CASE WHEN psi >= 0.2 THEN 'CRITICAL' WHEN psi >= 0.15 THEN 'ERROR' WHEN psi >= 0.05 THEN 'WARNING' ELSE 'OK' END ELSE CASE WHEN psi >= 0.25 THEN 'CRITICAL' WHEN psi >= 0.2 THEN 'ERROR' WHEN psi >= 0.1 THEN 'WARNING' ELSE 'OK' END END"""
_FILL = """sc AS (SELECT * FROM risk_scores WHERE asset_pair IS NOT NULL AND timestamp IS NOT NULL),
dly AS (SELECT asset_pair, CAST(timestamp AS DATE) AS day, avg(score) AS m FROM sc WHERE score BETWEEN 0 AND 100 GROUP BY ALL),
gd AS (SELECT asset_pair, CAST(unnest(generate_series((SELECT min(timestamp)::DATE FROM sc), (SELECT max(timestamp)::DATE FROM sc), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT asset_pair FROM sc)),
fill AS (SELECT g.asset_pair, strftime(g.day, '%Y-%m-%d') AS day, round(coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY g.asset_pair ORDER BY g.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(m IGNORE NULLS) OVER (PARTITION BY g.asset_pair ORDER BY g.day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 20.0), 6) AS score FROM gd g LEFT JOIN dly ON dly.asset_pair = g.asset_pair AND dly.day = g.day)"""
_HIST = f"""WITH {_F}, x AS ({' UNION ALL '.join(f"SELECT tm, '{m}' AS feature, CAST({m} AS DOUBLE) AS x FROM fb WHERE tm IS NOT NULL AND {m} IS NOT NULL" for m in ('rf', 'xg', 'lg', 'ens'))}),
r AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM x WHERE tm < TIMESTAMP '2026-03-15 00:00:00' GROUP BY 1 HAVING max(x) > min(x)),
b AS (SELECT x.feature, tm, greatest(least(floor((x - lo) / (hi - lo) * 10), 9), 0)::INT AS bin FROM x JOIN r ON r.feature = x.feature),
ref AS (SELECT feature, bin, count(*) AS n FROM b WHERE tm < TIMESTAMP '2026-03-15 00:00:00' GROUP BY ALL),
cur AS (SELECT feature, CAST(tm AS DATE) AS day, bin, count(*) AS n FROM b WHERE tm >= TIMESTAMP '2026-03-15 00:00:00' GROUP BY ALL),
g AS (SELECT DISTINCT feature, day, bin FROM (SELECT DISTINCT feature, day FROM cur), (SELECT unnest(generate_series(0, 9)) AS bin)),
f AS (SELECT g.*, coalesce(ref.n, 0) AS p, coalesce(cur.n, 0) AS q FROM g LEFT JOIN ref ON ref.feature = g.feature AND ref.bin = g.bin LEFT JOIN cur ON cur.feature = g.feature AND cur.day = g.day AND cur.bin = g.bin),
s AS (SELECT feature, day, greatest(p / sum(p) OVER w, 1e-10) AS p, greatest(q / sum(q) OVER w, 1e-10) AS q FROM f WINDOW w AS (PARTITION BY feature, day)),
h AS (SELECT feature, strftime(day, '%Y-%m-%d') AS day, round(greatest(sum((q - p) * ln(q / p)), 0), 7) AS psi FROM s GROUP BY feature, s.day),
hist AS (SELECT *, {_LEVEL} AS level FROM h)"""
_KINDS = ["click", "error", "purchase", "signup", "view"]
_E50 = "(y <> (ens >= 50)::INT)::INT"

_LAW = [math.log10(1 + 1 / k) for k in range(1, 10)]
_DIGIT = "CASE WHEN amount > 0 THEN CAST(nullif(regexp_extract(CAST(amount AS VARCHAR), '[1-9]'), '') AS INT) END"

def _given(a: str, z: str, c: str) -> str:
    """Partial correlation of two names given a third, as SQL over columns r_a_b."""
    return f"(({_r(a, z)}) - ({_r(a, c)}) * ({_r(z, c)})) / sqrt((1 - pow({_r(a, c)}, 2)) * (1 - pow({_r(z, c)}, 2)))"


def _r(a: str, z: str) -> str:
    return "r_" + "_".join(sorted((a, z)))


def _given_two(a: str, c: str, e: str) -> str:
    x, y, z = _given("y", a, c), _given("y", e, c), _given(a, e, c)
    return f"(({x}) - ({y}) * ({z})) / sqrt((1 - pow({y}, 2)) * (1 - pow({z}, 2)))"


ORACLE = {
    "risk_score_blend": f"""WITH {WALLET_SQL}, {_F}, g AS (SELECT wallet, {_DIGIT} AS dg FROM wrows),
m AS (SELECT wallet, round(({' + '.join(f'abs(count(*) FILTER (dg = {k}) / count(dg) - {_LAW[k-1]!r})' for k in range(1, 10))}) / 9, 9) AS mad FROM g GROUP BY 1),
p AS (SELECT wallet, round(avg((rf + xg + lg) / 3), 9) AS p FROM fb GROUP BY 1)
SELECT m.wallet, CAST(greatest(least(round_even(0.3::DOUBLE * least(mad / 0.015::DOUBLE, 1.0) * 100 + 0.7::DOUBLE * p * 100, 0), 100), 0) AS INT) AS score, mad > 0.015 AS benford_flag, p >= 0.5 AS ml_flag
FROM m JOIN p ON p.wallet = m.wallet""",
    "volume_matrix": f"""WITH {ACTIVITY_SQL}, a AS (SELECT *, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2000-01-01') AS w FROM activity WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 30 DAY AND ts <= TIMESTAMP '2024-01-30 00:00:00')
SELECT strftime(w, '%Y-%m-%d %H:%M') AS slice, {', '.join(f"round(coalesce(sum(amount) FILTER (pair = '{k}'), 0), 4) AS {k}" for k in _KINDS)} FROM a GROUP BY w""",
    "spearman_pairs": f"""WITH {TRADES_SQL}, dl AS (SELECT pair_key, CAST(ts AS DATE) AS day, round(sum(amount), 6) AS v FROM trades GROUP BY ALL),
p AS (SELECT pair_key FROM dl WHERE v > 0 GROUP BY 1 HAVING count(*) >= 10),
g AS (SELECT p.pair_key, c.day, coalesce(v, 0) AS v FROM p CROSS JOIN (SELECT DISTINCT day FROM dl) c LEFT JOIN dl ON dl.pair_key = p.pair_key AND dl.day = c.day),
r AS (SELECT *, rank() OVER (PARTITION BY pair_key ORDER BY v) + (count(*) OVER (PARTITION BY pair_key, v) - 1) / 2 AS r FROM g)
SELECT x.pair_key, y.pair_key AS other, count(*) FILTER (x.v > 0 AND y.v > 0) AS days, round(covar_pop(x.r, y.r) / nullif(stddev_pop(x.r) * stddev_pop(y.r), 0), 6) AS r
FROM r x JOIN r y ON x.day = y.day AND x.pair_key < y.pair_key GROUP BY 1, 2""",
    "shared_wallets": f"""WITH {WALLET_SQL}, p AS (SELECT DISTINCT wallet, pair_key FROM wrows)
SELECT a.pair_key, b.pair_key AS other, count(*) AS wallets FROM p a JOIN p b ON a.wallet = b.wallet AND a.pair_key < b.pair_key GROUP BY 1, 2""",
    "causal_panel": f"""WITH {ACTIVITY_SQL}, r AS (SELECT *, date_trunc('hour', ts) AS h, row_number() OVER (PARTITION BY pair, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS rn FROM activity),
h AS (SELECT pair, h, max(amount) FILTER (rn = 1) AS last, sum(amount) AS volume, max((wallet % 7 = 0)::INT) AS treated FROM r GROUP BY 1, 2)
SELECT pair, strftime(h, '%Y-%m-%d %H') AS hour, treated, volume, round(lead(last) OVER w - last, 6) AS next_change,
  round(coalesce(stddev_samp(last) OVER (PARTITION BY pair ORDER BY h ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0), 6) AS volatility FROM h WINDOW w AS (PARTITION BY pair ORDER BY h)""",
    "five_minute_bins": f"""WITH {ACTIVITY_SQL}, m AS (SELECT pair, max(ts) AS hi FROM activity GROUP BY 1),
b AS (SELECT a.pair, CAST(floor((epoch_us(ts) - epoch_us(hi - INTERVAL 168 HOUR)) / 300000000) AS INT) AS bin, count(*) AS n, sum(amount) AS v FROM activity a JOIN m ON m.pair = a.pair WHERE ts >= hi - INTERVAL 168 HOUR GROUP BY ALL)
SELECT g.pair, CAST(g.bin AS INT) AS bin, coalesce(n, 0) AS events, round(coalesce(log10(v + 1e-9), 0), 8) AS log_volume FROM (SELECT pair, unnest(generate_series(0, 2015)) AS bin FROM m) g LEFT JOIN b ON b.pair = g.pair AND b.bin = g.bin""",
    "ffill_bfill": f"WITH {_FILL} SELECT * FROM fill",
    "pairwise_corr": f"""WITH {_FILL}, sd AS (SELECT asset_pair, stddev_pop(score) AS sd FROM fill GROUP BY 1), f AS (SELECT fill.*, sd FROM fill JOIN sd USING (asset_pair) WHERE sd > 1e-12),
c AS (SELECT a.asset_pair, covar_pop(a.score, b.score) / (min(a.sd) * min(b.sd)) AS r FROM f a JOIN f b ON a.day = b.day AND a.asset_pair <> b.asset_pair GROUP BY a.asset_pair, b.asset_pair),
m AS (SELECT asset_pair, round(avg(r), 5) AS mean_r FROM c GROUP BY 1)
SELECT sd.asset_pair, mean_r FROM sd LEFT JOIN m ON m.asset_pair = sd.asset_pair""",
    "sliding_sequences": f"""WITH {_FILL}, s AS (SELECT asset_pair, day, score, list(CAST(round(score * 1000000) AS BIGINT)) OVER (PARTITION BY asset_pair ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS seq FROM fill),
q AS (SELECT *, 30 - len(seq) AS pad FROM s)
SELECT asset_pair, day, CAST(pad AS INT) AS padding, CAST(list_sum(seq) AS BIGINT) AS total, CAST(list_sum(list_transform(range(len(seq)), lambda i: seq[i + 1] * (pad + i + 1))) AS BIGINT) AS weighted, score AS last FROM q""",
    "trade_sequences": f"""WITH {WALLET_SQL}, pn AS (SELECT pair, row_number() OVER (ORDER BY pair) - 1 AS number, count(*) OVER () AS all_ FROM (SELECT DISTINCT pair FROM trades)),
r AS (SELECT *, date_diff('microsecond', lag(ts) OVER w, ts) // 1000000 AS gap, row_number() OVER (PARTITION BY wallet ORDER BY ts DESC, trade_id DESC) AS k FROM wrows WINDOW w AS (PARTITION BY wallet ORDER BY ts, trade_id))
SELECT wallet, CAST(200 - k AS INT) AS position, round(ln(1 + amount), 7) AS log_amount, ((base = wallet) <> coalesce(base_is_seller, FALSE))::INT::DOUBLE AS buys,
  round(ln(1 + greatest(coalesce(gap, 0), 0)::DOUBLE), 7) AS log_gap, round(number / all_, 9) AS pair_share, round((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400.0, 7) AS time_of_day
FROM r JOIN pn ON pn.pair = r.pair WHERE k <= 200""",
    "hash_chain_verify": f"""WITH RECURSIVE {_F}, n AS (SELECT wallet, tm, id, concat_ws('|', wallet, y, ens) AS payload, row_number() OVER (PARTITION BY wallet ORDER BY tm NULLS FIRST, id) AS k FROM fb),
c AS (SELECT wallet, k, id, payload, sha256('genesis|' || payload) AS h FROM n WHERE k = 1
  UNION ALL SELECT n.wallet, n.k, n.id, n.payload, sha256(c.h || '|' || n.payload) FROM c JOIN n ON n.wallet = c.wallet AND n.k = c.k + 1),
t AS (SELECT wallet, k, id, CASE WHEN id % 10 = 7 THEN payload || '!' ELSE payload END AS payload, h FROM c),
v AS (SELECT *, sha256(coalesce(lag(h) OVER (PARTITION BY wallet ORDER BY k), 'genesis') || '|' || payload) <> h AS bad FROM t)
SELECT wallet, count(*) AS events, count(*) FILTER (bad) AS broken, arg_min(id, k) FILTER (bad) AS first_broken FROM v GROUP BY 1""",
    "time_decay": f"""WITH {_F}, w AS (SELECT analyst, y, ens / 100 * exp(-0.05 * ((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(tm)) / 86400e6)) AS w FROM fb)
SELECT analyst, round(sum(w), 6) AS weight, round(sum(y * w), 6) AS positive FROM w GROUP BY 1""",
    "walk_forward": f"""WITH {_F}, s AS (SELECT min(epoch_us(tm)) AS lo, max(epoch_us(tm)) AS hi FROM fb),
x AS (SELECT epoch_us(tm) AS t, fold, lo + (hi - lo) / 6 * fold AS cut, (hi - lo) / 6 AS each FROM fb, s, (SELECT unnest(generate_series(1, 5)) AS fold))
SELECT CAST(fold AS INT) AS fold, count(*) FILTER (t < cut) AS train, count(*) FILTER (t >= cut + 7 * 86400e6 AND t < cut + 7 * 86400e6 + each) AS validate,
  count(*) FILTER (t >= cut AND t < cut + 7 * 86400e6) AS purged FROM x GROUP BY 1 HAVING train > 0 AND validate > 0""",
    "cusum": f"""WITH {_F}, r AS (SELECT tm, id, coalesce((y <> (ens >= 50)::INT)::INT, 0)::DOUBLE AS e, row_number() OVER (ORDER BY tm, id) AS i, count(*) OVER () AS n FROM fb WHERE tm IS NOT NULL),
m AS (SELECT avg(e) AS mu FROM r WHERE i <= greatest(1, n // 4)),
p AS (SELECT tm, i, sum(e - mu - 0.1) OVER (ORDER BY i) AS p FROM r, m WHERE n >= 4 AND i > greatest(1, n // 4)),
s AS (SELECT tm, i, p - least(0, min(p) OVER (ORDER BY i)) AS s FROM p)
SELECT strftime(tm, '%Y-%m-%d') AS day, count(*) AS labels, round(arg_max(s, i), 6) AS cusum, round(max(s), 6) AS highest, max(s) > 5 AS alarm FROM s GROUP BY 1""",
    "page_hinkley": f"""WITH RECURSIVE {ACTIVITY_SQL}, dl AS (SELECT pair, CAST(ts AS DATE) AS day, round(avg(amount), 10) AS x FROM activity GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY day) AS k FROM dl),
m AS (SELECT *, avg(x) OVER (PARTITION BY pair ORDER BY k) AS mean FROM n),
f AS (SELECT pair, 0::BIGINT AS k, 0.0::DOUBLE AS c, 0.0::DOUBLE AS low, 0 AS fired, 0::BIGINT AS last FROM (SELECT DISTINCT pair FROM dl)
  UNION ALL SELECT m.pair, m.k, CASE WHEN u.t - least(low, u.t) > 50 THEN 0 ELSE u.t END, CASE WHEN u.t - least(low, u.t) > 50 THEN 0 ELSE least(low, u.t) END,
    fired + (u.t - least(low, u.t) > 50)::INT, CASE WHEN u.t - least(low, u.t) > 50 THEN m.k ELSE last END
  FROM f JOIN m ON m.pair = f.pair AND m.k = f.k + 1, LATERAL (SELECT f.c + m.x - m.mean - 0.005 AS t) u)
SELECT pair, CAST(k AS INT) AS days, round(c - low, 6) AS statistic, fired AS detections, CAST(last AS INT) AS last_detection FROM f WHERE (pair, k) IN (SELECT pair, max(k) FROM n GROUP BY 1)""",
    "psi_equal_width": f"{_PSI_W} SELECT * FROM w",
    "psi_quantile": f"""WITH {_SIDES}, q AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) FILTER (side = 'ref'))) AS q FROM sides GROUP BY 1),
full_ AS (SELECT s.feature, least(len(list_filter(q, lambda e: e <= x)), len(q) - 1) AS bin, count(*) FILTER (side = 'ref') AS ref, count(*) FILTER (side = 'cur') AS cur FROM sides s JOIN q ON q.feature = s.feature
  WHERE len(q) >= 3 AND x >= q[1] AND x <= q[len(q)] GROUP BY ALL), {_PSI.format(eps='1e-6')} SELECT feature, round(psi, 7) AS psi FROM psi""",
    "drift_verdict": f"""{_PSI_W} SELECT count(*) FILTER (psi > 0.2) AS drifted, count(*) FILTER (psi > 0.2) >= 3 AS drift, string_agg(feature || ':' || {_LEVEL}, ',' ORDER BY feature || ':' || {_LEVEL}) AS levels FROM w""",
    "psi_trend": f"""{_HIST}, nw AS (SELECT max(day) AS newest FROM hist),
px AS (SELECT feature, arg_max(psi, day) FILTER (day >= newest) AS now, arg_max(psi, day) FILTER (day < newest) AS bef, arg_min(psi, day) FILTER (day >= newest) AS first, count(*) FILTER (day >= newest) AS k FROM hist, nw GROUP BY 1),
y AS (SELECT feature, round(now - coalesce(bef, CASE WHEN k > 1 THEN first END), 7) AS delta FROM px)
SELECT feature, delta, CASE WHEN delta > 0.02 THEN 'RISING' WHEN delta < -0.02 THEN 'FALLING' ELSE 'STABLE' END AS trend FROM y""",
    "ks_two_sample": f"""WITH {_SIDES}, v AS (SELECT feature, x, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS c FROM sides GROUP BY ALL),
g AS (SELECT feature, abs(sum(r) OVER (PARTITION BY feature ORDER BY x) / sum(r) OVER (PARTITION BY feature) - sum(c) OVER (PARTITION BY feature ORDER BY x) / sum(c) OVER (PARTITION BY feature)) AS gap, r, c FROM v)
SELECT feature, round(max(gap), 9) AS ks, CAST(sum(r) AS BIGINT) AS reference, CAST(sum(c) AS BIGINT) AS current FROM g GROUP BY 1""",
    "confusion_metrics": f"WITH {_F}, c AS (SELECT analyst, {_conf('ens >= 50')} FROM fb GROUP BY 1) SELECT analyst, tp, fp, fn, tn, {_RATE} FROM c",
    "auc_roc": f"""WITH {_F}, e AS (SELECT * FROM ({' UNION ALL '.join(f"SELECT y, '{m}' AS model, CAST({m} AS DOUBLE) AS s FROM fb" for m in ('rf', 'xg', 'lg', 'ens'))}) WHERE s IS NOT NULL),
v AS (SELECT model, s, sum(y) AS p, sum(1 - y) AS n FROM e GROUP BY ALL),
x AS (SELECT model, p, n, p * (sum(n) OVER (PARTITION BY model ORDER BY s) - n + n / 2) AS wins, sum(p) OVER (PARTITION BY model ORDER BY s DESC) / (sum(p) OVER (PARTITION BY model ORDER BY s DESC) + sum(n) OVER (PARTITION BY model ORDER BY s DESC)) AS prec FROM v)
SELECT model, round(sum(wins) / (sum(p) * sum(n)), 9) AS auc, round(sum(p * prec) / sum(p), 9) AS average_precision FROM x GROUP BY 1""",
    "threshold_sweep": f"WITH {_F}, t AS (SELECT *, unnest([50, 60, 70, 80, 90]) AS threshold FROM fb), c AS (SELECT threshold, {_conf('ens >= threshold')} FROM t GROUP BY 1) SELECT threshold, tp, fp, fn, tn, {_RATE} FROM c",
    "divergence_report": f"WITH {_F}, x AS (SELECT abs(rf - xg) AS v FROM fb WHERE rf IS NOT NULL AND xg IS NOT NULL) SELECT count(*) AS n, round(avg(v), 4) AS mean, round(quantile_disc(v, 0.95), 9) AS p95, round(avg((v > 0.5)::INT), 9) AS above FROM x",
    "vote_tally": f"""WITH {_F}, v AS (SELECT wallet, analyst, y FROM (SELECT *, row_number() OVER (PARTITION BY wallet, analyst ORDER BY tm DESC NULLS LAST, id DESC) AS rn FROM fb) WHERE rn = 1),
t AS (SELECT wallet, count(*) FILTER (y = 1) AS approve, count(*) AS votes FROM v GROUP BY 1), n AS (SELECT count(DISTINCT analyst) AS people FROM fb)
SELECT wallet, approve, votes, CASE WHEN approve >= floor(people * 0.5) + 1 THEN 'passed' ELSE 'rejected' END AS proposal,
  CASE WHEN votes < 3 THEN 'open' WHEN approve * 3 >= votes * 2 THEN 'upheld' ELSE 'dismissed' END AS dispute FROM t, n""",
    "beta_weights": f"""WITH {_F}, e AS (SELECT * FROM ({' UNION ALL '.join(f"SELECT y, '{m}' AS model, {m} AS p FROM fb" for m in ('rf', 'xg', 'lg'))}) WHERE p IS NOT NULL),
a AS (SELECT model, 2 + sum(CASE WHEN y = 1 THEN p ELSE 1 - p END) AS a, 2 + sum(CASE WHEN y = 1 THEN 1 - p ELSE p END) AS b FROM e GROUP BY 1), m AS (SELECT model, greatest((a - 1) / (a + b - 2), 1e-9) AS m FROM a)
SELECT model, round(m / sum(m) OVER (), 9) AS weight FROM m""",
    "heatmap_pivot": f"WITH {_F} SELECT strftime(date_trunc('week', tm), '%Y-%m-%d') AS week, round(coalesce(avg(rf), 0), 8) AS rf, round(coalesce(avg(xg), 0), 8) AS xg, round(coalesce(avg(lg), 0), 8) AS lg FROM fb GROUP BY 1",
    "conformal_quantile": f"""WITH {_F}, e AS (SELECT abs(y - ens / 100) AS e FROM fb WHERE ens IS NOT NULL), r AS (SELECT round(e, 4) AS e, row_number() OVER (ORDER BY e) AS k, count(*) OVER () AS n FROM e), a AS (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS alpha)
SELECT alpha, min(e) FILTER (k >= least(n, ceil((n + 1) * (1 - alpha)))) AS quantile FROM r, a GROUP BY 1""",
    "score_classes": "SELECT CASE WHEN score <= 33 THEN 0 WHEN score <= 66 THEN 1 ELSE 2 END AS class, count(*) AS rows, round(avg(confidence), 8) AS confidence FROM risk_scores WHERE score BETWEEN 0 AND 100 GROUP BY 1",
    "error_budget": f"WITH {_F} SELECT analyst, round((1 - avg({_E50}) / 0.1) * 100, 2) AS budget FROM fb GROUP BY 1",
    "evasion_counts": f"WITH {_F} SELECT tm > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AS recent, count(*) FILTER (ens < 50) AS evaded, count(*) AS positives, round(avg((ens < 50)::INT), 9) AS rate FROM fb WHERE y = 1 GROUP BY 1",
    "weighted_vector_mean": """WITH c AS (SELECT label, 1 + vec_id % 5 AS w, unnest(generate_series(0, 63)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, CAST(dim AS INT) AS dim, round(least(greatest(sum(w*x) / sum(w), -1), 1), 8) AS mean FROM c GROUP BY 1, 2""",
    "importance_stability": f"""WITH {TRADES_SQL}, n AS (SELECT pair_key, count(*) FILTER (ts < TIMESTAMP '2026-03-15 00:00:00') AS a, count(*) FILTER (ts >= TIMESTAMP '2026-03-15 00:00:00') AS b FROM trades GROUP BY 1),
ra AS (SELECT pair_key, row_number() OVER (ORDER BY a DESC, pair_key) AS ra FROM n WHERE a > 0 QUALIFY ra <= 10), rb AS (SELECT pair_key, row_number() OVER (ORDER BY b DESC, pair_key) AS rb FROM n WHERE b > 0 QUALIFY rb <= 10),
j AS (SELECT coalesce(ra, 11)::DOUBLE AS ra, coalesce(rb, 11)::DOUBLE AS rb FROM ra FULL JOIN rb ON ra.pair_key = rb.pair_key)
SELECT count(*) AS pairs, round(covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)), 8) AS rho FROM j""",
    "adversarial_boost": f"""WITH {_F}, m AS (SELECT id, ens, rf, xg, lg, (rf + xg + lg) / 3 AS m FROM fb WHERE rf IS NOT NULL AND xg IS NOT NULL AND lg IS NOT NULL AND ens IS NOT NULL),
s AS (SELECT id, ens, sqrt((pow(rf-m,2) + pow(xg-m,2) + pow(lg-m,2)) / 3) AS sd FROM m), t AS (SELECT *, least(1.0, round(sd, 9) * 2.5) AS sp FROM s)
SELECT id, round(least(100.0, ens + CASE WHEN sp > 0.6 THEN 20 * (sp - 0.6) / 0.4 ELSE 0 END), 9) AS score, round(1 - sd, 7) AS confidence FROM t""",
    "psi_history": f"{_HIST} SELECT * FROM hist",
    "psi_latest": f"{_HIST} SELECT feature, max(day) AS day, arg_max(psi, day) AS psi, arg_max(level, day) AS level FROM hist GROUP BY 1",
    "raps_sets": f"""WITH {_F}, p AS (SELECT id, y, round((1 - ens / 100) * 0.9, 9) AS p0, round(ens / 100 * 0.9, 9) AS p1, 0.1::DOUBLE AS p2 FROM fb WHERE ens IS NOT NULL),
l AS (SELECT id, y, unnest([{{'k': 0, 'p': p0}}, {{'k': 1, 'p': p1}}, {{'k': 2, 'p': p2}}]) AS e FROM p),
r AS (SELECT id, y, e.k AS k, sum(e.p) OVER w AS mass, row_number() OVER w AS rank FROM l WINDOW w AS (PARTITION BY id ORDER BY e.p DESC, e.k ROWS UNBOUNDED PRECEDING)),
s AS (SELECT id, y, k, round(mass + 0.2 * greatest(rank - 2, 0), 9) AS s FROM r), t AS (SELECT id, s FROM s WHERE k = y),
q AS (SELECT list_sort(list(s))[CAST(ceil((count(*) - 1) * least(1.0, ceil(0.9 * (1 + 1.0 / count(*))) / (1 + 1.0 / count(*))) - 1e-9) AS INT) + 1] AS q FROM t),
z AS (SELECT s.id, count(*) FILTER (s.s <= q) AS set_size, max(t.s) AS st, max(q) AS q FROM s JOIN t ON t.id = s.id, q GROUP BY 1)
SELECT CAST(set_size AS INT) AS set_size, count(*) AS rows, count(*) FILTER (st <= q) AS covered, max(q) AS threshold FROM z GROUP BY 1""",
    "alert_state_machine": """WITH RECURSIVE s AS (SELECT wallet, score, row_number() OVER (PARTITION BY wallet ORDER BY timestamp, id, score) AS k FROM risk_scores WHERE wallet IS NOT NULL AND score BETWEEN 0 AND 100 AND timestamp IS NOT NULL),
f AS (SELECT wallet, k, score AS last, score >= 80 AS live, 0 AS below, (score >= 80)::INT AS opened, 0 AS escalated, 0 AS resolved FROM s WHERE k = 1
  UNION ALL SELECT s.wallet, s.k, s.score, CASE WHEN live THEN s.score >= 80 OR below < 2 ELSE s.score >= 80 END, CASE WHEN live AND s.score < 80 AND below < 2 THEN below + 1 ELSE 0 END,
    opened + (NOT live AND s.score >= 80)::INT, escalated + (live AND s.score >= 80 AND s.score > last + 10)::INT, resolved + (live AND s.score < 80 AND below >= 2)::INT
  FROM f JOIN s ON s.wallet = f.wallet AND s.k = f.k + 1)
SELECT wallet, live AS open, opened, escalated, resolved FROM f WHERE (wallet, k) IN (SELECT wallet, max(k) FROM s GROUP BY 1)""",
    "partial_correlations": f"""WITH {_F}, f AS (SELECT * FROM fb WHERE rf IS NOT NULL AND xg IS NOT NULL AND lg IS NOT NULL),
c AS (SELECT count(*) AS n, {', '.join(f"corr({a}, {z}) AS {_r(a, z)}" for a, z in (('y', 'rf'), ('y', 'xg'), ('y', 'lg'), ('rf', 'xg'), ('rf', 'lg'), ('xg', 'lg')))} FROM f),
p AS ({' UNION ALL '.join(f"SELECT '{a}' AS model, n, {_given_two(a, x, e)} AS p FROM c" for a, x, e in (('rf', 'xg', 'lg'), ('xg', 'rf', 'lg'), ('lg', 'rf', 'xg')))})
SELECT model, round(p, 8) AS partial, abs(0.5 * ln((1 + p) / (1 - p)) * sqrt(n - 5)) > 2.5758 AS dependent FROM p""",
    "weight_share_cap": f"""WITH {_F}, w AS (SELECT analyst, count(*)::DOUBLE AS w FROM fb GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY w DESC, analyst) AS k FROM w),
c AS (SELECT k0, (1 - k0 * 0.08::DOUBLE) / (SELECT sum(w) FROM r WHERE k > k0) AS lam FROM (SELECT unnest(generate_series(0, (SELECT count(*) FROM r) - 1)) AS k0)),
v AS (SELECT k0, lam FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k > c.k0 AND r.w * lam > 0.08 + 1e-12) ORDER BY k0 LIMIT 1)
SELECT analyst, round(CASE WHEN k <= k0 THEN 0.08 ELSE w * lam END, 9) AS share FROM r, v""",
}
