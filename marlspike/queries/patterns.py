"""Ordered patterns and cycles: sandwiches, pool sessions, hop cycles, ring lists, and the features made of them.

A handful of planted trades (``PLANTED``) stand beside the given ones where a
pattern is too rare to occur in small tables; they are a part of the input of
both the query and its SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike.functions.cells import micros
from marlspike.functions.stats import exact_sum, ratio
from marlspike.operators.graph import strong_components, trade_edges, wash_rings, weak_components
from marlspike.operators.neighbours import with_neighbours
from marlspike.operators.pairsets import PART, SLOT, best_rank_correlation, near_other_pairs
from marlspike.queries.features import hhi_concentration, pool_round_trip
from marlspike.queries.features import ORACLE as _FEATURE_SQL
from marlspike.queries.graphs import _scc_sql
from marlspike.queries.monitoring import ORACLE as _SERIES_SQL
from marlspike.queries.monitoring import daily_ranks, rank_correlations
from marlspike.queries.views import TRADES_SQL, TRANSFERS_SQL, WALLET_SQL, trades, transfers, wallet_rows
from marlspike.session import durable
from marlspike.sources.plugins import node_table
from marlspike.sources.tables import table

#: Planted trades: id, seconds after 2027-01-01, base, counter, base code, counter code, amount, price, base sells, pool.
PLANTED = [
    # an attacker's buy, two victims' buys, the sale above its price; then a buy nobody follows
    (-1, 0, "GPLANT-A", None, "XLM", "VUSD", 400.0, 1.0, False, "planted"),
    (-2, 0, "GPLANT-V", None, "XLM", "VUSD", 900.0, 1.1, False, "planted"),
    (-3, 5, "GPLANT-W", None, "XLM", "VUSD", 50.0, 1.2, False, "planted"),
    (-4, 10, "GPLANT-A", None, "XLM", "VUSD", 300.0, 1.15, True, "planted"),
    (-5, 20, "GPLANT-A", None, "XLM", "VUSD", 10.0, 1.0, False, "planted"),
    (-6, 30, "GPLANT-A", None, "XLM", "VUSD", 10.0, 9.0, True, "planted"),
    # three hops that come back to their wallet and asset within the hour, and one that loses too much
    (-11, 7200, "GPLANT-B", "GPLANT-C", "XLM", "VUSD", 100.0, 1.0, True, None),
    (-12, 7260, "GPLANT-C", "GPLANT-D", "VUSD", "AQUR", 99.0, 1.0, True, None),
    (-13, 7320, "GPLANT-D", "GPLANT-B", "AQUR", "XLM", 98.0, 1.0, True, None),
    (-14, 14400, "GPLANT-E", "GPLANT-F", "XLM", "VUSD", 100.0, 1.0, True, None),
    (-15, 14460, "GPLANT-F", "GPLANT-G", "VUSD", "AQUR", 80.0, 1.0, True, None),
    (-16, 14520, "GPLANT-G", "GPLANT-E", "AQUR", "XLM", 60.0, 1.0, True, None),
    # a large order-book trade between two of one account that moves the price
    (-21, 21600, "GPLANT-H", "GPLANT-I", "PLANTA", "PLANTB", 10.0, 1.0, False, None),
    (-22, 21601, "GPLANT-J", "GPLANT-I", "PLANTA", "PLANTB", 5000.0, 1.01, False, None),
    (-23, 21602, "GPLANT-H", "GPLANT-I", "PLANTA", "PLANTB", 10.0, 1.05, True, None),
]


def _planted(spark: SparkSession, d: str) -> DataFrame:
    """Trades with the planted ones: trade_id, ts, base, counter, base_code, counter_code, pair, amount, price, base_is_seller, pool."""
    shape = "trade_id long, s int, base string, counter string, base_code string, counter_code string, amount double, price double, base_is_seller boolean, pool string"
    p = spark.createDataFrame(PLANTED, shape)
    p = p.withColumn("ts", F.timestamp_add("SECOND", F.col("s"), F.lit("2027-01-01 00:00:00").cast("timestamp_ntz"))).withColumn("pair", F.concat_ws("/", "base_code", "counter_code"))
    names = ["trade_id", "ts", "base", "counter", "base_code", "counter_code", "pair", "amount", "price", "base_is_seller", "pool"]
    return trades(spark, d).select(*names).unionByName(p.select(*names))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with ledger (dense rank of ts over all rows, from 1) and operation (place within the ledger by trade_id, from 0).

    Ranks are taken within days and laid over the days' numbers of distinct
    times, so all rows are never sorted in one place.
    """
    day = F.to_date("ts")
    cut = rows.withColumn("__d", day)
    # one row per calendar day
    sizes = cut.groupBy("__d").agg(F.countDistinct("ts").alias("k"))
    before = sizes.select("__d", (F.sum("k").over(Window.orderBy("__d")) - F.col("k")).alias("before"))
    placed = cut.join(F.broadcast(before), "__d").withColumn("ledger", (F.col("before") + F.dense_rank().over(Window.partitionBy("__d").orderBy("ts"))).cast("long"))
    return placed.withColumn("operation", F.row_number().over(Window.partitionBy("__d", "ts").orderBy("trade_id")) - 1).drop("__d", "before")


def ordering_columns(spark: SparkSession, d: str) -> DataFrame:
    """Ledger and operation numbers of pool trades, made up from their times."""
    return ordered_rows(_planted(spark, d).filter("pool IS NOT NULL")).select("trade_id", "ledger", "operation")


def sandwich_candidates(rows: DataFrame, least_profit: float = 10.0, gap: int = 2, slippage: float = 0.0, fee: float = 0.0) -> DataFrame:
    """Buys of a pool that their account closes with a dearer sale while others bought in between.

    For each buy the first later sale of the account within ``gap`` ledgers that
    is dearer, has a victim between (the dearest buy of another account, the
    earliest of equals) and clears the profit. Ledgers are few per sandwich, so
    legs and victims meet in equi-joins on pool and ledger.
    """
    o = ordered_rows(rows.filter("pool IS NOT NULL")).withColumn("at", F.struct("ledger", "operation"))
    near = with_neighbours(o.select("pool", "ts", "trade_id", "price"), ["pool"], ["ts", "trade_id"], F.date_trunc("week", "ts"), 1, 0)
    before = near.withColumn("prior", F.lag("price").over(Window.partitionBy("pool", "__chunk").orderBy("ts", "trade_id"))).filter("__own").select("trade_id", "prior")
    buys = o.filter("NOT base_is_seller AND price > 0").join(before, "trade_id").select("pool", "base", F.col("trade_id").alias("buy"), F.col("at").alias("a0"), F.col("price").alias("p0"), F.col("amount").alias("q0"), "prior")
    reach = buys.withColumn("ledger", F.explode(F.sequence(F.col("a0.ledger"), F.col("a0.ledger") + gap)))
    sales = o.filter("base_is_seller").select("pool", "base", "ledger", F.col("trade_id").alias("sale"), F.col("at").alias("a2"), F.col("price").alias("p2"), F.col("amount").alias("q2"))
    q = F.least("q0", "q2")
    profit = (F.col("p2") - F.col("p0")) * q - fee * (F.col("p0") + F.col("p2")) * q
    legs = reach.join(sales, ["pool", "base", "ledger"]).filter((F.col("a2") > F.col("a0")) & (F.col("p2") > F.col("p0") * (1 + slippage))).withColumn("profit", profit).filter(F.col("profit") >= least_profit)
    span = legs.withColumn("ledger", F.explode(F.sequence(F.col("a0.ledger"), F.col("a2.ledger"))))
    mid = o.filter("NOT base_is_seller").select("pool", "ledger", F.col("base").alias("victim"), F.col("at").alias("a1"), F.col("price").alias("p1"))
    hit = span.join(mid, ["pool", "ledger"]).filter((F.col("a1") > F.col("a0")) & (F.col("a1") < F.col("a2")) & (F.col("victim") != F.col("base")))
    best = F.max(F.struct("p1", (-F.col("a1.ledger")).alias("l"), (-F.col("a1.operation")).alias("o"), "victim"))
    one = hit.groupBy("pool", "base", "buy", "a0", "p0", "prior", "sale", "a2", "profit").agg(best.alias("v"))
    first = one.groupBy("pool", "base", "buy", "a0", "p0", "prior").agg(F.min(F.struct("a2", "sale", "profit", "v")).alias("s"))
    pre = F.when(F.col("prior") > 0, F.col("prior")).otherwise(F.col("p0"))
    return first.select(
        "pool", F.col("base").alias("attacker"), F.col("s.v.victim").alias("victim"), "buy", "s.sale", F.col("a0.ledger").alias("ledger"), F.col("a0.operation").alias("buy_operation"),
        (-F.col("s.v.o")).alias("victim_operation"), F.col("s.a2.operation").alias("sell_operation"), F.round("s.profit", 7).alias("profit"), F.round((F.col("s.v.p1") - pre) / pre, 7).alias("slippage"),
    )


def amm_sandwich(spark: SparkSession, d: str) -> DataFrame:
    return sandwich_candidates(_planted(spark, d))


def pool_sandwiches(spark: SparkSession, d: str) -> DataFrame:
    """Sandwiches per pool, and their frequency min(3 n / trades, 1)."""
    n = amm_sandwich(spark, d).groupBy("pool").agg(F.count(F.lit(1)).alias("sandwiches"))
    t = _planted(spark, d).filter("pool IS NOT NULL").groupBy("pool").agg(F.count(F.lit(1)).alias("trades"))
    k = F.coalesce("sandwiches", F.lit(0))
    return t.join(n, "pool", "left").select("pool", "trades", k.alias("sandwiches"), F.round(F.least(F.lit(1.0), k * 3 / F.col("trades")), 9).alias("frequency"))


def sandwich_features(spark: SparkSession, d: str) -> DataFrame:
    """Per attacker: share of its pool trades that are legs (two per sandwich, at most 1), and profit."""
    n = amm_sandwich(spark, d).groupBy(F.col("attacker").alias("wallet")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("profit"), 6).alias("profit"))
    t = _planted(spark, d).filter("pool IS NOT NULL").groupBy(F.col("base").alias("wallet")).agg(F.count(F.lit(1)).alias("trades"))
    return n.join(t, "wallet").select("wallet", F.round(F.least(F.lit(1.0), 2 * F.col("n") / F.col("trades")), 9).alias("sandwich_ratio"), F.col("profit").alias("sandwich_profit"))


def sandwich_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Sandwiches as alert rows with their detail as JSON."""
    c = amm_sandwich(spark, d)
    return c.select(F.lit("SANDWICH_ATTACK").alias("alert_type"), F.col("attacker").alias("wallet"), F.to_json(F.struct("victim", "pool", "buy", "sale")).alias("detail"))


def orderbook_sandwich(spark: SparkSession, d: str) -> DataFrame:
    """Trades of 500 or more with one account trading within five trades of the pair before and after them, and how sure that is.

    Every pair of such trades counts whose prices differ by at least 0.3 %.
    Confidence is the mean of min(1, amount / 2500), min(1, impact / 0.009) and
    0.5 (timing without a baseline); 0.7 or more is kept. A pair with a large
    part of all trades is cut into weeks.
    """
    t = _planted(spark, d).filter("pool IS NULL AND price > 0").select("pair", "ts", "trade_id", "base", "price", "amount")
    t = with_neighbours(t, ["pair"], ["ts", "trade_id"], F.date_trunc("week", "ts"), 5, 5)
    by = Window.partitionBy("pair", "__chunk").orderBy("ts", "trade_id")
    leg = F.struct("base", "trade_id", "price", "ts")
    near = t.select("*", F.collect_list(leg).over(by.rowsBetween(-5, -1)).alias("before"), F.collect_list(leg).over(by.rowsBetween(1, 5)).alias("after")).filter("__own AND amount >= 500")
    x = near.select("pair", F.col("trade_id").alias("victim_trade"), "base", "amount", F.explode("before").alias("f"), "after").select("*", F.explode("after").alias("b"))
    x = x.filter((F.col("f.base") == F.col("b.base")) & (F.col("f.base") != F.col("base")))
    impact = (F.col("b.price") - F.col("f.price")) / F.col("f.price")
    sure = (F.least(F.lit(1.0), F.col("amount") / 2500) + F.least(F.lit(1.0), F.abs(impact) / 0.009) + 0.5) / 3
    return x.filter((F.abs(impact) >= 0.003) & (sure >= 0.7)).select(
        "pair", F.col("f.base").alias("attacker"), "victim_trade", F.col("f.trade_id").alias("front"), F.col("b.trade_id").alias("back"), F.round(impact, 8).alias("impact"), F.round(sure, 8).alias("confidence")
    )


# sessions ------------------------------------------------------------------------------------


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    """Deposits (transfers out) with the withdrawals (transfers in) that close them, first in first out, per account and EVM wallet.

    Withdrawals that find nothing open are those at which the running balance
    reaches a new low, and don't count. The k-th deposit then belongs to the k-th
    withdrawal that counts.
    """
    t = transfers(spark, d).filter("wallet IS NOT NULL AND evm IS NOT NULL").select("wallet", "evm", "ts", "id", F.when(F.col("direction") == "stellar_to_evm", 1).otherwise(-1).alias("s"), F.coalesce("usd", F.lit(0.0)).alias("usd"))
    by = Window.partitionBy("wallet", "evm").orderBy("ts", "id")
    bal = t.withColumn("b", F.sum("s").over(by)).withColumn("low", F.least(F.min("b").over(by), F.lit(0)))
    bal = bal.withColumn("was", F.coalesce(F.lag("low").over(by), F.lit(0)))
    counted = bal.filter((F.col("s") == 1) | (F.col("low") == F.col("was")))
    numbered = counted.withColumn("k", F.row_number().over(Window.partitionBy("wallet", "evm", "s").orderBy("ts", "id")))
    out = numbered.filter("s = 1").select("wallet", "evm", "k", F.col("id").alias("session"), F.col("ts").alias("t0"), F.col("usd").alias("u0"))
    back = numbered.filter("s = -1").select("wallet", "evm", "k", F.col("ts").alias("t1"), F.col("usd").alias("u1"))
    return out.join(back, ["wallet", "evm", "k"], "left").drop("k")


def _during(spark: SparkSession, d: str, sessions: DataFrame) -> DataFrame:
    """(session, cp, n, v): the account's trades within a session, per counterparty; open sessions reach to the end.

    Sessions are laid out over their days (at most the calendar's) and meet the
    account's trades of the day, so an account with very many trades is spread.
    """
    t = trades(spark, d).select(F.col("base").alias("wallet"), "ts", F.to_date("ts").alias("day"), F.col("counter").alias("cp"), "amount")
    last = t.agg(F.max("ts").alias("last"))
    s = sessions.join(F.broadcast(last)).withColumn("end", F.coalesce("t1", F.greatest("last", "t0")))
    days = s.select("session", "wallet", "t0", "end", F.explode(F.sequence(F.to_date("t0"), F.to_date("end"))).alias("day"))
    hit = days.join(t, ["wallet", "day"]).filter("ts >= t0 AND ts <= end")
    return hit.groupBy("session", "cp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast("decimal(38,8)")).alias("v"))


def lp_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Closed sessions scored: 0.3 short tenure (4 h), 0.3 volume over liquidity (20), 0.2 symmetry above half, 0.2 one counterparty above 0.3."""
    s = durable(_sessions(spark, d), "sessions")
    per = _during(spark, d, s).groupBy("session").agg(
        F.sum("n").alias("n"), F.sum("v").cast("double").alias("v"), F.max(F.when(F.col("cp").isNotNull(), F.col("n"))).alias("top"), F.sum(F.when(F.col("cp").isNotNull(), F.col("n"))).alias("named"),
    )
    x = s.filter("t1 IS NOT NULL").join(per, "session", "left")
    tenure = F.timestamp_diff("MICROSECOND", F.col("t0"), F.col("t1")) / F.lit(1e6)
    liquid = F.greatest("u0", F.lit(1e-9))
    volume = F.coalesce("v", F.lit(0.0)) / liquid
    symmetry = 1 - F.least(F.abs(F.col("u0") - F.col("u1")) / liquid, F.lit(1.0))
    one = ratio(F.col("top"), F.col("named"))
    x = x.select("session", "wallet", "evm", F.coalesce("n", F.lit(0)).alias("trades"), tenure.alias("tenure_s"), volume.alias("volume"), symmetry.alias("symmetry"), one.alias("one"))
    score = F.least(
        F.lit(1.0), 0.3 * F.greatest(F.lit(0.0), 1 - F.col("tenure_s") / 14_400) + 0.3 * F.least(F.lit(1.0), F.col("volume") / 20)
        + 0.2 * F.greatest(F.lit(0.0), (F.col("symmetry") - 0.5) / 0.5) + 0.2 * F.greatest(F.lit(0.0), (F.col("one") - 0.3) / 0.7),
    )
    return x.select("session", "wallet", "evm", "trades", F.round("tenure_s", 3).alias("tenure_s"), F.round("volume", 5).alias("volume_ratio"), F.round("symmetry", 7).alias("symmetry"), F.round("one", 9).alias("concentration"), F.round(score, 6).alias("score"), (F.round(score, 6) > 0.3).alias("anomalous"))


def session_containment(spark: SparkSession, d: str) -> DataFrame:
    """Trades within each session, open sessions included: how many, and their volume; a trade may fall into several."""
    s = durable(_sessions(spark, d), "sessions")
    per = _during(spark, d, s).groupBy("session").agg(F.sum("n").alias("trades"), F.sum("v").cast("double").alias("volume"))
    return per.join(s.select("session", "wallet", "evm", F.col("t1").isNotNull().alias("closed")), "session")


def amm_features(spark: SparkSession, d: str) -> DataFrame:
    """Per account over its pools: mean round-trip ratio, mean concentration; over its anomalous sessions: mean tenure share, highest volume share."""
    pools = pool_round_trip(spark, d).join(hhi_concentration(spark, d).select("pool", "hhi"), "pool").groupBy(F.col("base").alias("wallet")).agg(F.round(F.avg("ratio"), 7).alias("round_trips"), F.round(F.avg("hhi"), 7).alias("hhi"))
    s = lp_sessions(spark, d).filter("anomalous").groupBy("wallet").agg(
        F.round(F.avg(F.least(F.lit(1.0), F.col("tenure_s") / 14_400)), 7).alias("tenure"), F.round(F.least(F.lit(1.0), F.max("volume_ratio") / 20), 6).alias("volume")
    )
    return pools.join(s, "wallet", "full").fillna(0.0)


# cycles --------------------------------------------------------------------------------------


def hop_cycles(spark: SparkSession, d: str, longest: int = 8, least_recovery: float = 0.95, least_score: float = 0.6) -> DataFrame:
    """Round trips over (wallet, asset) nodes within an hour: from each of their nodes the way back to it, at least three hops.

    The graph of an hour of the clock has the newest hop per pair of nodes. Nodes
    without a hop in or out are trimmed, ways are lengthened hop by hop by joins
    on (hour, node) and end where they return to their start; no node is visited
    twice. Recovery is the last amount over the first. Score: 0.4 recovery + 0.3 /
    (1 + seconds / 600) + 0.2 (1 - 1 / hops) + 0.1 overlap of sending wallets.
    """
    t = _planted(spark, d).filter("counter IS NOT NULL AND amount > 0")
    node = lambda w, a: F.concat_ws("|", w, a)
    e = t.select(F.date_trunc("hour", "ts").alias("hour"), node("base", "base_code").alias("src"), node("counter", "counter_code").alias("dst"), "ts", "trade_id", "amount").filter("src <> dst")
    e = e.groupBy("hour", "src", "dst").agg(F.max_by(F.struct("ts", "amount"), F.struct("ts", "trade_id")).alias("x")).select("hour", "src", "dst", "x.*")
    e = durable(e, "hops")
    for _ in range(3):
        e = e.join(e.select("hour", F.col("dst").alias("src")).distinct(), ["hour", "src"], "left_semi").join(e.select("hour", F.col("src").alias("dst")).distinct(), ["hour", "dst"], "left_semi")
        e = durable(e, "hops")
    wallet = lambda n: F.substring_index(n, "|", 1)
    ways = e.select("hour", F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src").alias("nodes"), F.col("amount").alias("first"), F.col("ts").alias("lo"), F.col("ts").alias("hi"))
    step = e.select("hour", F.col("src").alias("at"), F.col("dst").alias("next"), "ts", "amount")
    found = None
    for hops in range(2, longest + 1):
        grown = ways.join(step, ["hour", "at"]).withColumn("nodes", F.concat("nodes", F.array("at"))).withColumns({"lo": F.least("lo", "ts"), "hi": F.greatest("hi", "ts")})
        grown = durable(grown.filter((F.col("next") == F.col("start")) | ~F.array_contains("nodes", F.col("next"))), "ways")
        if hops >= 3:
            back = grown.filter("next = start").select("start", F.size("nodes").alias("hops"), "nodes", (F.col("amount") / F.col("first")).alias("recovery"), (F.timestamp_diff("MICROSECOND", F.col("lo"), F.col("hi")) / F.lit(1e6)).alias("seconds"))
            found = back if found is None else found.unionByName(back)
        ways = grown.filter("next <> start").select("hour", "start", F.col("next").alias("at"), "nodes", "first", "lo", "hi")
        if not ways.limit(1).count():
            break
    if found is None:
        return spark.createDataFrame([], "start string, hops int, path string, recovery double, seconds double, score double")
    senders = F.transform("nodes", wallet)
    most = F.array_max(F.transform(senders, lambda w: F.size(F.filter(senders, lambda v: v == w))))
    overlap = (most - 1) / (F.col("hops") - 1)
    score = 0.4 * F.col("recovery") + 0.3 / (1 + F.col("seconds") / 600) + 0.2 * (1 - 1 / F.col("hops")) + 0.1 * overlap
    return found.withColumn("score", F.round(score, 8)).filter((F.col("recovery") >= least_recovery) & (F.col("score") >= least_score)).select(
        "start", "hops", F.array_join("nodes", ">").alias("path"), F.round("recovery", 8).alias("recovery"), "seconds", "score"
    )


def hop_cycle_features(spark: SparkSession, d: str) -> DataFrame:
    """Per wallet on a hop cycle: cycles it starts, best recovery, longest, distinct assets on them."""
    c = hop_cycles(spark, d).withColumn("wallet", F.substring_index("start", "|", 1))
    a = c.select("wallet", F.explode(F.split("path", ">")).alias("n")).groupBy("wallet").agg(F.countDistinct(F.substring_index("n", "|", -1)).alias("assets"))
    return c.groupBy("wallet").agg(F.count(F.lit(1)).alias("cycles"), F.max("recovery").alias("recovery"), F.max("hops").alias("longest")).join(a, "wallet")


def hop_cycle_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Hop cycles as alert rows: the starting wallet, its asset and the last one as pair, detail as JSON."""
    c = hop_cycles(spark, d).withColumn("n", F.split("path", ">"))
    asset = lambda x: F.substring_index(x, "|", -1)
    return c.select(
        F.lit("PATH_PAYMENT_CYCLE").alias("alert_type"), F.substring_index("start", "|", 1).alias("wallet"), F.concat_ws("/", asset(F.col("n")[0]), asset(F.element_at("n", -1))).alias("asset_pair"), F.to_json(F.struct("hops", "path")).alias("detail"),
    )


def path_edges(spark: SparkSession, d: str) -> DataFrame:
    """Multi-hop operations as edges from their first account to the last one: volume, operations, hops, first and last operation."""
    order = F.struct("token", "trade_id")
    o = trades(spark, d).filter("op IS NOT NULL").groupBy("op").agg(
        F.count(F.lit(1)).alias("hops"), F.min_by("base", order).alias("src"), F.max_by("counter", order).alias("dst"), F.min_by("amount", order).alias("amount"),
    ).filter("hops > 1 AND src IS NOT NULL AND dst IS NOT NULL")
    return o.groupBy("src", "dst").agg(exact_sum("amount").alias("volume"), F.count(F.lit(1)).alias("operations"), F.sum("hops").alias("hops"), F.min("op").alias("first_op"), F.max("op").alias("last_op"))


def path_features(spark: SparkSession, d: str) -> DataFrame:
    """Per account over its multi-hop operations: share that ends with itself, mean hops, volume share that returns to its asset, share of its trades."""
    order = F.struct("token", "trade_id")
    t = trades(spark, d).filter("op IS NOT NULL")
    o = t.groupBy("op").agg(
        F.count(F.lit(1)).alias("hops"), F.min_by("base", order).alias("wallet"), F.max_by("counter", order).alias("dst"), F.min_by(F.struct("base_code", "amount"), order).alias("f"), F.max_by(F.struct("counter_code", "counter_amount"), order).alias("l"),
    )
    many, own = F.col("hops") > 1, F.coalesce(F.col("dst") == F.col("wallet"), F.lit(False))
    cycle = F.when(many & ~own & (F.col("f.base_code") == F.col("l.counter_code")), F.least("f.amount", "l.counter_amount")).otherwise(0.0)
    p = o.groupBy("wallet").agg(
        F.count_if(many).alias("k"), F.count_if(many & own).alias("own"), F.avg(F.when(many, F.col("hops").cast("double"))).alias("hops"), F.sum(cycle).alias("cycle"),
        F.sum(F.when(many, F.col("f.amount"))).alias("volume"), F.sum(F.when(many, F.col("hops")).otherwise(0)).alias("legs"), F.sum("hops").alias("all"),
    )
    return p.filter("k > 0").select("wallet", F.round(F.col("own") / F.col("k"), 9).alias("self_share"), F.round("hops", 9).alias("mean_hops"), F.round(ratio(F.col("cycle"), F.col("volume")), 7).alias("cycle_share"), F.round(F.col("legs") / F.col("all"), 9).alias("path_share"))


# pairs that move together -----------------------------------------------------------------------


def cross_pair_features(spark: SparkSession, d: str, least: float = 0.75) -> DataFrame:
    """Per wallet active within ten minutes in two correlated pairs (rank correlation of 0.75 or more, or ``least``): pairs, highest correlation, burst overlap, other wallets in its cluster, volume share.

    Overlap: share of its trades in these pairs that have anybody's trade in
    another of them within ten minutes. Cluster: other such wallets with a common
    pair, counted over different sets of pairs, of which there are few.

    Only pairs that a wallet trades within ten minutes are correlated, and of the
    pairs of a wallet's set only the highest correlation is kept.
    """
    size, t = SLOT, micros("ts")
    e, per = daily_ranks(spark, d)
    # pairs with fewer days have no correlation
    known = durable(per, "ranked-pairs")
    live = trades(spark, d).join(known.select("pair_key"), "pair_key", "left_semi")
    rows = live.select(F.explode(F.array_distinct(F.filter(F.array("base", "counter"), lambda x: x.isNotNull()))).alias("wallet"), "pair_key", t.alias("t"))
    slot = F.floor(F.col("t") / F.lit(size)).cast("long")
    # a day of slots, and the last one of the day before
    parts = F.array_distinct(F.array(F.floor(F.col("slot") / F.lit(PART)), F.floor((F.col("slot") + 1) / F.lit(PART))))
    cut = rows.withColumn("slot", slot).withColumn("part", F.explode(parts)).repartition("wallet", "part")
    slots = cut.groupBy("wallet", "part", "pair_key", "slot").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    by = Window.partitionBy("wallet", "part").orderBy("slot").rangeBetween(-1, 0)
    pairs = slots.withColumn("near", F.collect_list(F.struct("pair_key", "hi")).over(by)).select("wallet", "pair_key", "lo", F.explode("near").alias("o"))
    pairs = pairs.filter((F.col("o.pair_key") != F.col("pair_key")) & (F.col("lo") - F.col("o.hi") <= size))
    met = durable(pairs.select("wallet", F.least("pair_key", "o.pair_key").alias("pair_key"), F.greatest("pair_key", "o.pair_key").alias("other")).distinct(), "met-pairs")
    corr = rank_correlations(met.select("pair_key", "other").distinct(), e, known).filter(F.col("r") >= least)
    wp = durable(met.join(corr, ["pair_key", "other"]).select("wallet", F.explode(F.array("pair_key", "other")).alias("pair_key")).distinct(), "wallet-pairs")
    best = best_rank_correlation(wp, e, known).select("wallet", F.round("r", 6).alias("synchrony"))
    volume = lambda r, keys: r.groupBy(*keys).agg(F.sum(F.col("amount").cast("decimal(38,8)")).alias("v"))
    mine = durable(wallet_rows(spark, d).select("wallet", "pair_key", "ts", "amount").join(wp, ["wallet", "pair_key"]), "rows-in-pairs")
    own = volume(mine, ["wallet", "pair_key"])
    whole = volume(trades(spark, d), ["pair_key"]).withColumnRenamed("v", "all")
    share = own.join(whole, "pair_key").groupBy("wallet").agg(F.round(F.sum("v").cast("double") / F.sum("all").cast("double"), 9).alias("volume_share"))
    sets = wp.groupBy("wallet").agg(F.array_sort(F.collect_set("pair_key")).alias("pairs"))
    groups = durable(sets.groupBy("pairs").agg(F.count(F.lit(1)).alias("k"), F.collect_list("wallet").alias("wallets")).withColumn("id", F.monotonically_increasing_id()), "pair-sets")
    link = groups.select("id", F.explode("pairs").alias("pair_key")).join(groups.select(F.col("id").alias("near"), "k", F.explode("pairs").alias("pair_key")), "pair_key").select("id", "near", "k").distinct()
    cluster = groups.join(link.groupBy("id").agg((F.sum("k") - 1).alias("cluster")), "id").select(F.explode("wallets").alias("wallet"), F.size("pairs").alias("pairs"), "cluster")
    burst = near_other_pairs(mine, wp, live.select("pair_key", "ts"))
    overlap = burst.select("wallet", F.round(F.col("b") / F.col("n"), 9).alias("burst_overlap"))
    return cluster.join(best, "wallet").join(overlap, "wallet").join(share, "wallet")


def cross_pair_features_wide(spark: SparkSession, d: str) -> DataFrame:
    """The same for pairs with a rank correlation above zero, which small tables have too."""
    return cross_pair_features(spark, d, 1e-9)


def node_features(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of four-hour graph slices with three features given as functions: trades, counterparties, volume."""
    made = {"trades": lambda: F.count(F.lit(1)), "counterparties": lambda: F.countDistinct("counterparty"), "volume": lambda: F.sum(F.col("amount").cast("decimal(38,8)")).cast("double")}
    t = node_table(trades(spark, d), made)
    return t.select(F.date_format("slice", "yyyy-MM-dd HH").alias("slice"), "node", *made)


# rings and reachability -------------------------------------------------------------------------


def distinct_rings(rings: DataFrame) -> DataFrame:
    """(ring, account) of rings whose accounts aren't all in another ring; of equal sets the least name stays.

    A ring can only lie in one that has its rarest account: rings meet by that
    account alone, and candidates are checked by counting common accounts.
    """
    sizes = rings.groupBy("ring").agg(F.count(F.lit(1)).alias("size"))
    often = rings.groupBy("account").agg(F.count(F.lit(1)).alias("k"))
    rare = rings.join(often, "account").groupBy("ring").agg(F.min_by("account", F.struct("k", "account")).alias("account"))
    pairs = rare.join(rings.withColumnRenamed("ring", "other"), "account").filter("ring <> other").select("ring", "other")
    common = pairs.join(rings, "ring").join(rings.withColumnRenamed("ring", "other"), ["other", "account"]).groupBy("ring", "other").agg(F.count(F.lit(1)).alias("c"))
    inside = common.join(sizes, "ring").join(sizes.select(F.col("ring").alias("other"), F.col("size").alias("size_o")), "other")
    gone = inside.filter((F.col("c") == F.col("size")) & ((F.col("size") < F.col("size_o")) | (F.col("other") < F.col("ring")))).select("ring").distinct()
    return rings.join(gone, "ring", "left_anti")


def ring_list(spark: SparkSession, d: str) -> DataFrame:
    """Rings of all pairs without those inside others: accounts, and their place by size and name."""
    t = trades(spark, d).filter("counter IS NOT NULL").select(F.concat_ws("|", "pair_key", "base").alias("base"), F.concat_ws("|", "pair_key", "counter").alias("counter"), "amount")
    c = strong_components(trade_edges(t))
    sizes = c.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size >= 3").select("component")
    members = durable(c.join(sizes, "component").select(F.col("component").alias("ring"), F.substring_index("v", "|", -1).alias("account")), "rings")
    left = distinct_rings(members).groupBy("ring").agg(F.count(F.lit(1)).alias("accounts"))
    # rings are few
    return left.withColumn("place", F.row_number().over(Window.orderBy(F.col("accounts").desc(), "ring")))


def ring_order(spark: SparkSession, d: str) -> DataFrame:
    """Wash rings of the repeated-trade graph, most volume first, then best cycle."""
    e = trade_edges(trades(spark, d)).filter("cnt >= 2 AND src <> dst")
    r = wash_rings(e, strong_components(e))
    return r.withColumn("place", F.row_number().over(Window.orderBy(F.col("volume").desc(), F.col("cycle_volume").desc(), "component"))).select("place", "component", "size", F.round("volume", 4).alias("volume"), "truncated")


def ring_flags(spark: SparkSession, d: str) -> DataFrame:
    """1 for accounts on a component of at least two, else 0: the ring probability where no model is there."""
    c = strong_components(trade_edges(trades(spark, d)))
    n = c.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return c.join(n, "component").select(F.col("v").alias("account"), F.when(F.col("n") >= 2, 1.0).otherwise(0.0).alias("ring_probability"))


def lineage_closure(spark: SparkSession, d: str) -> DataFrame:
    """Accounts that funding connects in any direction: per group its least name, members, and funders among them."""
    f = table(spark, d, "account_metadata").filter("funding_source IS NOT NULL").select(F.col("account").alias("src"), F.col("funding_source").alias("dst"))
    c = weak_components(f)
    funders = f.select(F.col("dst").alias("v")).distinct().withColumn("funds", F.lit(1))
    return c.join(funders, "v", "left").groupBy(F.col("component").alias("root")).agg(F.count(F.lit(1)).alias("accounts"), F.sum(F.coalesce("funds", F.lit(0))).alias("funders"))


QUERIES = {
    f.__name__: f
    for f in (
        ordering_columns, amm_sandwich, pool_sandwiches, sandwich_features, sandwich_alerts, orderbook_sandwich, lp_sessions, session_containment,
        amm_features, hop_cycles, hop_cycle_features, hop_cycle_alerts, path_edges, path_features, cross_pair_features, cross_pair_features_wide, node_features, ring_list, ring_order, ring_flags, lineage_closure,
    )
}


def _sql(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else repr(v)


_PT = f"""{TRADES_SQL}, pt AS (SELECT trade_id, ts, base, counter, base_code, counter_code, pair, amount, price, base_is_seller, pool FROM trades UNION ALL
SELECT i, TIMESTAMP '2027-01-01' + to_seconds(s), b, c, bc, cc, bc || '/' || cc, a::DOUBLE, p::DOUBLE, x, l FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in PLANTED)}) v(i, s, b, c, bc, cc, a, p, x, l))"""
_ORD = f"""{_PT}, o AS (SELECT *, dense_rank() OVER (ORDER BY ts) AS ledger, row_number() OVER (PARTITION BY ts ORDER BY trade_id) - 1 AS operation, lag(price) OVER (PARTITION BY pool ORDER BY ts, trade_id) AS prior FROM pt WHERE pool IS NOT NULL)"""
_SW = f"""{_ORD}, l AS (SELECT a.pool, a.base, a.trade_id AS buy, b.trade_id AS sale, a.ledger AS l0, a.operation AS o0, b.ledger AS l2, b.operation AS o2, a.price AS p0, a.prior, (b.price - a.price) * least(a.amount, b.amount) AS profit
  FROM o a JOIN o b ON a.pool = b.pool AND a.base = b.base AND NOT a.base_is_seller AND b.base_is_seller AND (b.ledger, b.operation) > (a.ledger, a.operation) AND b.ledger - a.ledger <= 2 AND b.price > a.price AND a.price > 0),
h AS (SELECT l.*, v.base AS victim, v.operation AS o1, v.price AS p1, row_number() OVER (PARTITION BY buy, sale ORDER BY v.price DESC, v.ledger, v.operation) AS rv FROM l JOIN o v ON v.pool = l.pool AND NOT v.base_is_seller AND v.base <> l.base
  AND (v.ledger, v.operation) > (l0, o0) AND (v.ledger, v.operation) < (l2, o2) WHERE profit >= 10),
f AS (SELECT *, row_number() OVER (PARTITION BY buy ORDER BY l2, o2) AS rs FROM h WHERE rv = 1),
sw AS (SELECT pool, base AS attacker, victim, buy, sale, l0 AS ledger, o0 AS buy_operation, o1 AS victim_operation, o2 AS sell_operation, round(profit, 7) AS profit,
  round((p1 - CASE WHEN prior > 0 THEN prior ELSE p0 END) / CASE WHEN prior > 0 THEN prior ELSE p0 END, 7) AS slippage FROM f WHERE rs = 1)"""
_SES = f"""{TRADES_SQL}, {TRANSFERS_SQL}, tx AS (SELECT wallet, evm, ts, id, CASE WHEN direction = 'stellar_to_evm' THEN 1 ELSE -1 END AS s, coalesce(usd, 0) AS usd FROM transfers WHERE wallet IS NOT NULL AND evm IS NOT NULL),
b0 AS (SELECT *, sum(s) OVER w AS b FROM tx WINDOW w AS (PARTITION BY wallet, evm ORDER BY ts, id)), b1 AS (SELECT *, least(min(b) OVER (PARTITION BY wallet, evm ORDER BY ts, id), 0) AS low FROM b0),
b2 AS (SELECT *, coalesce(lag(low) OVER (PARTITION BY wallet, evm ORDER BY ts, id), 0) AS was FROM b1), nb AS (SELECT *, row_number() OVER (PARTITION BY wallet, evm, s ORDER BY ts, id) AS k FROM b2 WHERE s = 1 OR low = was),
ses AS (SELECT a.wallet, a.evm, a.id AS session, a.ts AS t0, a.usd AS u0, c.ts AS t1, c.usd AS u1 FROM nb a LEFT JOIN nb c ON c.wallet = a.wallet AND c.evm = a.evm AND c.k = a.k AND c.s = -1 WHERE a.s = 1),
du AS (SELECT session, counter AS cp, count(*) AS n, sum(CAST(amount AS DECIMAL(38,8))) AS v FROM ses JOIN trades t ON t.base = ses.wallet AND t.ts >= t0 AND (t1 IS NULL OR t.ts <= t1) GROUP BY ALL)"""
_LP = f"""{_SES}, pr AS (SELECT session, sum(n) AS n, CAST(sum(v) AS DOUBLE) AS v, max(n) FILTER (cp IS NOT NULL) AS top, sum(n) FILTER (cp IS NOT NULL) AS named FROM du GROUP BY 1),
x AS (SELECT ses.session, wallet, evm, coalesce(n, 0) AS trades, (epoch_us(t1) - epoch_us(t0)) / 1e6 AS tenure, coalesce(v, 0) / greatest(u0, 1e-9) AS vol, 1 - least(abs(u0 - u1) / greatest(u0, 1e-9), 1) AS sym, coalesce(top / named, 0) AS one
  FROM ses LEFT JOIN pr ON pr.session = ses.session WHERE t1 IS NOT NULL),
y AS (SELECT *, least(1.0, 0.3::DOUBLE * greatest(0, 1 - tenure / 14400) + 0.3::DOUBLE * least(1, vol / 20) + 0.2::DOUBLE * greatest(0, (sym - 0.5) / 0.5) + 0.2::DOUBLE * greatest(0, (one - 0.3) / 0.7)) AS score FROM x),
lp AS (SELECT session, wallet, evm, CAST(trades AS BIGINT) AS trades, round(tenure, 3) AS tenure_s, round(vol, 5) AS volume_ratio, round(sym, 7) AS symmetry, round(one, 9) AS concentration, round(score, 6) AS score, round(score, 6) > 0.3 AS anomalous FROM y)"""
_HOP = f"""WITH RECURSIVE {_PT}, he AS (SELECT date_trunc('hour', ts) AS hour, base || '|' || base_code AS src, counter || '|' || counter_code AS dst, ts, trade_id, amount FROM pt WHERE counter IS NOT NULL AND amount > 0),
e AS (SELECT hour, src, dst, ts, amount FROM (SELECT *, row_number() OVER (PARTITION BY hour, src, dst ORDER BY ts DESC, trade_id DESC) AS rn FROM he WHERE src <> dst) WHERE rn = 1),
wy AS (SELECT hour, src AS start, dst AS cur, [src] AS nodes, amount AS first, amount AS last, ts AS lo, ts AS hi FROM e
  UNION ALL SELECT w.hour, start, e.dst, list_append(nodes, cur), first, e.amount, least(lo, e.ts), greatest(hi, e.ts) FROM wy w JOIN e ON e.hour = w.hour AND e.src = w.cur
  WHERE w.cur <> start AND len(nodes) < 8 AND (e.dst = start OR NOT list_contains(list_append(nodes, w.cur), e.dst))),
cy AS (SELECT start, len(nodes) AS hops, nodes, last / first AS recovery, (epoch_us(hi) - epoch_us(lo)) / 1e6 AS seconds, list_transform(nodes, lambda n: split_part(n, '|', 1)) AS ws FROM wy WHERE cur = start AND len(nodes) >= 3),
sc AS (SELECT *, round(0.4::DOUBLE * recovery + 0.3::DOUBLE / (1 + seconds / 600) + 0.2::DOUBLE * (1 - 1.0 / hops) + 0.1::DOUBLE * (list_max(list_transform(ws, lambda w: len(list_filter(ws, lambda z: z = w)))) - 1) / (hops - 1), 8) AS score FROM cy),
hc AS (SELECT start, CAST(hops AS INT) AS hops, array_to_string(nodes, '>') AS path, round(recovery, 8) AS recovery, seconds, score FROM sc WHERE recovery >= 0.95 AND score >= 0.6)"""
_OPS = f"""{TRADES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY op ORDER BY token NULLS FIRST, trade_id) AS a, row_number() OVER (PARTITION BY op ORDER BY token DESC NULLS LAST, trade_id DESC) AS z FROM trades WHERE op IS NOT NULL),
o AS (SELECT op, count(*) AS hops, max(base) FILTER (a = 1) AS src, max(counter) FILTER (z = 1) AS dst, max(amount) FILTER (a = 1) AS amount, max(base_code) FILTER (a = 1) AS f, max(counter_code) FILTER (z = 1) AS l, max(counter_amount) FILTER (z = 1) AS la FROM r GROUP BY op)"""

ORACLE = {
    "ordering_columns": f"WITH {_ORD} SELECT trade_id, ledger, CAST(operation AS INT) AS operation FROM o",
    "amm_sandwich": f"WITH {_SW} SELECT pool, attacker, victim, buy, sale, ledger, CAST(buy_operation AS INT) AS buy_operation, CAST(victim_operation AS INT) AS victim_operation, CAST(sell_operation AS INT) AS sell_operation, profit, slippage FROM sw",
    "pool_sandwiches": f"""WITH {_SW}, t AS (SELECT pool, count(*) AS trades FROM pt WHERE pool IS NOT NULL GROUP BY 1), n AS (SELECT pool, count(*) AS k FROM sw GROUP BY 1)
SELECT t.pool, trades, coalesce(k, 0) AS sandwiches, round(least(1.0, coalesce(k, 0) * 3 / trades), 9) AS frequency FROM t LEFT JOIN n ON n.pool = t.pool""",
    "sandwich_features": f"""WITH {_SW}, t AS (SELECT base, count(*) AS trades FROM pt WHERE pool IS NOT NULL GROUP BY 1), n AS (SELECT attacker, count(*) AS k, round(sum(profit), 6) AS profit FROM sw GROUP BY 1)
SELECT attacker AS wallet, round(least(1.0, 2 * k / trades), 9) AS sandwich_ratio, profit AS sandwich_profit FROM n JOIN t ON t.base = attacker""",
    "sandwich_alerts": f"""WITH {_SW} SELECT 'SANDWICH_ATTACK' AS alert_type, attacker AS wallet, '{{"victim":"' || victim || '","pool":"' || pool || '","buy":' || buy || ',"sale":' || sale || '}}' AS detail FROM sw""",
    "orderbook_sandwich": f"""WITH {_PT}, n AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts, trade_id) AS k FROM pt WHERE pool IS NULL AND price > 0),
x AS (SELECT v.pair, f.base AS attacker, v.trade_id AS victim_trade, f.trade_id AS front, b.trade_id AS back, (b.price - f.price) / f.price AS i, v.amount FROM n v JOIN n f ON f.pair = v.pair AND f.k BETWEEN v.k - 5 AND v.k - 1 AND f.base <> v.base
  JOIN n b ON b.pair = v.pair AND b.k BETWEEN v.k + 1 AND v.k + 5 AND b.base = f.base WHERE v.amount >= 500),
s AS (SELECT *, (least(1, amount / 2500) + least(1, abs(i) / 0.009) + 0.5) / 3 AS c FROM x WHERE abs(i) >= 0.003) SELECT pair, attacker, victim_trade, front, back, round(i, 8) AS impact, round(c, 8) AS confidence FROM s WHERE c >= 0.7""",
    "lp_sessions": f"WITH {_LP} SELECT * FROM lp",
    "session_containment": f"WITH {_SES} SELECT du.session, CAST(sum(n) AS BIGINT) AS trades, CAST(sum(v) AS DOUBLE) AS volume, wallet, evm, t1 IS NOT NULL AS closed FROM du JOIN ses ON ses.session = du.session GROUP BY du.session, wallet, evm, t1",
    "amm_features": f"""WITH {_LP}, rt AS (SELECT * FROM ({_FEATURE_SQL['pool_round_trip']})), hh AS (SELECT * FROM ({_FEATURE_SQL['hhi_concentration']})),
pl AS (SELECT base AS wallet, round(avg(ratio), 7) AS round_trips, round(avg(hhi), 7) AS hhi FROM rt JOIN hh ON hh.pool = rt.pool GROUP BY 1),
an AS (SELECT wallet, round(avg(least(1, tenure_s / 14400)), 7) AS tenure, round(least(1, max(volume_ratio) / 20), 6) AS volume FROM lp WHERE anomalous GROUP BY 1)
SELECT coalesce(pl.wallet, an.wallet) AS wallet, coalesce(round_trips, 0) AS round_trips, coalesce(hhi, 0) AS hhi, coalesce(tenure, 0) AS tenure, coalesce(volume, 0) AS volume FROM pl FULL JOIN an ON an.wallet = pl.wallet""",
    "hop_cycles": f"{_HOP} SELECT * FROM hc",
    "hop_cycle_features": f"""{_HOP}, w AS (SELECT split_part(start, '|', 1) AS wallet, * FROM hc), a AS (SELECT wallet, count(DISTINCT split_part(n, '|', 2)) AS assets FROM (SELECT wallet, unnest(string_split(path, '>')) AS n FROM w) GROUP BY 1)
SELECT w.wallet, count(*) AS cycles, max(recovery) AS recovery, max(hops) AS longest, max(assets) AS assets FROM w JOIN a ON a.wallet = w.wallet GROUP BY 1""",
    "hop_cycle_alerts": f"""{_HOP} SELECT 'PATH_PAYMENT_CYCLE' AS alert_type, split_part(start, '|', 1) AS wallet, split_part(start, '|', 2) || '/' || split_part(string_split(path, '>')[-1], '|', 2) AS asset_pair,
  '{{"hops":' || hops || ',"path":"' || path || '"}}' AS detail FROM hc""",
    "path_edges": f"""WITH {_OPS} SELECT src, dst, CAST(sum(CAST(amount AS DECIMAL(38,8))) AS DOUBLE) AS volume, count(*) AS operations, CAST(sum(hops) AS BIGINT) AS hops, min(op) AS first_op, max(op) AS last_op FROM o WHERE hops > 1 AND src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2""",
    "path_features": f"""WITH {_OPS}, g AS (SELECT src AS wallet, count(*) FILTER (hops > 1) AS k, count(*) FILTER (hops > 1 AND coalesce(dst = src, FALSE)) AS own, avg(hops) FILTER (hops > 1) AS hops,
  sum(CASE WHEN hops > 1 AND NOT coalesce(dst = src, FALSE) AND f = l THEN least(amount, la) ELSE 0 END) AS cyc, sum(amount) FILTER (hops > 1) AS vol, sum(CASE WHEN hops > 1 THEN hops ELSE 0 END) AS legs, sum(hops) AS all_ FROM o GROUP BY 1)
SELECT wallet, round(own / k, 9) AS self_share, round(hops, 9) AS mean_hops, round(coalesce(cyc / nullif(vol, 0), 0), 7) AS cycle_share, round(legs / all_, 9) AS path_share FROM g WHERE k > 0""",
    "lineage_closure": """WITH RECURSIVE f AS (SELECT account AS a, funding_source AS b FROM account_metadata WHERE funding_source IS NOT NULL), u AS (SELECT a, b FROM f UNION SELECT b, a FROM f),
r AS (SELECT a AS v, a AS w FROM u UNION SELECT r.v, u.b FROM r JOIN u ON u.a = r.w), c AS (SELECT v, min(w) AS root FROM r GROUP BY 1)
SELECT root, count(*) AS accounts, count(*) FILTER (v IN (SELECT b FROM f)) AS funders FROM c GROUP BY 1""",
    "ring_flags": f"""WITH RECURSIVE {TRADES_SQL}, e AS (SELECT DISTINCT base AS src, counter AS dst FROM trades WHERE counter IS NOT NULL), {_scc_sql('e')}
SELECT v AS account, CASE WHEN count(*) OVER (PARTITION BY component) >= 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS ring_probability FROM comp""",
    "ring_list": f"""WITH RECURSIVE {TRADES_SQL}, e AS (SELECT DISTINCT pair_key || '|' || base AS src, pair_key || '|' || counter AS dst FROM trades WHERE counter IS NOT NULL), {_scc_sql('e')},
z AS (SELECT component AS ring, list_sort(list(split_part(v, '|', 2))) AS accounts FROM comp GROUP BY 1 HAVING count(*) >= 3),
k AS (SELECT ring, len(accounts) AS accounts FROM z a WHERE NOT EXISTS (SELECT 1 FROM z b WHERE b.ring <> a.ring AND list_has_all(b.accounts, a.accounts) AND (len(b.accounts) > len(a.accounts) OR b.ring < a.ring)))
SELECT ring, accounts, CAST(row_number() OVER (ORDER BY accounts DESC, ring) AS INT) AS place FROM k""",
    "node_features": f"""WITH {TRADES_SQL}, r AS (SELECT ts, amount, base AS node, counter AS cp FROM trades WHERE counter IS NOT NULL AND base <> counter UNION ALL SELECT ts, amount, counter, base FROM trades WHERE counter IS NOT NULL AND base <> counter)
SELECT strftime(time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H') AS slice, node, count(*) AS trades, count(DISTINCT cp) AS counterparties, CAST(sum(CAST(amount AS DECIMAL(38,8))) AS DOUBLE) AS volume FROM r GROUP BY 1, 2""",
    "cross_pair_features": f"""WITH {WALLET_SQL}, cr AS (SELECT * FROM ({_SERIES_SQL['spearman_pairs']}) WHERE r >= 0.75),
wt AS (SELECT DISTINCT wallet, pair_key, ts FROM wrows), mt AS (SELECT DISTINCT a.wallet, a.pair_key AS pa, z.pair_key AS pb FROM wt a JOIN cr ON cr.pair_key = a.pair_key JOIN wt z ON z.wallet = a.wallet AND z.pair_key = cr.other AND z.ts BETWEEN a.ts - INTERVAL 10 MINUTE AND a.ts + INTERVAL 10 MINUTE),
wp AS (SELECT wallet, pa AS pair_key FROM mt UNION SELECT wallet, pb FROM mt), sy AS (SELECT x.wallet, max(r) AS synchrony FROM cr JOIN wp x ON x.pair_key = cr.pair_key JOIN wp y ON y.pair_key = cr.other AND y.wallet = x.wallet GROUP BY 1),
cl AS (SELECT a.wallet, count(DISTINCT z.wallet) - 1 AS cluster FROM wp a JOIN wp z ON z.pair_key = a.pair_key GROUP BY 1), np AS (SELECT wallet, count(*) AS pairs FROM wp GROUP BY 1),
ov AS (SELECT wallet, sum(CAST(amount AS DECIMAL(38,8))) AS v FROM wrows JOIN wp USING (wallet, pair_key) GROUP BY 1), al AS (SELECT pair_key, sum(CAST(amount AS DECIMAL(38,8))) AS v FROM trades GROUP BY 1), av AS (SELECT wallet, sum(v) AS v FROM wp JOIN al USING (pair_key) GROUP BY 1),
bo AS (SELECT w.wallet, avg((EXISTS (SELECT 1 FROM wp q JOIN trades t ON t.pair_key = q.pair_key WHERE q.wallet = w.wallet AND q.pair_key <> w.pair_key AND t.ts BETWEEN w.ts - INTERVAL 10 MINUTE AND w.ts + INTERVAL 10 MINUTE))::INT) AS o FROM wrows w JOIN wp USING (wallet, pair_key) GROUP BY 1)
SELECT np.wallet, CAST(pairs AS INT) AS pairs, cluster, synchrony, round(o, 9) AS burst_overlap, round(CAST(ov.v AS DOUBLE) / CAST(av.v AS DOUBLE), 9) AS volume_share
FROM np JOIN sy USING (wallet) JOIN cl USING (wallet) JOIN ov USING (wallet) JOIN av USING (wallet) JOIN bo USING (wallet)""",
}
ORACLE["cross_pair_features_wide"] = ORACLE["cross_pair_features"].replace("r >= 0.75", "r >= 1e-9")
