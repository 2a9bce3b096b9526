"""Rows for export and review: hops, legs, sanitised pairs, contributions, correlations, effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike.functions import benford as b
from marlspike.functions.cells import amount
from marlspike.functions.stats import exact_sum
from marlspike.operators.quantiles import exact_quantiles
from marlspike.queries.graphs import ROUTES
from marlspike.queries.monitoring import _F, _PSI_W, _feedback, ks_two_sample, psi_equal_width
from marlspike.queries.monitoring import ORACLE as _SERIES_SQL
from marlspike.queries.views import AS_OF, TRADES_SQL, WALLET_SQL, trades, wallet_rows
from marlspike.session import durable, shared_dir
from marlspike.sources.plugins import Filter, first_rejection
from marlspike.sources.stores import archive, chunk_table, open_chunks, read_tier
from marlspike.sources.tables import table


def divergence_top(spark: SparkSession, d: str) -> DataFrame:
    """The fifty labels on which forest and boosting differ most, largest first, then by id."""
    f = _feedback(spark, d).filter("rf IS NOT NULL AND xg IS NOT NULL").select("id", "wallet", F.round(F.abs(F.col("rf") - F.col("xg")), 9).alias("divergence"))
    return f.orderBy(F.col("divergence").desc(), "id").limit(50)


def contribution_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Per label the models by their distance from their mean, furthest first, as text."""
    f = _feedback(spark, d).filter("rf IS NOT NULL AND xg IS NOT NULL AND lg IS NOT NULL")
    m = f.agg(*[F.avg(c).alias(f"m_{c}") for c in ("rf", "xg", "lg")])
    x = f.join(F.broadcast(m))  # one row of means
    parts = F.array(*[F.struct((-F.round(F.abs(F.col(c) - F.col(f"m_{c}")), 9)).alias("size"), F.lit(c).alias("model")) for c in ("rf", "xg", "lg")])
    return x.select("id", F.array_join(F.transform(F.array_sort(parts), lambda p: p["model"]), ">").alias("models"))


def score_rows(spark: SparkSession, d: str) -> DataFrame:
    """Scores of two months from 50 on as written to CSV and read back, newest first."""
    s = table(spark, d, "risk_scores").filter("wallet IS NOT NULL AND asset_pair IS NOT NULL AND score BETWEEN 50 AND 100 AND timestamp >= TIMESTAMP_NTZ'2026-02-01 00:00:00' AND timestamp < TIMESTAMP_NTZ'2026-04-01 00:00:00'")
    path = shared_dir(spark, "export") + "/scores"
    s.select("id", "wallet", "asset_pair", "score", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at_time")).write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("id long, wallet string, asset_pair string, score int, at_time string").csv(path).orderBy(F.col("at_time").desc(), F.col("id").desc())


def archived_and_purged(spark: SparkSession, d: str) -> DataFrame:
    """Tables after their expired rows went to the cold tier: rows archived (read back) and kept, per table."""
    end = F.lit(AS_OF).cast("timestamp_ntz")
    out = None
    for name, ts, days in (("risk_scores", "timestamp", 60), ("label_feedback", "confirmed_at", 90), ("ingestion_dedup_keys", "first_seen_at", 30)):
        path = shared_dir(spark, "cold") + f"/{name}"
        kept = archive(table(spark, d, name).select("id", ts), ts, end - F.expr(f"INTERVAL {days} DAYS"), path)
        x = kept.agg(F.count(F.lit(1)).alias("kept")).join(read_tier(spark, path, ts).agg(F.count(F.lit(1)).alias("archived")))
        x = x.select(F.lit(name).alias("table_name"), "archived", "kept")
        out = x if out is None else out.unionAll(x)
    return out


def export_rows(spark: SparkSession, d: str) -> DataFrame:
    """Trade messages in export types: decimal(22,7) amounts, UTC time as text, issuers and pool never null, side as text; per day and type."""
    t = table(spark, d, "horizon_trade").filter("ledger_close_time IS NOT NULL").select(
        F.date_format("ledger_close_time", "yyyy-MM-dd'T'HH:mm:ss").alias("closed"), amount(F.col("base_amount")).cast("decimal(22,7)").alias("amount"),
        F.coalesce("base_asset_issuer", F.lit("")).alias("issuer"), F.coalesce("liquidity_pool_id", F.lit("")).alias("pool"), F.when(F.col("base_is_seller"), "sell").otherwise("buy").alias("side"),
    )
    return t.groupBy(F.substring("closed", 1, 10).alias("day"), "side", (F.col("pool") != "").alias("pooled")).agg(F.count(F.lit(1)).alias("rows"), F.max("closed").alias("last"), F.sum("amount").cast("double").alias("amount"), F.countDistinct("issuer").alias("issuers"))


def sane_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Labels of pairs that pass the pattern (upper case, at most 30 characters), with the partition key; others are dropped."""
    t = trades(spark, d).select(F.upper("pair").alias("pair"))
    return t.filter(F.col("pair").rlike(r"^[A-Z0-9/.:\-]{1,30}$")).groupBy("pair", F.regexp_replace("pair", "[^A-Z0-9]", "_").alias("partition_key")).agg(F.count(F.lit(1)).alias("trades"))


def hop_trades(spark: SparkSession, d: str) -> DataFrame:
    """Multi-hop operations as one trade per hop, if every hop sells what the one before bought and all amounts are above 0 and at most 1e15; else nothing. The planted routes are among them."""
    by = Window.partitionBy("op").orderBy("token", "trade_id")
    names = ["op", "token", "base_code", "counter_code", "amount", "counter_amount"]
    planted = spark.createDataFrame(ROUTES, "op string, token string, base_code string, counter_code string, amount double, counter_amount double").withColumn("trade_id", F.lit(-1).cast("long"))
    t = trades(spark, d).filter("op IS NOT NULL").select(*names, "trade_id").unionByName(planted)
    t = t.select("*", (F.row_number().over(by) - 1).alias("hop"), F.lag("counter_code").over(by).alias("bought"))
    fits = F.coalesce(F.col("bought") == F.col("base_code"), F.col("hop") == 0) & F.coalesce(F.col("amount").between(1e-300, 1e15) & F.col("counter_amount").between(1e-300, 1e15), F.lit(False))
    whole = t.groupBy("op").agg(F.count(F.lit(1)).alias("hops"), F.min(fits).alias("ok")).filter("hops > 1 AND ok").select("op")
    return t.join(whole, "op", "left_semi").select(
        F.concat_ws("-hop", "op", F.col("hop").cast("string")).alias("id"), "hop", F.col("base_code").alias("sold"), F.col("counter_code").alias("received"), F.round(F.col("counter_amount") / F.col("amount"), 9).alias("price")
    )


def swap_legs(spark: SparkSession, d: str) -> DataFrame:
    """Operations as swaps by balance difference: of the first account, the asset it lost most of first in order of name, and the one it got; one-sided ones give nothing."""
    dec = lambda c: F.col(c).cast("decimal(38,8)")
    t = trades(spark, d).filter("op IS NOT NULL AND counter_amount IS NOT NULL")
    legs = F.array(F.struct(F.col("base_code").alias("a"), (-dec("amount")).alias("x")), F.struct(F.col("counter_code").alias("a"), dec("counter_amount").alias("x")))
    n = t.select("op", "base", F.explode(legs).alias("l")).groupBy("op", "base", "l.a").agg(F.sum("l.x").alias("net")).filter(F.abs("net") > 1e-7)
    one = n.groupBy("op", "base").agg(F.min(F.when(F.col("net") < 0, F.struct("a", "net"))).alias("gave"), F.min(F.when(F.col("net") > 0, F.struct("a", "net"))).alias("got"))
    return one.filter("gave IS NOT NULL AND got IS NOT NULL").select("op", F.col("base").alias("wallet"), F.col("gave.a").alias("sold"), F.col("got.a").alias("received"), (-F.col("gave.net")).cast("double").alias("amount"), F.col("got.net").cast("double").alias("got_amount"))


def drift_report(spark: SparkSession, d: str) -> DataFrame:
    """Per feature: KS statistic with its asymptotic p-value, PSI, flags at 0.20, and whether the input below 0.10 drifted nonetheless by KS."""
    ks = ks_two_sample(spark, d)
    n = F.col("reference") * F.col("current") / (F.col("reference") + F.col("current"))
    x = ks.join(psi_equal_width(spark, d), "feature").withColumn("lam", b.ks_lambda(F.col("ks"), n))
    p = F.round(b.ks_pvalue(F.col("lam")), 6)
    return x.select("feature", "ks", p.alias("p"), "psi", (F.col("psi") >= 0.20).alias("flagged"), ((F.col("psi") < 0.10) & (p < 0.05)).alias("stable_but_drifted"))


def effect_table(spark: SparkSession, d: str) -> DataFrame:
    """Linear effect of each model's score on the label, the ensemble held fixed, and what moving it from 0.2 to 0.8 does; from one pass of moments."""
    f = _feedback(spark, d).filter("rf IS NOT NULL AND xg IS NOT NULL AND lg IS NOT NULL AND ens IS NOT NULL").withColumn("z", F.col("ens") / 100)
    cov = lambda p, q: F.covar_pop(F.col(p).cast("double"), F.col(q).cast("double"))
    rows = []
    for m in ("rf", "xg", "lg"):
        slope = (cov(m, "y") * cov("z", "z") - cov("z", "y") * cov(m, "z")) / (cov(m, m) * cov("z", "z") - cov(m, "z") * cov(m, "z"))
        rows.append(slope.alias(m))
    one = f.agg(*rows)
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.round(m, 7).alias("slope"), F.round(F.col(m) * 0.6, 7).alias("effect")) for m in ("rf", "xg", "lg")])).alias("x")).select("x.*")


def winsorised_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of pairs with a Pearson correlation of 0.5 or more of daily volumes cut at their 1st and 99th percentile, days without trades as zeros.

    Pairs have at least 10 active days. A zero day adds to no product, so only
    days on which both trade are joined; means and deviations come from sums.
    """
    daily = durable(trades(spark, d).groupBy("pair_key", F.to_date("ts").alias("day")).agg(F.round(F.sum("amount"), 6).alias("v")), "daily-volumes")
    calendar = daily.select("day").distinct()
    active = daily.filter("v > 0").groupBy("pair_key").agg(F.count(F.lit(1)).alias("k")).filter("k >= 10").select("pair_key")
    # pairs times the calendar's days
    grid = active.join(F.broadcast(calendar)).join(daily, ["pair_key", "day"], "left").fillna(0.0, ["v"])
    q = exact_quantiles(grid, "pair_key", "v", {"lo": 0.01, "hi": 0.99})
    w = durable(grid.join(q, "pair_key").select("pair_key", "day", "n", F.greatest(F.least("v", "hi"), "lo").alias("w")), "winsorised")
    per = w.groupBy("pair_key").agg(F.max("n").alias("n"), F.avg("w").alias("m"), F.stddev_pop("w").alias("s"))
    x = w.filter("w <> 0").drop("n")
    common = x.join(x.toDF("other", "day", "u"), "day").filter("pair_key < other").groupBy("pair_key", "other").agg(F.sum(F.col("w") * F.col("u")).alias("xy"))
    y = common.join(per, "pair_key").join(per.select(F.col("pair_key").alias("other"), F.col("m").alias("m2"), F.col("s").alias("s2")), "other").filter("s > 1e-12 AND s2 > 1e-12")
    r = F.round((F.col("xy") / F.col("n") - F.col("m") * F.col("m2")) / (F.col("s") * F.col("s2")), 5)
    return y.select("pair_key", "other", r.alias("r")).filter("r >= 0.5")


def resumed_load(spark: SparkSession, d: str) -> DataFrame:
    """What a load of all six-hour chunks still has to read after it had got to the middle of March: trade messages per open chunk that has any."""
    t = table(spark, d, "horizon_trade").filter("ledger_close_time IS NOT NULL").select("ledger_close_time")
    chunks = chunk_table(spark, "2026-01-01 00:00:00", "2026-07-01 00:00:00")
    done = chunks.filter("chunk_end <= TIMESTAMP_NTZ'2026-03-15 00:00:00'")
    # chunks are as few as the calendar's quarters of days
    todo = open_chunks(chunks, done).select("chunk_start")
    rows = t.filter("ledger_close_time >= TIMESTAMP_NTZ'2026-03-15 00:00:00'").groupBy(F.window("ledger_close_time", "6 hours")["start"].alias("chunk_start")).agg(F.count(F.lit(1)).alias("rows"))
    return rows.join(F.broadcast(todo), "chunk_start").select(F.date_format("chunk_start", "yyyy-MM-dd HH").alias("chunk"), "rows")


def rejected_rows(spark: SparkSession, d: str) -> DataFrame:
    """Trades that filters reject, written by reason and read back: rows, amounts and the last id of each."""
    chain = [Filter("small", lambda r: F.col("amount") < 5), Filter("self", lambda r: F.col("base") == F.col("counter"))]
    path = shared_dir(spark, "rejected") + "/trades"
    first_rejection(trades(spark, d), chain).filter("reason IS NOT NULL").select("trade_id", "amount", "reason").write.partitionBy("reason").parquet(path)
    return spark.read.parquet(path).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"), exact_sum("amount").alias("amount"), F.max("trade_id").alias("last_id"))


def wallet_index(spark: SparkSession, d: str) -> DataFrame:
    """Accounts numbered from 0 in order of their first trade and name, by offsets of days."""
    first = wallet_rows(spark, d).groupBy("wallet").agg(F.min("ts").alias("first")).withColumn("day", F.to_date("first"))
    # one row per calendar day
    sizes = first.groupBy("day").agg(F.count(F.lit(1)).alias("k"))
    before = sizes.select("day", (F.sum("k").over(Window.orderBy("day")) - F.col("k")).alias("before"))
    within = F.row_number().over(Window.partitionBy("day").orderBy("first", "wallet")) - 1
    return first.withColumn("w", within).join(F.broadcast(before), "day").select("wallet", (F.col("w") + F.col("before")).alias("number"))


QUERIES = {
    f.__name__: f
    for f in (
        divergence_top, contribution_ranks, score_rows, archived_and_purged, export_rows, sane_pairs, hop_trades, swap_legs, drift_report,
        effect_table, winsorised_pairs, resumed_load, rejected_rows, wallet_index,
    )
}

_A = r"trim(base_amount, E' \t\n\r\f')"
_AMT = f"CASE WHEN regexp_matches({_A}, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST({_A} AS DECIMAL(38,18)) END"
_SLOPE = "(covar_pop({m}, y) * var_pop(ens / 100) - covar_pop(ens / 100, y) * covar_pop({m}, ens / 100)) / (var_pop({m}) * var_pop(ens / 100) - pow(covar_pop({m}, ens / 100), 2))"

ORACLE = {
    "divergence_top": f"WITH {_F} SELECT id, wallet, round(abs(rf - xg), 9) AS divergence FROM fb WHERE rf IS NOT NULL AND xg IS NOT NULL ORDER BY divergence DESC, id LIMIT 50",
    "contribution_ranks": f"""WITH {_F}, f AS (SELECT * FROM fb WHERE rf IS NOT NULL AND xg IS NOT NULL AND lg IS NOT NULL), m AS (SELECT avg(rf) AS a, avg(xg) AS b, avg(lg) AS c FROM f),
p AS (SELECT id, unnest([{{'s': round(abs(rf - a), 9), 'm': 'rf'}}, {{'s': round(abs(xg - b), 9), 'm': 'xg'}}, {{'s': round(abs(lg - c), 9), 'm': 'lg'}}]) AS e FROM f, m)
SELECT id, string_agg(e.m, '>' ORDER BY e.s DESC, e.m) AS models FROM p GROUP BY 1""",
    "score_rows": """SELECT id, wallet, asset_pair, score, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS at_time FROM risk_scores WHERE wallet IS NOT NULL AND asset_pair IS NOT NULL AND score BETWEEN 50 AND 100
AND timestamp >= TIMESTAMP '2026-02-01 00:00:00' AND timestamp < TIMESTAMP '2026-04-01 00:00:00'""",
    "archived_and_purged": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) FILTER ({c} < TIMESTAMP '{AS_OF}' - INTERVAL {n} DAY) AS archived, count(*) FILTER (NOT coalesce({c} < TIMESTAMP '{AS_OF}' - INTERVAL {n} DAY, FALSE)) AS kept FROM {t}"
        for t, c, n in (("risk_scores", "timestamp", 60), ("label_feedback", "confirmed_at", 90), ("ingestion_dedup_keys", "first_seen_at", 30))
    ),
    "export_rows": f"""WITH t AS (SELECT strftime(ledger_close_time, '%Y-%m-%dT%H:%M:%S') AS closed, CAST({_AMT} AS DECIMAL(22,7)) AS amount, coalesce(base_asset_issuer, '') AS issuer, coalesce(liquidity_pool_id, '') AS pool,
  CASE WHEN base_is_seller THEN 'sell' ELSE 'buy' END AS side FROM horizon_trade WHERE ledger_close_time IS NOT NULL)
SELECT substr(closed, 1, 10) AS day, side, pool <> '' AS pooled, count(*) AS rows, max(closed) AS last, CAST(sum(amount) AS DOUBLE) AS amount, count(DISTINCT issuer) AS issuers FROM t GROUP BY 1, 2, 3""",
    "sane_pairs": f"WITH {TRADES_SQL} SELECT upper(pair) AS pair, regexp_replace(upper(pair), '[^A-Z0-9]', '_', 'g') AS partition_key, count(*) AS trades FROM trades WHERE regexp_matches(upper(pair), '^[A-Z0-9/.:\\-]{{1,30}}$') GROUP BY 1, 2",
    "hop_trades": f"""WITH {TRADES_SQL}, ro AS (SELECT op, token, base_code, counter_code, amount, counter_amount, trade_id FROM trades WHERE op IS NOT NULL UNION ALL SELECT o, t, b, c, a::DOUBLE, x::DOUBLE, -1 FROM (VALUES {', '.join(map(str, ROUTES))}) v(o, t, b, c, a, x)),
h AS (SELECT *, row_number() OVER w - 1 AS hop, lag(counter_code) OVER w AS b FROM ro WINDOW w AS (PARTITION BY op ORDER BY token NULLS FIRST, trade_id)),
ok AS (SELECT op FROM h GROUP BY 1 HAVING count(*) > 1 AND bool_and(coalesce(b = base_code, hop = 0) AND coalesce(amount > 0 AND amount <= 1e15 AND counter_amount > 0 AND counter_amount <= 1e15, FALSE)))
SELECT op || '-hop' || hop AS id, CAST(hop AS INT) AS hop, base_code AS sold, counter_code AS received, round(counter_amount / amount, 9) AS price FROM h WHERE op IN (SELECT op FROM ok)""",
    "swap_legs": f"""WITH {TRADES_SQL}, l AS (SELECT op, base, base_code AS a, -CAST(amount AS DECIMAL(38,8)) AS x FROM trades WHERE op IS NOT NULL AND counter_amount IS NOT NULL UNION ALL SELECT op, base, counter_code, CAST(counter_amount AS DECIMAL(38,8)) FROM trades WHERE op IS NOT NULL AND counter_amount IS NOT NULL),
n AS (SELECT op, base, a, sum(x) AS net FROM l GROUP BY ALL HAVING abs(sum(x)) > 1e-7), g AS (SELECT op, base, min(a) FILTER (net < 0) AS s, min(a) FILTER (net > 0) AS r FROM n GROUP BY ALL)
SELECT g.op, g.base AS wallet, s AS sold, r AS received, CAST(-p.net AS DOUBLE) AS amount, CAST(q.net AS DOUBLE) AS got_amount FROM g JOIN n p ON p.op = g.op AND p.base = g.base AND p.a = s JOIN n q ON q.op = g.op AND q.base = g.base AND q.a = r""",
    "drift_report": f"""WITH k AS ({_SERIES_SQL['ks_two_sample']}), w0 AS ({_PSI_W} SELECT * FROM w), x AS (SELECT k.feature, ks, psi, sqrt(reference * current / (reference + current)) AS root FROM k JOIN w0 ON w0.feature = k.feature),
y AS (SELECT *, (root + 0.12 + 0.11 / root) * ks AS lam FROM x),
z AS (SELECT *, round(CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), lambda j: pow(-1, j - 1) * exp(-2.0 * j * j * lam * lam))))) END, 6) AS p FROM y)
SELECT feature, ks, p, psi, psi >= 0.2 AS flagged, psi < 0.1 AND p < 0.05 AS stable_but_drifted FROM z""",
    "effect_table": f"""WITH {_F}, f AS (SELECT * FROM fb WHERE rf IS NOT NULL AND xg IS NOT NULL AND lg IS NOT NULL AND ens IS NOT NULL)
{' UNION ALL '.join(f"SELECT '{m}' AS model, round({_SLOPE.format(m=m)}, 7) AS slope, round({_SLOPE.format(m=m)} * 0.6, 7) AS effect FROM f" for m in ('rf', 'xg', 'lg'))}""",
    "winsorised_pairs": f"""WITH {TRADES_SQL}, dl AS (SELECT pair_key, CAST(ts AS DATE) AS day, round(sum(amount), 6) AS v FROM trades GROUP BY ALL), a AS (SELECT pair_key FROM dl WHERE v > 0 GROUP BY 1 HAVING count(*) >= 10),
g AS (SELECT a.pair_key, c.day, coalesce(v, 0) AS v FROM a CROSS JOIN (SELECT DISTINCT day FROM dl) c LEFT JOIN dl ON dl.pair_key = a.pair_key AND dl.day = c.day),
q AS (SELECT pair_key, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM g GROUP BY 1), w AS (SELECT g.pair_key, day, greatest(least(v, hi), lo) AS w FROM g JOIN q ON q.pair_key = g.pair_key)
SELECT x.pair_key, z.pair_key AS other, round(covar_pop(x.w, z.w) / (stddev_pop(x.w) * stddev_pop(z.w)), 5) AS r FROM w x JOIN w z ON z.day = x.day AND x.pair_key < z.pair_key GROUP BY 1, 2
HAVING stddev_pop(x.w) > 1e-12 AND stddev_pop(z.w) > 1e-12 AND round(covar_pop(x.w, z.w) / (stddev_pop(x.w) * stddev_pop(z.w)), 5) >= 0.5""",
    "resumed_load": """SELECT strftime(time_bucket(INTERVAL 6 HOUR, ledger_close_time, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H') AS chunk, count(*) AS rows FROM horizon_trade
WHERE ledger_close_time >= TIMESTAMP '2026-03-15 00:00:00' AND ledger_close_time < TIMESTAMP '2026-07-01 00:00:00' GROUP BY 1""",
    "rejected_rows": f"""WITH {TRADES_SQL}, r AS (SELECT *, CASE WHEN amount < 5 THEN 'small' WHEN base = counter THEN 'self' END AS reason FROM trades)
SELECT reason, count(*) AS rows, CAST(sum(CAST(amount AS DECIMAL(38,8))) AS DOUBLE) AS amount, max(trade_id) AS last_id FROM r WHERE reason IS NOT NULL GROUP BY 1""",
    "wallet_index": f"WITH {WALLET_SQL}, f AS (SELECT wallet, min(ts) AS first FROM wrows GROUP BY 1) SELECT wallet, row_number() OVER (ORDER BY first, wallet) - 1 AS number FROM f",
}
