"""Leading-digit queries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions import benford as b
from marlspike.functions.aggregates import bounded_heap
from marlspike.functions.stats import chi2_sf, multinomial_pvalues, normal_quantile
from marlspike.queries.views import ACTIVITY_SQL, AS_OF, TRADES_SQL, WALLET_SQL, activity, trades, wallet_rows

#: Trailing windows in hours.
WINDOWS = {"1h": 1, "4h": 4, "24h": 24, "7d": 168, "30d": 720}
EVENTS_END = "2024-01-30 00:00:00"
MIN_STRATUM = 30

def _n():
    """Digits counted in a histogram's row."""
    return b.total(b.counts())


def _histogram(rows: DataFrame, *keys) -> DataFrame:
    return rows.groupBy(*keys).agg(*b.digit_counts(b.leading_digit(F.col("amount")))).withColumn("n", _n())


def _sql_counts(digit: str = "dg") -> str:
    return ", ".join(f"count(*) FILTER ({digit} = {k}) AS c{k}" for k in range(1, 10))


_DG = "CASE WHEN amount > 0 AND amount < 'Infinity'::DOUBLE THEN CAST(nullif(regexp_extract(CAST(amount AS VARCHAR), '[1-9]'), '') AS INT) END AS dg"
_NSQL = "+".join(f"c{k}" for k in range(1, 10))
_CHI = "CASE WHEN n > 0 THEN " + " + ".join(f"pow(c{k} - n*{b.EXPECTED[k-1]!r}, 2)/(n*{b.EXPECTED[k-1]!r})" for k in range(1, 10)) + " ELSE 0 END"
_MAD = "CASE WHEN n > 0 THEN (" + " + ".join(f"abs(c{k}/n - {b.EXPECTED[k-1]!r})" for k in range(1, 10)) + ")/9 ELSE 0 END"


def _zsql(k: int) -> str:
    e = b.EXPECTED[k - 1]
    return f"(CASE WHEN n > 0 THEN greatest(abs(c{k}/n - {e!r}) - 1/(2*n), 0)/sqrt({e * (1 - e)!r}/n) ELSE 0 END)"


_MAXZ = "greatest(" + ", ".join(_zsql(k) for k in range(1, 10)) + ")"


def _gaps() -> list[str]:
    out, run, e = [], [], 0.0
    for k in range(1, 10):
        run.append(f"c{k}/n")
        e += b.EXPECTED[k - 1]
        out.append(f"({'+'.join(run)} - {e!r})")
    return out


_KS = "greatest(" + ", ".join(f"abs{g}" for g in _gaps()) + ")"
_KUIPER = "greatest(" + ", ".join(_gaps()) + ", 0) + greatest(" + ", ".join(f"-{g}" for g in _gaps()) + ", 0)"


def _hist_sql(source: str, keys: str, cte: str, where: str = "TRUE") -> str:
    by = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"WITH {cte}, dig AS (SELECT *, {_DG} FROM {source} WHERE {where}), h0 AS (SELECT {by}{_sql_counts()} FROM dig {group}), h AS (SELECT *, {_NSQL} AS n FROM h0)"


def benford_digit_hist(spark: SparkSession, d: str) -> DataFrame:
    return _histogram(trades(spark, d), "pair")


def benford_metrics_by_pair(spark: SparkSession, d: str) -> DataFrame:
    c, n = b.counts(), F.col("n")
    return _histogram(activity(spark, d), "pair").select(
        "pair", "n", F.round(b.chi_square(c, n), 6).alias("chi2"), F.round(b.mean_deviation(c, n), 9).alias("mad"),
        F.round(b.max_z(c, n), 6).alias("max_z"), (b.mean_deviation(c, n) > b.MAD_LIMIT).alias("anomalous"),
    )


def benford_zscores(spark: SparkSession, d: str) -> DataFrame:
    h = _histogram(trades(spark, d), "pair")
    zs = F.array(*[F.struct(F.lit(k).alias("digit"), F.round(b.z_score(F.col(f"c{k}"), F.col("n"), k), 6).alias("z")) for k in range(1, 10)])
    return h.select("pair", F.explode(zs).alias("x")).select("pair", "x.digit", "x.z")


def benford_chi2_pvalue(spark: SparkSession, d: str) -> DataFrame:
    h = _histogram(wallet_rows(spark, d), "wallet").filter("n >= 100")
    chi = b.chi_square(b.counts(), F.col("n"))
    return h.select("wallet", "n", F.round(chi, 5).alias("chi2"), F.round(b.chi2_sf8(chi), 8).alias("p"))


def benford_ks(spark: SparkSession, d: str) -> DataFrame:
    h = _histogram(trades(spark, d), "pair").filter("n >= 5")
    h = h.select("pair", "n", b.ks_statistic(b.counts(), F.col("n")).alias("ks"))
    h = h.withColumn("lam", b.ks_lambda(F.col("ks"), F.col("n")))
    return h.select(
        "pair", "n", F.round("ks", 8).alias("ks"), (F.col("ks") > b.KS_FACTOR / F.sqrt("n")).alias("flag"),
        F.round(b.ks_pvalue(F.col("lam")), 6).alias("p"),
    )


def benford_kuiper(spark: SparkSession, d: str) -> DataFrame:
    h = _histogram(trades(spark, d), "pair").filter("n >= 5")
    h = h.select("pair", "n", b.kuiper_statistic(b.counts(), F.col("n")).alias("v"))
    h = h.withColumn("lam", b.kuiper_lambda(F.col("v"), F.col("n"))).withColumn("pv", b.kuiper_pvalue(F.col("lam")))
    return h.select("pair", "n", F.round("v", 8).alias("kuiper"), F.round("pv", 6).alias("p"), (F.col("pv") < 0.05).alias("flag"))


def _windowed(rows: DataFrame, as_of: str, *keys) -> DataFrame:
    """One pass over the rows for all windows: a row enters every window that reaches it."""
    end = F.lit(as_of).cast("timestamp_ntz")
    age = F.timestamp_diff("MICROSECOND", F.col("ts"), end)
    hits = F.filter(
        F.array(*[F.struct(F.lit(k).alias("w"), F.lit(v * 3_600_000_000).alias("us")) for k, v in WINDOWS.items()]),
        lambda x: (age >= 0) & (age < x["us"]),
    )
    return rows.withColumn("x", F.explode(hits)).withColumn("w", F.col("x.w"))


def benford_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = _windowed(activity(spark, d), EVENTS_END)
    h = _histogram(rows, "pair", "w")
    c, n = b.counts(), F.col("n")
    m = h.select(
        "pair", "w", "n", b.chi_square(c, n).alias("chi"), b.mean_deviation(c, n).alias("mad"), b.ks_statistic(c, n).alias("ks"),
        b.kuiper_lambda(b.kuiper_statistic(c, n), n).alias("lam"),
    )
    flags = (
        (F.col("chi") > b.CHI2_CRITICAL).cast("int")
        + F.coalesce((F.col("ks") > b.KS_FACTOR / F.sqrt("n")).cast("int"), F.lit(0))
        + F.coalesce((b.kuiper_pvalue(F.col("lam")) < 0.05).cast("int"), F.lit(0))
    )
    return m.select(
        "pair", F.col("w").alias("window"), "n", F.round("chi", 6).alias("chi2"), F.round("mad", 8).alias("mad"),
        F.round(F.coalesce("ks", F.lit(0.0)), 8).alias("ks"), (flags >= 2).alias("combined_flag"),
    )


def benford_stratified(spark: SparkSession, d: str) -> DataFrame:
    """Summary over pairs with enough digits; the whole frame stands in if none has."""
    h = trades(spark, d).groupingSets([["pair_key"], []], "pair_key").agg(
        *b.digit_counts(b.leading_digit(F.col("amount"))), F.grouping("pair_key").alias("whole")
    ).withColumn("n", _n())
    c, n = b.counts(), F.col("n")
    m = h.select("pair_key", "whole", "n", b.chi_square(c, n).alias("chi2"), b.mean_deviation(c, n).alias("mad"))
    strata = (F.col("whole") == 0) & (F.col("n") >= MIN_STRATUM)
    s = m.agg(
        F.count_if(strata).alias("valid"), F.max(F.when(strata, F.col("chi2"))).alias("max_chi2"),
        F.max(F.when(strata, F.col("mad"))).alias("max_mad"), F.avg(F.when(strata, F.col("mad"))).alias("mean_mad"),
        F.count_if(strata & (F.col("mad") > b.MAD_LIMIT)).alias("over_mad"),
        F.count_if(strata & (F.col("chi2") > b.CHI2_CRITICAL)).alias("flagged"),
        F.max(F.when(F.col("whole") == 1, F.col("chi2"))).alias("whole_chi2"),
        F.max(F.when(F.col("whole") == 1, F.col("mad"))).alias("whole_mad"),
    )
    return s.select(
        "valid", F.round(F.coalesce("max_chi2", "whole_chi2"), 5).alias("max_chi2"),
        F.round(F.coalesce("max_mad", "whole_mad"), 8).alias("max_mad"),
        F.round(F.coalesce("mean_mad", "whole_mad"), 8).alias("mean_mad"), "over_mad", "flagged",
    )


def benford_flagged_digits(spark: SparkSession, d: str) -> DataFrame:
    z = benford_zscores(spark, d)
    return z.filter("z > 1.96").groupBy("pair").agg(F.array_join(F.array_sort(F.collect_list(F.col("digit").cast("string"))), ",").alias("digits"))


def benford_adaptive_window(spark: SparkSession, d: str) -> DataFrame:
    """Per pair the narrowest of the doubled windows (1 h .. 90 d) with at least 30 digits, else everything."""
    hours = [min(2**k, 2160) for k in range(13)]
    age = F.timestamp_diff("MICROSECOND", F.col("ts"), F.lit(EVENTS_END).cast("timestamp_ntz")) / F.lit(3_600_000_000.0)
    rows = activity(spark, d).filter((age >= 0) & b.leading_digit(F.col("amount")).isNotNull())
    counted = rows.groupBy("pair").agg(F.count(F.lit(1)).alias("n_all"), *[F.count_if(age < h).alias(f"h{h}") for h in hours])
    width = F.coalesce(*[F.when(F.col(f"h{h}") >= MIN_STRATUM, F.lit(h)) for h in hours])
    held = F.coalesce(*[F.when(F.col(f"h{h}") >= MIN_STRATUM, F.col(f"h{h}")) for h in hours], F.col("n_all"))
    return counted.select("pair", width.alias("hours"), held.alias("n"), width.isNull().alias("merged"))


def benford_last_n(spark: SparkSession, d: str) -> DataFrame:
    """Deviation of each wallet's last 100 amounts."""
    dg = b.leading_digit(F.col("amount"))
    rows = activity(spark, d).withColumn("dg", dg).filter("dg IS NOT NULL")
    # the last state needs the newest hundred only: a heap per wallet
    last = rows.groupBy("wallet").agg(bounded_heap(F.struct("ts", "event_id", "dg"), 100, largest=True).alias("h"))
    digits = last.select("wallet", F.col("h.dg").alias("dg"))
    c = [(F.size("dg") - F.size(F.array_remove("dg", k))).cast("long").alias(f"c{k}") for k in range(1, 10)]
    last = digits.select("wallet", *c).withColumn("n", _n())
    return last.select("wallet", "n", F.round(b.mean_deviation(b.counts(), F.col("n")), 8).alias("mad"), F.round(b.chi_square(b.counts(), F.col("n")), 6).alias("chi2"))


def benford_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Digit shares per unordered pair over the last 30 days; the law's shares where there is nothing."""
    end = F.lit(AS_OF).cast("timestamp_ntz")
    recent = (F.col("ts") > end - F.expr("INTERVAL 30 DAYS")) & (F.col("ts") <= end)
    h = trades(spark, d).groupBy("pair_key").agg(*b.digit_counts(b.leading_digit(F.col("amount")), recent)).withColumn("n", _n())
    shares = [F.round(F.when(F.col("n") > 0, F.col(f"c{k}") / F.col("n")).otherwise(b.EXPECTED[k - 1]), 9).alias(f"p{k}") for k in range(1, 10)]
    return h.select("pair_key", "n", *shares)


def joint_digit_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Rows per pair and digit within 7 days of the newest trade (pairs of the activity view)."""
    rows = activity(spark, d)
    newest = rows.agg(F.max("ts").alias("newest"))
    near = F.col("ts") > F.col("newest") - F.expr("INTERVAL 7 DAYS")
    return rows.join(F.broadcast(newest)).groupBy("pair").agg(*b.digit_counts(b.leading_digit(F.col("amount")), near))


def cross_pair_sync(spark: SparkSession, d: str) -> DataFrame:
    """Share of active hours in which at least 3 pairs deviate (max z > 2.5) at once."""
    hours = _histogram(activity(spark, d).withColumn("h", F.date_trunc("hour", "ts")), "h", "pair").filter("n > 0")
    odd = hours.withColumn("odd", b.max_z(b.counts(), F.col("n")) > 2.5)
    per_hour = odd.groupBy("h").agg(F.count_if("odd").alias("odd"), F.count(F.lit(1)).alias("active"))
    return per_hour.agg(
        F.count(F.lit(1)).alias("hours"), F.count_if(F.col("odd") >= 3).alias("synchronised"),
        F.round(F.count_if(F.col("odd") >= 3) / F.count(F.lit(1)), 9).alias("score"),
    )


def digit_entropy_delta(spark: SparkSession, d: str) -> DataFrame:
    h = _histogram(trades(spark, d), "pair_key").filter("n > 0")
    return h.select("pair_key", "n", F.round(b.entropy(b.counts(), F.col("n")) - b.EXPECTED_ENTROPY, 8).alias("delta"))


def benford_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Monte-Carlo p-values for short histograms; each different histogram is drawn once."""
    h = _histogram(trades(spark, d), "pair").filter("n > 0 AND n < 100")
    # histograms of one total share their draws: they go to one task, as short as they are
    different = h.select(*[f"c{k}" for k in range(1, 10)], "n").distinct().repartition("n").drop("n")
    shares = np.array(b.EXPECTED)

    @F.pandas_udf("double")
    def p_value(c: pd.Series) -> pd.Series:
        return pd.Series(multinomial_pvalues(np.array(c.tolist(), dtype=np.int64), shares, 10_000, 42))

    drawn = different.withColumn("p", p_value(F.array(*[f"c{k}" for k in range(1, 10)])))
    return h.join(drawn, [f"c{k}" for k in range(1, 10)]).select("pair", "n", "p")


def _scores() -> list[Column]:
    """Normal scores of the ranks of nine digit deviations (of equal ones the lower digit first), scaled to length one."""
    level = [normal_quantile(r / 10) for r in range(1, 10)]
    length = math.sqrt(sum(x * x for x in level))
    dev = [F.col(f"c{k}") / F.col("n") - b.EXPECTED[k - 1] for k in range(1, 10)]
    out = []
    for i, x in enumerate(dev):
        ahead = [(y <= x) if j < i else (y < x) for j, y in enumerate(dev) if j != i]
        rank = sum((a.cast("int") for a in ahead), F.lit(1))
        out.append(F.element_at(F.array(*[F.lit(v / length) for v in level]), rank).alias(f"s{i + 1}"))
    return out


def coordination(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, members, statistic, freedom): 8 times the sum of squared correlations of the members' scores s1..s9 over all pairs.

    The scores have length one, so the squares over all pairs are those of the
    nine by nine matrix of products less one per member: members are summed up,
    no pair is formed, however many there are.
    """
    cross = {(i, j): F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(1, 10) for j in range(i, 10)}
    agg = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), *[c.alias(f"x{i}{j}") for (i, j), c in cross.items()])
    total = sum((F.col(f"x{i}{j}") * F.col(f"x{i}{j}") * (1 if i == j else 2) for i, j in cross), F.lit(0.0))
    k = F.col("members")
    return agg.select(*keys, "members", F.greatest(8 * (total - k) / 2, F.lit(0.0)).alias("statistic"), (k * (k - 1) / 2).cast("long").alias("freedom"))


def benford_copula(spark: SparkSession, d: str) -> DataFrame:
    """Coordination of the digit deviations of all pairs with at least 30 digits."""
    h = _histogram(trades(spark, d), "pair_key").filter(F.col("n") >= MIN_STRATUM).select(*_scores())
    c = coordination(h, [])
    return c.select("members", "freedom", F.round("statistic", 5).alias("statistic"))


def benford_multivariate(spark: SparkSession, d: str) -> DataFrame:
    """Per wallet over its pairs: coordination of digit deviations with its p-value, and the digits' entropy less the law's.

    Wallets with a single pair have p = 1 and statistic 0.
    """
    @F.pandas_udf("double")
    def upper_tail(x: pd.Series, freedom: pd.Series) -> pd.Series:
        return pd.Series([chi2_sf(float(a), int(f)) if f else 1.0 for a, f in zip(x, freedom)])

    h = _histogram(wallet_rows(spark, d), "wallet", "pair_key").filter("n > 0")
    c = coordination(h.select("wallet", *_scores()), ["wallet"])
    per = h.groupBy("wallet").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(1, 10)]).withColumn("n", _n())
    e = per.select("wallet", F.round(b.entropy(b.counts(), F.col("n")) - b.EXPECTED_ENTROPY, 8).alias("entropy_delta"))
    return c.join(e, "wallet").select("wallet", "members", F.round("statistic", 5).alias("statistic"), "entropy_delta", upper_tail("statistic", "freedom").alias("p"))


def benford_multivariate_statistic(spark: SparkSession, d: str) -> DataFrame:
    """The same without the p-values."""
    return benford_multivariate(spark, d).drop("p")


QUERIES = {
    f.__name__: f
    for f in (
        benford_digit_hist, benford_metrics_by_pair, benford_zscores, benford_chi2_pvalue, benford_ks, benford_kuiper,
        benford_windows, benford_stratified, benford_flagged_digits, benford_adaptive_window, benford_last_n,
        benford_baseline, joint_digit_matrix, cross_pair_sync, digit_entropy_delta, benford_bootstrap, benford_copula, benford_multivariate, benford_multivariate_statistic,
    )
}

_Z_ROWS = " UNION ALL ".join(f"SELECT pair, {k} AS digit, round({_zsql(k)}, 6) AS z FROM h" for k in range(1, 10))
_KS_P = "list_sum(list_transform(generate_series(1, 100), lambda j: pow(-1.0, j - 1) * exp(-2.0*j*j*lam*lam)))"
_KU_P = "list_sum(list_transform(generate_series(1, 100), lambda j: (4.0*j*j*lam*lam - 1) * exp(-2.0*j*j*lam*lam)))"
_KU_PV = f"CASE WHEN lam < 0.4 THEN 1.0 ELSE greatest(0, least(1, 2*{_KU_P})) END"
_WIN = " UNION ALL ".join(
    f"SELECT *, '{k}' AS w FROM activity WHERE ts <= TIMESTAMP '{EVENTS_END}' AND ts > TIMESTAMP '{EVENTS_END}' - INTERVAL {v} HOUR"
    for k, v in WINDOWS.items()
)
_HOURS = [min(2**k, 2160) for k in range(13)]

_LEVEL = [normal_quantile(r / 10) for r in range(1, 10)]
_LEN = math.sqrt(sum(x * x for x in _LEVEL))


def _score_sql(k: int) -> str:
    e = b.EXPECTED
    ahead = " + ".join(f"(c{j} / n - {e[j - 1]!r} {'<=' if j < k else '<'} c{k} / n - {e[k - 1]!r})::INT" for j in range(1, 10) if j != k)
    return f"([{', '.join(repr(v / _LEN) for v in _LEVEL)}])[1 + {ahead}] AS s{k}"


_SCORES = ", ".join(_score_sql(k) for k in range(1, 10))
_DOT = " + ".join(f"a.s{k} * z.s{k}" for k in range(1, 10))

ORACLE = {
    "benford_digit_hist": f"{_hist_sql('trades', 'pair', TRADES_SQL)} SELECT * FROM h",
    "benford_metrics_by_pair": f"""{_hist_sql('activity', 'pair', ACTIVITY_SQL)}
SELECT pair, n, round({_CHI}, 6) AS chi2, round({_MAD}, 9) AS mad, round({_MAXZ}, 6) AS max_z, {_MAD} > 0.015 AS anomalous FROM h""",
    "benford_zscores": f"{_hist_sql('trades', 'pair', TRADES_SQL)} {_Z_ROWS}",
    "benford_chi2_pvalue": f"""{_hist_sql('wrows', 'wallet', WALLET_SQL)},
x AS (SELECT *, {_CHI} AS chi FROM h WHERE n >= 100)
SELECT wallet, n, round(chi, 5) AS chi2, round(exp(-chi/2)*(1+chi/2+pow(chi/2,2)/2+pow(chi/2,3)/6), 8) AS p FROM x""",
    "benford_ks": f"""{_hist_sql('trades', 'pair', TRADES_SQL)},
x AS (SELECT *, {_KS} AS ks FROM h WHERE n >= 5), y AS (SELECT *, (sqrt(n)+0.12+0.11/sqrt(n))*ks AS lam FROM x)
SELECT pair, n, round(ks, 8) AS ks, ks > 1.358/sqrt(n) AS flag,
  round(CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0, least(1, 2*{_KS_P})) END, 6) AS p FROM y""",
    "benford_kuiper": f"""{_hist_sql('trades', 'pair', TRADES_SQL)},
x AS (SELECT *, {_KUIPER} AS v FROM h WHERE n >= 5), y AS (SELECT *, (sqrt(n)+0.155+0.24/sqrt(n))*v AS lam FROM x),
z AS (SELECT *, {_KU_PV} AS pv FROM y)
SELECT pair, n, round(v, 8) AS kuiper, round(pv, 6) AS p, pv < 0.05 AS flag FROM z""",
    "benford_windows": f"""{_hist_sql('aw', 'pair, w', ACTIVITY_SQL + ', aw AS (' + _WIN + ')')},
x AS (SELECT *, {_CHI} AS chi, CASE WHEN n >= 5 THEN {_KS} END AS ks, CASE WHEN n >= 5 THEN {_KUIPER} END AS v FROM h),
y AS (SELECT *, (sqrt(n)+0.155+0.24/sqrt(n))*v AS lam FROM x)
SELECT pair, w AS "window", n, round(chi, 6) AS chi2, round({_MAD}, 8) AS mad, round(coalesce(ks, 0), 8) AS ks,
  (chi > 15.507)::INT + coalesce((ks > 1.358/sqrt(n))::INT, 0) + coalesce(({_KU_PV} < 0.05 AND v IS NOT NULL)::INT, 0) >= 2 AS combined_flag FROM y""",
    "benford_stratified": f"""{_hist_sql('trades', 'pair_key', TRADES_SQL)},
x AS (SELECT {_CHI} AS chi, {_MAD} AS mad FROM h WHERE n >= 30)
SELECT count(*) AS valid, round(max(chi), 5) AS max_chi2, round(max(mad), 8) AS max_mad, round(avg(mad), 8) AS mean_mad,
  count(*) FILTER (mad > 0.015) AS over_mad, count(*) FILTER (chi > 15.507) AS flagged FROM x""",
    "benford_flagged_digits": f"""{_hist_sql('trades', 'pair', TRADES_SQL)}, z AS ({_Z_ROWS})
SELECT pair, string_agg(digit::VARCHAR, ',' ORDER BY digit) AS digits FROM z WHERE z > 1.96 GROUP BY pair""",
    "benford_adaptive_window": f"""WITH {ACTIVITY_SQL},
g AS (SELECT pair, epoch_us(TIMESTAMP '{EVENTS_END}' - INTERVAL 0 HOUR) - epoch_us(ts) AS age FROM activity WHERE amount > 0 AND ts <= TIMESTAMP '{EVENTS_END}'),
c AS (SELECT pair, count(*) AS n_all, {', '.join(f'count(*) FILTER (age < {h}*3600000000) AS h{h}' for h in _HOURS)} FROM g GROUP BY pair)
SELECT pair, CASE {' '.join(f'WHEN h{h} >= 30 THEN {h}' for h in _HOURS)} END AS hours,
  CASE {' '.join(f'WHEN h{h} >= 30 THEN h{h}' for h in _HOURS)} ELSE n_all END AS n,
  NOT ({' OR '.join(f'h{h} >= 30' for h in _HOURS)}) AS merged FROM c""",
    "benford_last_n": f"""WITH {ACTIVITY_SQL}, dig AS (SELECT *, {_DG} FROM activity),
l AS (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY ts DESC, event_id DESC) AS back FROM dig WHERE dg IS NOT NULL),
h0 AS (SELECT wallet, {_sql_counts()} FROM l WHERE back <= 100 GROUP BY wallet), h AS (SELECT *, {_NSQL} AS n FROM h0)
SELECT wallet, n, round({_MAD}, 8) AS mad, round({_CHI}, 6) AS chi2 FROM h""",
    "benford_baseline": f"""WITH {TRADES_SQL}, dig AS (SELECT *, {_DG}, ts > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND ts <= TIMESTAMP '{AS_OF}' AS recent FROM trades),
h0 AS (SELECT pair_key, {', '.join(f'count(*) FILTER (dg = {k} AND recent) AS c{k}' for k in range(1, 10))} FROM dig GROUP BY pair_key), h AS (SELECT *, {_NSQL} AS n FROM h0)
SELECT pair_key, n, {', '.join(f'round(CASE WHEN n > 0 THEN c{k}/n ELSE {b.EXPECTED[k-1]!r} END, 9) AS p{k}' for k in range(1, 10))} FROM h""",
    "joint_digit_matrix": f"""WITH {ACTIVITY_SQL}, dig AS (SELECT *, {_DG}, ts > (SELECT max(ts) FROM activity) - INTERVAL 7 DAY AS near FROM activity)
SELECT pair, {', '.join(f'count(*) FILTER (dg = {k} AND near) AS c{k}' for k in range(1, 10))} FROM dig GROUP BY pair""",
    "cross_pair_sync": f"""{_hist_sql('ah', 'h, pair', ACTIVITY_SQL + ", ah AS (SELECT *, date_trunc('hour', ts) AS h FROM activity)")},
o AS (SELECT h AS hr, {_MAXZ} > 2.5 AS odd FROM h WHERE n > 0), p AS (SELECT hr, count(*) FILTER (odd) AS odd FROM o GROUP BY hr)
SELECT count(*) AS hours, count(*) FILTER (odd >= 3) AS synchronised, round(count(*) FILTER (odd >= 3) / count(*), 9) AS score FROM p""",
    "digit_entropy_delta": f"""{_hist_sql('trades', 'pair_key', TRADES_SQL)}
SELECT pair_key, n, round(-({' + '.join(f'CASE WHEN c{k} > 0 THEN (c{k}/n)*ln(c{k}/n) ELSE 0 END' for k in range(1, 10))}) - {b.EXPECTED_ENTROPY!r}, 8) AS delta FROM h WHERE n > 0""",
    "benford_copula": f"""WITH {TRADES_SQL}, g AS (SELECT pair_key, {_DG} FROM trades), h AS (SELECT pair_key, count(dg) AS n, {_sql_counts()} FROM g GROUP BY 1 HAVING count(dg) >= 30), s AS (SELECT pair_key, {_SCORES} FROM h)
SELECT (SELECT count(*) FROM s) AS members, count(*) AS freedom, round(8 * sum(pow({_DOT}, 2)), 5) AS statistic FROM s a JOIN s z ON a.pair_key < z.pair_key""",
    "benford_multivariate_statistic": f"""WITH {WALLET_SQL}, g AS (SELECT wallet, pair_key, {_DG} FROM wrows), h AS (SELECT wallet, pair_key, count(dg) AS n, {_sql_counts()} FROM g GROUP BY ALL HAVING count(dg) > 0), s AS (SELECT wallet, pair_key, {_SCORES} FROM h),
m AS (SELECT wallet, count(*) AS members FROM s GROUP BY 1), p AS (SELECT a.wallet, 8 * sum(pow({_DOT}, 2)) AS x FROM s a JOIN s z ON a.wallet = z.wallet AND a.pair_key < z.pair_key GROUP BY 1),
t AS (SELECT wallet, sum(n) AS n, {', '.join(f'sum(c{k}) AS c{k}' for k in range(1, 10))} FROM h GROUP BY 1)
SELECT m.wallet, members, round(coalesce(x, 0), 5) AS statistic, round(-({' + '.join(f'CASE WHEN c{k} > 0 THEN c{k} / n * ln(c{k} / n) ELSE 0 END' for k in range(1, 10))}) - {b.EXPECTED_ENTROPY!r}, 8) AS entropy_delta
FROM m LEFT JOIN p ON p.wallet = m.wallet JOIN t ON t.wallet = m.wallet""",
}
assert math.isclose(sum(b.EXPECTED), 1.0)
