"""Queries of the general problems: hot keys, rolling totals, drifting schemas, repeated messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.cells import amount, micros, stripped
from marlspike.operators.dedup import MessageStore, copies_removed, first_copies
from marlspike.operators.drift_schema import (
    appearing_kinds,
    field_names,
    field_rows,
    schema_changes,
    tagged_union,
    unified_records,
)
from marlspike.operators.rolling import rolling_totals
from marlspike.operators.skew import eager_join_totals, heavy_keys
from marlspike.session import durable, shared_dir
from marlspike.sources.tables import table

HEAVY_SHARE = 0.03


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys that hold at least 3 % of their table's rows."""
    trades = table(spark, d, "horizon_trade").select(
        F.lit("horizon_trade").alias("table_name"), F.col("base_account").alias("key_value")
    )
    scores = table(spark, d, "risk_scores").select(
        F.lit("risk_scores").alias("table_name"), F.col("asset_pair").alias("key_value")
    )
    return heavy_keys(trades.unionAll(scores), "table_name", "key_value", HEAVY_SHARE).select("table_name", "key_value")


def p3_account_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per account: trades x transfers it sent - pairs of both, total traded and transferred over the pairs."""
    trades = table(spark, d, "horizon_trade").select(
        F.col("base_account").alias("account"), amount(F.col("base_amount")).alias("traded")
    )
    transfers = table(spark, d, "bridge_transfers").select(
        F.col("source_address").alias("account"), F.col("amount_usd").cast("decimal(38,2)").alias("sent")
    )
    totals = eager_join_totals(
        trades, transfers, ["account"], {"traded": F.col("traded")}, {"sent": F.col("sent")}, how="left"
    )
    return totals.select(
        "account", F.col("left_rows").alias("trades"), F.col("right_rows").alias("transfers"), "pairs",
        F.col("traded").cast("double").alias("traded"), F.col("sent").cast("double").alias("sent"),
    )


def p3_pair_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per asset pair: scored rows x labelled rows, sums of scores and of labels over the join."""
    scores = table(spark, d, "risk_scores").select("asset_pair", F.col("score").cast("long").alias("score"))
    labels = table(spark, d, "label_feedback").select("asset_pair", F.col("true_label").cast("long").alias("true_label"))
    totals = eager_join_totals(scores, labels, ["asset_pair"], {"score": F.col("score")}, {"label": F.col("true_label")})
    return totals.select(
        "asset_pair", "pairs", F.col("left_rows").alias("scored"), F.col("right_rows").alias("labelled"),
        F.col("score").alias("score_sum"), F.col("label").alias("label_sum"),
    )


def _single_trades(spark: SparkSession, d: str) -> DataFrame:
    """(base_account, activity_day, value): each message once, with account, time and a usable amount."""
    kept = first_copies(
        table(spark, d, "horizon_trade"),
        F.col("paging_token"),
        F.col("id"),
        [F.col("received_at"), F.col("delivery_id")],
        [
            F.col("base_account"),
            F.col("ledger_close_time").cast("date").alias("activity_day"),
            amount(F.col("base_amount")).alias("value"),
        ],
    )
    return kept.filter(F.col("value") > 0)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Accounts and days whose last week holds three quarters of a busy trailing month."""
    rolled = rolling_totals(
        _single_trades(spark, d), "base_account", "activity_day", "value", (7, 30), at_least_active=8
    )
    return rolled.filter(
        (F.datediff("activity_day", "first_day") >= 29)
        & (F.col("active_30") >= 8)
        & (F.col("total_7") * 4 >= F.col("total_30") * 3)
    ).select("base_account", F.date_format("activity_day", "yyyy-MM-dd").alias("activity_day"))


def p4_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Per account and day: totals and averages of the trailing 7 and 30 days."""
    rolled = rolling_totals(_single_trades(spark, d), "base_account", "activity_day", "value", (7, 30))
    return rolled.select(
        "base_account", F.date_format("activity_day", "yyyy-MM-dd").alias("activity_day"), "active",
        *[c for n in (7, 30) for c in (F.col(f"total_{n}").cast("double").alias(f"total_{n}"), F.col(f"active_{n}"), F.col(f"avg_{n}"))],
    )


def _raw_fields(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    raw = table(spark, d, "horizon_trade_raw").withColumn("rid", F.get_json_object("payload", "$.id"))
    return field_rows(raw, "payload", keep)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a field between a feed's consecutive files."""
    fields = durable(_raw_fields(spark, d, ["feed", "file_seq", "rid"]), "fields")
    return schema_changes(fields, "feed", "file_seq", "rid").select(
        "feed", F.col("file_seq").cast("int").alias("file_seq"), "change_kind", "field_name", "new_name"
    )


def p5_schema(spark: SparkSession, d: str) -> DataFrame:
    """The fused schema of all files: per field its alternatives and how often it is there."""
    fused = tagged_union(_raw_fields(spark, d, ["feed"]), [])
    return fused.select("path", F.array_join("kinds", "|").alias("kinds"), "present", "filled")


def p5_appearing(spark: SparkSession, d: str) -> DataFrame:
    """When each alternative of a field first appears in a feed."""
    return appearing_kinds(_raw_fields(spark, d, ["feed", "file_seq"]), "feed", "file_seq")


def _unified(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, str]]:
    keys = ["feed", "file_seq", "record_id"]
    fields = durable(_raw_fields(spark, d, [*keys, "rid"]), "fields")
    names = field_names(fields, durable(schema_changes(fields, "feed", "file_seq", "rid"), "changes"), ["feed", "file_seq"])
    return unified_records(fields, names, keys), names


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    """One consistent row per landed record: every field under its canonical name, typed by the fused union of all files."""
    return _unified(spark, d)[0]


def p5_cells(spark: SparkSession, d: str) -> DataFrame:
    """The consistent table cell by cell: record, field, kind and canonical text of what is there."""
    rows, names = _unified(spark, d)
    cells = F.array(*[F.struct(F.lit(p).alias("field"), F.col(f"`{p}__kind`").alias("kind"), F.col(f"`{p}`").alias("text")) for p in sorted(set(names.values()))])
    return rows.select("record_id", F.explode(cells).alias("c")).select("record_id", "c.*").filter("kind IS NOT NULL")


def p5_trade_kinds(spark: SparkSession, d: str) -> DataFrame:
    """In ``horizon_trade``: per field with a changing form, each kind, its canonical values, first and last batch."""
    rows = table(spark, d, "horizon_trade").select(
        "batch_id",
        F.explode(
            F.array(
                F.struct(F.lit("trade_type").alias("path"), F.col("trade_type").alias("raw")),
                F.struct(F.lit("future_horizon_field").alias("path"), F.col("future_horizon_field").alias("raw")),
            )
        ).alias("x"),
    ).select("batch_id", "x.*").filter(stripped(F.col("raw")).isNotNull())
    bare = stripped(F.col("raw"))
    kind = (
        F.when(bare.rlike(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"), "number")
        .when(F.lower(bare).isin("true", "false"), "boolean")
        .when(bare.startswith("{") & bare.endswith("}"), "object")
        .otherwise("string")
    )
    return (
        rows.select("path", kind.alias("kind"), "batch_id", bare.alias("bare"))
        .groupBy("path", "kind")
        .agg(
            F.min("batch_id").alias("first_batch"), F.max("batch_id").alias("last_batch"), F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("bare") != F.lower("bare")).alias("not_lower"),
        )
    )


def _single_copies(rows: DataFrame, token: str, ident: str | None, order: list[str], label: str) -> DataFrame:
    """The kept rows after an earlier half was stored and the later half merged into it."""
    spark = rows.sparkSession
    store = MessageStore(spark, shared_dir(spark, label))
    arrived = micros(order[0])
    middle = rows.agg(F.percentile_approx(arrived, 0.5, 1000)).first()[0]
    day = F.date_format(order[0], "yyyy-MM-dd")
    late = F.coalesce(arrived > F.lit(middle), F.lit(False))
    store.merge(rows.filter(~late), token, ident, order, day)
    store.merge(rows.filter(late), token, ident, order, day)
    return store.read()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies to be left out, of trade messages and of idempotency keys."""
    trades = table(spark, d, "horizon_trade").select("delivery_id", "received_at", "paging_token", "id")
    keys = table(spark, d, "ingestion_dedup_keys").select(
        "id", "first_seen_at", F.lower("idempotency_key").alias("idempotency_key")
    )
    kept_trades = _single_copies(trades, "paging_token", "id", ["received_at", "delivery_id"], "trades")
    kept_keys = _single_copies(keys, "idempotency_key", None, ["first_seen_at", "id"], "keys")
    return (
        copies_removed(trades, kept_trades, "delivery_id")
        .select(F.lit("horizon_trade").alias("source_table"), F.col("delivery_id").alias("row_id"))
        .unionAll(
            copies_removed(keys, kept_keys, "id").select(
                F.lit("ingestion_dedup_keys").alias("source_table"), F.col("id").alias("row_id")
            )
        )
    )


def p7_kept_per_day(spark: SparkSession, d: str) -> DataFrame:
    """Single trade messages per day of receipt."""
    kept = first_copies(
        table(spark, d, "horizon_trade"), F.col("paging_token"), F.col("id"),
        [F.col("received_at"), F.col("delivery_id")], [F.col("received_at")],
    )
    return kept.groupBy(F.date_format("received_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("messages"))


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_account_totals, p3_pair_totals, p4_found, p4_rolling, p5_found, p5_schema, p5_appearing,
        p5_unified, p5_cells, p5_trade_kinds, p7_found, p7_kept_per_day,
    )
}

_BLANK = r"E' \t\n\r\f'"

#: Single trade messages, as ``first_copies`` keeps them.
_SINGLE = f"""
tok AS (SELECT *, nullif(trim(paging_token, {_BLANK}), '') AS tk, nullif(trim(id, {_BLANK}), '') AS ident FROM horizon_trade),
grouped AS (
  SELECT *, CASE WHEN ident IS NULL AND tk IS NULL THEN 'row' || delivery_id
                 WHEN bool_or(tk IS NULL) OVER (PARTITION BY coalesce(ident, tk)) AND ident IS NOT NULL THEN 'id' || ident
                 ELSE 'tok' || tk END AS copy_key FROM tok),
ranked AS (SELECT *, row_number() OVER (PARTITION BY copy_key ORDER BY received_at, delivery_id) AS rn FROM grouped),
single AS (SELECT * FROM ranked WHERE rn = 1)"""

_DAILY = f"""
{_SINGLE},
usable AS (
  SELECT base_account AS a, CAST(ledger_close_time AS DATE) AS d,
         TRY_CAST(trim(base_amount, {_BLANK}) AS DECIMAL(38,18)) AS v
  FROM single
  WHERE base_account IS NOT NULL AND ledger_close_time IS NOT NULL
    AND regexp_matches(trim(base_amount, {_BLANK}), '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$')),
daily AS (SELECT a, d, sum(v) AS v FROM usable WHERE v > 0 GROUP BY a, d),
span AS (SELECT a, min(d) AS lo, max(d) AS hi FROM daily GROUP BY a),
cal AS (SELECT a, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM span),
dense AS (SELECT cal.a, cal.lo, cal.d, coalesce(daily.v, 0) AS v, (daily.v IS NOT NULL)::INT AS active
          FROM cal LEFT JOIN daily ON cal.a = daily.a AND cal.d = daily.d),
rolled AS (
  SELECT a, lo, d, active,
    sum(v) OVER w7 AS t7, sum(v) OVER w30 AS t30, sum(active) OVER w7 AS n7, sum(active) OVER w30 AS n30
  FROM dense
  WINDOW w7 AS (PARTITION BY a ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY a ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""

_FIELDS = """
r AS (SELECT feed, file_seq, json_extract_string(payload, '$.id') AS rid, CAST(payload AS JSON) AS j FROM horizon_trade_raw
      WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE FALSE END),
f AS (SELECT feed, file_seq, rid, j, unnest(json_keys(j)) AS k FROM r),
x AS (SELECT feed, file_seq, rid, k, json_extract(j, '$."' || k || '"') AS v FROM f),
v AS (SELECT feed, file_seq, rid, k,
  CASE json_type(v) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind,
  CASE WHEN json_type(v) <> 'NULL' THEN CAST(json(v) AS VARCHAR) END AS val FROM x)"""

_CHANGES = f"""WITH {_FIELDS},
sch AS (SELECT feed, file_seq, k, list_sort(list_distinct(coalesce(list(kind) FILTER (kind IS NOT NULL), []))) AS kinds FROM v GROUP BY 1, 2, 3),
step AS (SELECT feed, file_seq, lag(file_seq) OVER (PARTITION BY feed ORDER BY file_seq) AS prev FROM (SELECT DISTINCT feed, file_seq FROM sch)),
gone AS (SELECT q.*, s.k FROM step q JOIN sch s ON s.feed = q.feed AND s.file_seq = q.prev
         WHERE NOT EXISTS (SELECT 1 FROM sch n WHERE n.feed = q.feed AND n.file_seq = q.file_seq AND n.k = s.k)),
fresh AS (SELECT q.*, s.k FROM step q JOIN sch s ON s.feed = q.feed AND s.file_seq = q.file_seq
          WHERE q.prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sch n WHERE n.feed = q.feed AND n.file_seq = q.prev AND n.k = s.k)),
ids AS (SELECT DISTINCT feed, file_seq, rid FROM v WHERE rid IS NOT NULL),
m AS (SELECT g.feed, g.file_seq, g.k AS old, n.k AS new, bool_and(o.val IS NOT DISTINCT FROM w.val) AS equal, bool_or(o.val IS NOT NULL) AS filled
      FROM gone g JOIN fresh n ON n.feed = g.feed AND n.file_seq = g.file_seq
      JOIN ids a ON a.feed = g.feed AND a.file_seq = g.file_seq JOIN ids b ON b.feed = g.feed AND b.file_seq = g.prev AND b.rid = a.rid
      LEFT JOIN v o ON o.feed = g.feed AND o.file_seq = g.prev AND o.rid = a.rid AND o.k = g.k
      LEFT JOIN v w ON w.feed = g.feed AND w.file_seq = g.file_seq AND w.rid = a.rid AND w.k = n.k GROUP BY 1, 2, 3, 4),
ren AS (SELECT feed, file_seq, old, new FROM m WHERE equal AND filled)"""

_USABLE = f"CASE WHEN regexp_matches(trim(base_amount, {_BLANK}), '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(trim(base_amount, {_BLANK}) AS DECIMAL(38,18)) END"

ORACLE = {
    "p3_account_totals": f"""
WITH t AS (SELECT base_account AS account, count(*) AS n, sum({_USABLE}) AS v FROM horizon_trade GROUP BY 1),
b AS (SELECT source_address AS account, count(*) AS m, sum(CAST(amount_usd AS DECIMAL(38,2))) AS s FROM bridge_transfers WHERE source_address IS NOT NULL GROUP BY 1)
SELECT t.account, n AS trades, coalesce(m, 0) AS transfers, n * coalesce(m, 1) AS pairs,
  CAST(v * coalesce(m, 1) AS DOUBLE) AS traded, CAST(s * n AS DOUBLE) AS sent FROM t LEFT JOIN b ON b.account = t.account""",
    "p5_found": f"""
{_CHANGES}
SELECT feed, file_seq, 'renamed' AS change_kind, old AS field_name, new AS new_name FROM ren
UNION ALL SELECT feed, file_seq, 'removed', k, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.feed = g.feed AND r.file_seq = g.file_seq AND r.old = g.k)
UNION ALL SELECT feed, file_seq, 'added', k, '' FROM fresh g WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.feed = g.feed AND r.file_seq = g.file_seq AND r.new = g.k)
UNION ALL SELECT q.feed, q.file_seq, 'retyped', a.k, '' FROM step q JOIN sch a ON a.feed = q.feed AND a.file_seq = q.prev
  JOIN sch b ON b.feed = q.feed AND b.file_seq = q.file_seq AND b.k = a.k WHERE len(a.kinds) > 0 AND len(b.kinds) > 0 AND a.kinds <> b.kinds""",
    "p5_schema": f"""
WITH {_FIELDS}
SELECT k AS path, coalesce(string_agg(DISTINCT kind, '|' ORDER BY kind), '') AS kinds, count(*) AS present, count(kind) AS filled FROM v GROUP BY 1""",
    "p3_found": """
WITH s AS (
  SELECT 'horizon_trade' AS table_name, base_account AS key_value FROM horizon_trade
  UNION ALL SELECT 'risk_scores', asset_pair FROM risk_scores),
n AS (SELECT table_name, key_value, count(*) AS c FROM s GROUP BY ALL),
t AS (SELECT table_name, count(*) AS total FROM s GROUP BY ALL)
SELECT n.table_name, n.key_value FROM n JOIN t ON n.table_name = t.table_name
WHERE key_value IS NOT NULL AND c >= 0.03 * total""",
    "p3_pair_totals": """
SELECT asset_pair, count(*) AS pairs, count(DISTINCT s.id) AS scored, count(DISTINCT l.id) AS labelled,
       CAST(sum(s.score) AS BIGINT) AS score_sum, CAST(sum(l.true_label) AS BIGINT) AS label_sum
FROM risk_scores s JOIN label_feedback l USING (asset_pair) GROUP BY asset_pair""",
    "p4_found": f"""WITH {_DAILY}
SELECT a AS base_account, strftime(d, '%Y-%m-%d') AS activity_day FROM rolled
WHERE d - lo >= 29 AND n30 >= 8 AND t7 * 4 >= t30 * 3""",
    "p4_rolling": f"""WITH {_DAILY}
SELECT a AS base_account, strftime(d, '%Y-%m-%d') AS activity_day, active,
  CAST(t7 AS DOUBLE) AS total_7, CAST(n7 AS BIGINT) AS active_7, CAST(t7 AS DOUBLE) / 7 AS avg_7,
  CAST(t30 AS DOUBLE) AS total_30, CAST(n30 AS BIGINT) AS active_30, CAST(t30 AS DOUBLE) / 30 AS avg_30
FROM rolled""",
    "p5_trade_kinds": f"""
WITH x AS (
  SELECT 'trade_type' AS path, nullif(trim(trade_type, {_BLANK}), '') AS bare, batch_id FROM horizon_trade
  UNION ALL SELECT 'future_horizon_field', nullif(trim(future_horizon_field, {_BLANK}), ''), batch_id FROM horizon_trade)
SELECT path,
  CASE WHEN regexp_matches(bare, '^[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?$') THEN 'number'
       WHEN lower(bare) IN ('true', 'false') THEN 'boolean'
       WHEN starts_with(bare, '{{') AND ends_with(bare, '}}') THEN 'object' ELSE 'string' END AS kind,
  min(batch_id) AS first_batch, max(batch_id) AS last_batch, count(*) AS rows,
  count(*) FILTER (bare <> lower(bare)) AS not_lower
FROM x WHERE bare IS NOT NULL GROUP BY 1, 2""",
    "p7_found": f"""
WITH {_SINGLE},
k AS (SELECT id, first_seen_at, lower(nullif(trim(idempotency_key, {_BLANK}), '')) AS ky FROM ingestion_dedup_keys),
kr AS (SELECT id, ky, row_number() OVER (PARTITION BY ky ORDER BY first_seen_at, id) AS rn FROM k)
SELECT 'horizon_trade' AS source_table, delivery_id AS row_id FROM ranked WHERE rn > 1
UNION ALL SELECT 'ingestion_dedup_keys', id FROM kr WHERE rn > 1 AND ky IS NOT NULL""",
    "p7_kept_per_day": f"""
WITH {_SINGLE}
SELECT strftime(received_at, '%Y-%m-%d') AS day, count(*) AS messages FROM single GROUP BY 1""",
    "p5_appearing": f"""
WITH {_FIELDS}
SELECT feed, k AS path, kind, min(file_seq) AS first_seq, count(*) AS records FROM v WHERE kind IS NOT NULL GROUP BY 1, 2, 3""",
    "p5_cells": f"""
{_CHANGES.replace("WITH ", "WITH RECURSIVE ", 1)},
rr AS (SELECT record_id, CAST(payload AS JSON) AS j FROM horizon_trade_raw WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE FALSE END),
rk AS (SELECT record_id, j, unnest(json_keys(j)) AS k FROM rr), rx AS (SELECT record_id, k, json_extract(j, '$."' || k || '"') AS v FROM rk),
cnt AS (SELECT k, count(*) AS n FROM v GROUP BY 1), pf AS (SELECT DISTINCT feed, file_seq, k FROM v),
lk AS (SELECT DISTINCT old, new FROM ren r WHERE NOT EXISTS (SELECT 1 FROM pf a JOIN pf b ON a.feed = b.feed AND a.file_seq = b.file_seq AND a.k = r.old AND b.k = r.new)),
ud AS (SELECT old AS a, new AS b FROM lk UNION SELECT new, old FROM lk),
rc AS (SELECT k AS a, k AS b FROM cnt UNION SELECT rc.a, ud.b FROM rc JOIN ud ON ud.a = rc.b),
nm AS (SELECT rc.a AS k, (list(rc.b ORDER BY n DESC, rc.b))[1] AS field FROM rc JOIN cnt ON cnt.k = rc.b GROUP BY 1),
ce AS (SELECT record_id, field, CASE json_type(v) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind,
  CASE WHEN json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') WHEN json_type(v) = 'OBJECT' THEN '{{' || list_aggregate(list_transform(list_sort(json_keys(v)), lambda q: '"' || q || '":' || CAST(json_extract(v, '$."' || q || '"') AS VARCHAR)), 'string_agg', ',') || '}}'
    WHEN json_type(v) = 'DOUBLE' THEN regexp_replace(regexp_replace(CAST(v AS VARCHAR), '([.][0-9]*?)0+$', '\\1'), '[.]$', '') ELSE CAST(v AS VARCHAR) END AS text FROM rx JOIN nm ON nm.k = rx.k)
SELECT record_id, field, min({{'kind': kind, 'text': text}}).kind AS kind, min({{'kind': kind, 'text': text}}).text AS text FROM ce WHERE kind IS NOT NULL GROUP BY 1, 2""",
}
