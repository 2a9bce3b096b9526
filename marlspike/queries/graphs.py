"""Graph and ordered-pattern queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike.functions.stats import exact_sum
from marlspike.operators.graph import (
    directed_triangles,
    strong_components,
    timing_spread,
    trade_edges,
    tree_roots,
    wash_rings,
)
from marlspike.operators.neighbours import with_neighbours
from marlspike.operators.rangejoin import band_join
from marlspike.queries.views import TRADES_SQL, TRANSFERS_SQL, trades, transfers
from marlspike.sources.tables import table

#: Edges of the ring graph: repeated trades between two accounts off the pools.
RING_TRADES = 3


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return trade_edges(trades(spark, d))


def _ring_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).filter((F.col("cnt") >= RING_TRADES) & (F.col("src") != F.col("dst")))


def trade_edge_table(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("src", "dst", F.col("volume"), "cnt")


def scc(spark: SparkSession, d: str) -> DataFrame:
    """Strongly connected components of the whole trade graph: size of each node's component."""
    c = strong_components(_edges(spark, d))
    return c.join(c.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("v", "component", "size")


def ring_graph_components(spark: SparkSession, d: str) -> DataFrame:
    c = strong_components(_ring_edges(spark, d))
    return c.select("v", "component")


def wash_ring_list(spark: SparkSession, d: str) -> DataFrame:
    e = _ring_edges(spark, d)
    r = wash_rings(e, strong_components(e))
    return r.select("component", "size", F.col("volume"), F.round("avg_count", 6).alias("avg_count"), F.round("cycle_volume", 4).alias("cycle_volume"), "truncated")


def ring_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Timing of trades inside each ring."""
    e = _ring_edges(spark, d)
    c = strong_components(e)
    sizes = c.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size >= 3")
    members = c.join(sizes, "component")
    t = trades(spark, d).filter("counter IS NOT NULL AND base <> counter").select("base", "counter", "ts")
    inside = (
        t.join(e.select(F.col("src").alias("base"), F.col("dst").alias("counter")), ["base", "counter"], "left_semi")
        .join(members.select(F.col("v").alias("base"), "component"), "base")
        .join(members.select(F.col("v").alias("counter"), F.col("component").alias("other")), "counter")
        .filter("component = other")
    )
    return timing_spread(inside, "component", "ts").select("component", "gaps", F.round("mean_gap_s", 3).alias("mean_gap_s"), F.round("spread_s", 3).alias("spread_s"))


def ring_membership(spark: SparkSession, d: str) -> DataFrame:
    """Each account's ring: its size, and the share of the account's outgoing volume that stays inside."""
    e = _ring_edges(spark, d)
    c = strong_components(e)
    sizes = c.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size >= 3")
    m = c.join(sizes, "component")
    marked = e.join(m.select(F.col("v").alias("src"), "component", "size"), "src").join(c.toDF("dst", "other"), "dst")
    return marked.groupBy("src", "component", "size").agg(
        F.round(F.sum(F.when(F.col("component") == F.col("other"), F.col("volume")).otherwise(0.0)) / F.sum("volume"), 8).alias("inside_share")
    ).withColumnRenamed("src", "account")


def triangle_cycles(spark: SparkSession, d: str) -> DataFrame:
    return directed_triangles(_edges(spark, d)).withColumnRenamed("v", "account")


def funding_roots(spark: SparkSession, d: str) -> DataFrame:
    return tree_roots(table(spark, d, "account_metadata"), "account", "funding_source")


def modularity(spark: SparkSession, d: str) -> DataFrame:
    """Modularity of the trade graph for communities of one funding source."""
    e = _edges(spark, d).filter("src <> dst")
    known = table(spark, d, "account_metadata").select("account", F.coalesce("funding_source", "account").alias("community"))
    named = e.join(known.toDF("src", "cs"), "src", "left").join(known.toDF("dst", "cd"), "dst", "left")
    named = named.select(F.coalesce("cs", "src").alias("cs"), F.coalesce("cd", "dst").alias("cd"))
    inner = named.filter("cs = cd").groupBy(F.col("cs").alias("c")).agg(F.count(F.lit(1)).alias("l"))
    ends = named.select(F.explode(F.array("cs", "cd")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("k"))
    m = named.agg(F.count(F.lit(1)).alias("m"))
    x = ends.join(inner, "c", "left").join(F.broadcast(m))  # m is one row
    q = F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("k") / (2 * F.col("m")), 2)
    return x.agg(F.round(F.sum(q), 9).alias("modularity"), F.count(F.lit(1)).alias("communities"))


def graph_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Four-hour slices of the graph without self-trades: nodes, edges, volume."""
    t = trades(spark, d).filter("counter IS NOT NULL AND base <> counter").withColumn("w", F.window("ts", "4 hours")["start"])
    e = t.groupBy("w", "base", "counter").agg(F.sum("amount").alias("v"))
    nodes = t.select("w", F.explode(F.array("base", "counter")).alias("n")).groupBy("w").agg(F.countDistinct("n").alias("nodes"))
    out = e.groupBy("w").agg(F.count(F.lit(1)).alias("edges"), exact_sum("v").alias("volume")).join(nodes, "w")
    return out.select(F.date_format("w", "yyyy-MM-dd HH:mm").alias("slice"), "nodes", "edges", "volume")


def heterogeneous_graph(spark: SparkSession, d: str) -> DataFrame:
    """Typed edges between wallets, assets and pools: how many, and how much they carry."""
    t = trades(spark, d)
    parts = [
        t.filter("counter IS NOT NULL").select(F.lit("wallet_wallet").alias("kind"), F.col("base").alias("a"), F.col("counter").alias("b"), "amount"),
        t.select(F.lit("wallet_asset").alias("kind"), F.col("base").alias("a"), F.col("base_code").alias("b"), "amount"),
        t.filter("pool IS NOT NULL").select(F.lit("wallet_pool").alias("kind"), F.col("base").alias("a"), F.col("pool").alias("b"), "amount"),
        t.select(F.lit("asset_asset").alias("kind"), F.col("base_code").alias("a"), F.col("counter_code").alias("b"), "amount"),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionAll(p)
    e = u.groupBy("kind", "a", "b").agg(F.sum("amount").alias("v"))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("a").alias("sources"), F.round(F.sum(F.log10(F.col("v") + 1e-9)), 4).alias("log_volume"))


#: Planted hops beside the given ones, as such routes are rare: operation, token, base code, counter code, amount, counter amount.
ROUTES = [("planted-a", "1-0", "XLM", "VUSD", 100.0, 90.0), ("planted-a", "1-1", "VUSD", "XLM", 90.0, 99.5), ("planted-b", "2-0", "XLM", "VUSD", 5.0, 4.0), ("planted-b", "2-1", "VUSD", "AQUR", 4.0, 3.0)]


def atomic_routes(spark: SparkSession, d: str) -> DataFrame:
    """Operations whose hops start and end in one asset."""
    names = ["op", "token", "base_code", "counter_code", "amount", "counter_amount"]
    p = spark.createDataFrame(ROUTES, "op string, token string, base_code string, counter_code string, amount double, counter_amount double").withColumn("trade_id", F.lit(-1).cast("long"))
    t = trades(spark, d).filter("op IS NOT NULL").select(*names, "trade_id").unionByName(p).groupBy("op").agg(
        F.count(F.lit(1)).alias("hops"), F.min_by(F.struct("base_code", "amount"), F.struct("token", "trade_id")).alias("f"),
        F.max_by(F.struct("counter_code", "counter_amount"), F.struct("token", "trade_id")).alias("l"),
    ).filter("hops > 1 AND f.base_code = l.counter_code")
    return t.select("op", "hops", F.col("f.base_code").alias("asset"), F.round(F.least(F.col("f.amount"), F.col("l.counter_amount")), 7).alias("volume"))


def path_decompose(spark: SparkSession, d: str) -> DataFrame:
    """Operations as numbered hops, kept only if each hop sells what the one before bought."""
    by = Window.partitionBy("op").orderBy("token", "trade_id")
    t = trades(spark, d).withColumn("hop", F.row_number().over(by) - 1).withColumn("bought", F.lag("counter_code").over(by))
    fits = F.coalesce(F.col("bought") == F.col("base_code"), F.lit(True))
    whole = t.groupBy("op").agg(F.count(F.lit(1)).alias("hops"), F.min(fits).alias("chained"))
    return whole.filter("hops > 1").groupBy("hops", "chained").agg(F.count(F.lit(1)).alias("operations"))


QUERIES = {
    f.__name__: f
    for f in (
        trade_edge_table, scc, ring_graph_components, wash_ring_list, ring_metrics, ring_membership, triangle_cycles,
        funding_roots, modularity, graph_snapshots, heterogeneous_graph, atomic_routes, path_decompose,
    )
}

_E = f"{TRADES_SQL}, e AS (SELECT base AS src, counter AS dst, CAST(sum(CAST(greatest(amount, 0) AS DECIMAL(38,8))) AS DOUBLE) AS volume, count(*) AS cnt FROM trades WHERE counter IS NOT NULL GROUP BY ALL)"


def _scc_sql(edges: str) -> str:
    return f"""g AS (SELECT DISTINCT src, dst FROM {edges}), nodes AS (SELECT src AS v FROM g UNION SELECT dst FROM g),
reach(a, b) AS (SELECT src, dst FROM g WHERE src <> dst UNION SELECT r.a, g.dst FROM reach r JOIN g ON r.b = g.src AND g.src <> g.dst),
comp AS (SELECT v, least(v, coalesce((SELECT min(r.b) FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a WHERE r.a = v), v)) AS component FROM nodes)"""


_RING = f"{_E}, re AS (SELECT * FROM e WHERE cnt >= {RING_TRADES} AND src <> dst), {_scc_sql('re')}, sz AS (SELECT component, count(*) AS size FROM comp GROUP BY 1)"
_ROOT = """WITH RECURSIVE p AS (SELECT account AS v, min(funding_source) AS p FROM account_metadata WHERE funding_source IS NOT NULL AND funding_source <> account GROUP BY 1),
c(node, up, depth) AS (SELECT v, p, 1 FROM p UNION ALL SELECT c.node, p.p, c.depth + 1 FROM c JOIN p ON p.v = c.up WHERE c.depth < 1000),
roots AS (SELECT node, up AS root, CAST(depth AS BIGINT) AS depth FROM c WHERE up NOT IN (SELECT v FROM p))"""

ORACLE = {
    "trade_edge_table": f"WITH {_E} SELECT src, dst, volume, cnt FROM e",
    "scc": f"WITH RECURSIVE {_E}, {_scc_sql('e')} SELECT v, component, count(*) OVER (PARTITION BY component) AS size FROM comp",
    "ring_graph_components": f"WITH RECURSIVE {_RING} SELECT v, component FROM comp",
    "ring_membership": f"""WITH RECURSIVE {_RING}, m AS (SELECT v, comp.component, size FROM comp JOIN sz ON sz.component = comp.component WHERE size >= 3)
SELECT re.src AS account, m.component, m.size, round(sum(CASE WHEN m.component = o.component THEN volume ELSE 0 END) / sum(volume), 8) AS inside_share
FROM re JOIN m ON m.v = re.src JOIN comp o ON o.v = re.dst GROUP BY 1, 2, 3""",
    "ring_metrics": f"""WITH RECURSIVE {_RING}, i AS (SELECT a.component, t.ts, epoch_us(t.ts) - epoch_us(lag(t.ts) OVER (PARTITION BY a.component ORDER BY t.ts)) AS gap
FROM trades t JOIN re ON re.src = t.base AND re.dst = t.counter JOIN comp a ON a.v = t.base JOIN comp b ON b.v = t.counter AND b.component = a.component JOIN sz ON sz.component = a.component AND size >= 3)
SELECT component, count(gap) AS gaps, round(coalesce(avg(gap / 1e6), 0), 3) AS mean_gap_s, round(coalesce(stddev_pop(gap / 1e6), 0), 3) AS spread_s FROM i GROUP BY 1""",
    "triangle_cycles": f"""WITH {_E}, g AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst)
SELECT a.src AS account, count(*) AS cycles FROM g a JOIN g b ON a.dst = b.src JOIN g c ON b.dst = c.src AND c.dst = a.src WHERE b.dst <> a.src GROUP BY 1""",
    "funding_roots": f"{_ROOT} SELECT p.v AS node, root, depth FROM p LEFT JOIN roots ON roots.node = p.v",
    "modularity": f"""WITH {_E}, k AS (SELECT account, coalesce(funding_source, account) AS c FROM account_metadata),
n AS (SELECT coalesce(a.c, src) AS cs, coalesce(b.c, dst) AS cd FROM e LEFT JOIN k a ON a.account = src LEFT JOIN k b ON b.account = dst WHERE src <> dst),
i AS (SELECT cs AS c, count(*) AS l FROM n WHERE cs = cd GROUP BY 1), x AS (SELECT c, count(*) AS k FROM (SELECT cs AS c FROM n UNION ALL SELECT cd FROM n) GROUP BY 1)
SELECT round(sum(coalesce(l, 0) / (SELECT count(*) FROM n) - pow(k / (2 * (SELECT count(*) FROM n)), 2)), 9) AS modularity, count(*) AS communities FROM x LEFT JOIN i ON i.c = x.c""",
    "graph_snapshots": f"""WITH {TRADES_SQL}, t AS (SELECT *, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2000-01-01') AS w FROM trades WHERE counter IS NOT NULL AND base <> counter),
e AS (SELECT w, base, counter, sum(amount) AS v FROM t GROUP BY ALL), nd AS (SELECT w, count(DISTINCT n) AS nodes FROM (SELECT w, base AS n FROM t UNION ALL SELECT w, counter FROM t) GROUP BY 1)
SELECT strftime(e.w, '%Y-%m-%d %H:%M') AS slice, max(nodes) AS nodes, count(*) AS edges, CAST(sum(CAST(v AS DECIMAL(38,8))) AS DOUBLE) AS volume FROM e JOIN nd ON nd.w = e.w GROUP BY e.w""",
    "heterogeneous_graph": f"""WITH {TRADES_SQL}, u AS (SELECT 'wallet_wallet' AS kind, base AS a, counter AS b, amount FROM trades WHERE counter IS NOT NULL UNION ALL SELECT 'wallet_asset', base, base_code, amount FROM trades
UNION ALL SELECT 'wallet_pool', base, pool, amount FROM trades WHERE pool IS NOT NULL UNION ALL SELECT 'asset_asset', base_code, counter_code, amount FROM trades),
e AS (SELECT kind, a, b, sum(amount) AS v FROM u GROUP BY ALL)
SELECT kind, count(*) AS edges, count(DISTINCT a) AS sources, round(sum(log10(v + 1e-9)), 4) AS log_volume FROM e GROUP BY 1""",
    "atomic_routes": f"""WITH {TRADES_SQL}, ro AS (SELECT op, token, base_code, counter_code, amount, counter_amount, trade_id FROM trades WHERE op IS NOT NULL UNION ALL SELECT o, t, b, c, a::DOUBLE, x::DOUBLE, -1 FROM (VALUES {', '.join(map(str, ROUTES))}) v(o, t, b, c, a, x)), r AS (SELECT *, count(*) OVER (PARTITION BY op) AS hops, row_number() OVER (PARTITION BY op ORDER BY token NULLS FIRST, trade_id) AS a,
  row_number() OVER (PARTITION BY op ORDER BY token DESC NULLS LAST, trade_id DESC) AS z FROM ro)
SELECT f.op, f.hops, f.base_code AS asset, round(least(f.amount, l.counter_amount), 7) AS volume FROM r f JOIN r l ON f.op = l.op AND f.a = 1 AND l.z = 1 WHERE f.hops > 1 AND f.base_code = l.counter_code""",
    "path_decompose": f"""WITH {TRADES_SQL}, r AS (SELECT op, base_code, lag(counter_code) OVER (PARTITION BY op ORDER BY token NULLS FIRST, trade_id) AS b FROM trades),
w AS (SELECT op, count(*) AS hops, bool_and(coalesce(b = base_code, TRUE)) AS chained FROM r GROUP BY 1) SELECT hops, chained, count(*) AS operations FROM w WHERE hops > 1 GROUP BY 1, 2""",
}
