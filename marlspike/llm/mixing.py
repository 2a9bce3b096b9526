"""Sources mixed to target shares of the total size, small ones repeated up to a cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BUCKETS = 4096


def fill_shares(totals: dict[str, int], shares: dict[str, float], caps: dict[str, int], budget: float) -> dict[str, float]:
    """Capped water-filling: size per source, targets met as nearly as caps allow.

    Each source gets its share of ``budget``; one that can't give so much even
    when repeated ``cap`` times is clamped to total * cap, and its excess goes to
    the others in proportion to their shares, until nobody exceeds its cap. If
    all are clamped the budget isn't reached.
    """
    limit = {s: totals.get(s, 0) * max(0, caps[s]) for s in shares}
    given: dict[str, float] = {}
    free = {s for s in shares if shares[s] > 0}
    rest = float(budget)
    while free:
        weight = sum(shares[s] for s in free)
        over = {s for s in free if rest * shares[s] / weight >= limit[s]}
        if not over:
            given |= {s: rest * shares[s] / weight for s in free}
            break
        for s in over:
            given[s] = float(limit[s])
        rest -= sum(limit[s] for s in over)
        free -= over
        if rest <= 0:
            given |= dict.fromkeys(free, 0.0)
            break
    return {s: given.get(s, 0.0) for s in shares}


def mix(
    sized: DataFrame,
    targets: DataFrame,
    doc_id: str,
    source: str,
    size: str,
    budget: dict[str, int] | None = None,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """(selection, report) for every mix in ``targets`` (mix, source, target_share, max_repeats).

    selection: mix, doc_id, source, size, repeats (1 or more). report: mix,
    source, target_share, actual_share, tokens, available, repeats (mean), cap,
    documents. The budget of a mix is, unless given, what its sources hold once
    in all. Documents with null source or without size are never chosen; a
    source without documents stays in the report with share 0. A duplicate
    (mix, source) row counts once, its shares added.

    A source that gets e times its size gives every document floor(e) times and,
    for the fraction, documents in the order of a seeded hash until the fraction
    is reached. That order is never made by sorting a source: a histogram of
    sizes over 4,096 hash buckets finds the bucket where the fraction ends, and
    only this bucket's documents are ranked. What the driver holds is one row
    per (mix, source) and per (source, bucket); sources are configured, not data.
    """
    spark = sized.sparkSession
    asked = targets.groupBy("mix", "source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()
    named = sorted({r["source"] for r in asked if r["source"] is not None})
    docs = sized.filter(F.col(size) > 0).select(
        F.col(doc_id).alias("d"), F.col(source).alias("s"), F.col(size).cast("long").alias("n"),
        F.xxhash64(F.lit(seed), F.col(doc_id)).alias("h"),
    ).filter(F.col("s").isin(named) if named else F.lit(False)).withColumn("b", F.pmod("h", F.lit(_BUCKETS)).cast("int"))
    states = docs.groupBy("s", "b").agg(F.sum("n").alias("n")).collect()
    held: dict[str, dict[int, int]] = {}
    for r in states:
        held.setdefault(r["s"], {})[r["b"]] = r["n"]
    totals = {s: sum(b.values()) for s, b in held.items()}
    plan, lines = [], []
    for name in sorted({r["mix"] for r in asked}):
        rows = {r["source"]: r for r in asked if r["mix"] == name and r["source"] is not None}
        whole = (budget or {}).get(name) or sum(totals.get(s, 0) for s in rows)
        given = fill_shares(totals, {s: r["share"] for s, r in rows.items()}, {s: r["cap"] for s, r in rows.items()}, whole)
        for s, tokens in sorted(given.items()):
            total = totals.get(s, 0)
            lines.append((name, s, float(rows[s]["share"]), total, int(rows[s]["cap"])))
            if not total or tokens <= 0:
                continue
            times = min(int(tokens // total), int(rows[s]["cap"]))
            part = 0.0 if times >= rows[s]["cap"] else tokens - times * total
            edge, before = 0, 0
            while part > 0 and edge < _BUCKETS and before + held[s].get(edge, 0) <= part:
                before += held[s].get(edge, 0)
                edge += 1
            plan.append((name, s, times, edge if part > 0 else 0, float(part - before) if part > 0 else 0.0))
    # one row per (mix, source)
    steps = F.broadcast(spark.createDataFrame(plan, "mix string, s string, times int, edge int, left double"))
    placed = docs.join(steps, "s")
    at_edge = placed.filter((F.col("b") == F.col("edge")) & (F.col("left") > 0))
    so_far = F.sum("n").over(Window.partitionBy("mix", "s").orderBy("h", "d"))
    edge_docs = at_edge.select("mix", "s", "d", "n", "times", (so_far - F.col("n") / 2 <= F.col("left")).alias("more"))
    others = placed.filter((F.col("b") != F.col("edge")) | (F.col("left") <= 0)).select(
        "mix", "s", "d", "n", "times", (F.col("b") < F.col("edge")).alias("more")
    )
    chosen = (
        others.unionByName(edge_docs)
        .select("mix", F.col("d").alias(doc_id), F.col("s").alias("source"), F.col("n").alias(size), (F.col("times") + F.col("more").cast("int")).alias("repeats"))
        .filter("repeats > 0")
    )
    got = chosen.groupBy("mix", "source").agg(
        F.sum(F.col(size) * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents")
    )
    asked_rows = spark.createDataFrame(lines, "mix string, source string, target_share double, available long, cap int")
    tokens = F.coalesce("tokens", F.lit(0))
    report = asked_rows.join(got, ["mix", "source"], "left").select(
        "mix", "source", "target_share", tokens.alias("tokens"), "available", "cap", F.coalesce("documents", F.lit(0)).alias("documents"),
    )
    in_mix = F.sum("tokens").over(Window.partitionBy("mix"))
    report = report.select(
        "*", F.coalesce(F.try_divide(F.col("tokens"), in_mix), F.lit(0.0)).alias("actual_share"),
        F.coalesce(F.try_divide(F.col("tokens"), F.col("available")), F.lit(0.0)).alias("repeats"),
    )
    return chosen, report
