"""Cycles of payments that close within a time limit, found inside components, slice of time by slice."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _best_span(hops: list[list[tuple[int, float]]]) -> tuple[int, int, list[float]]:
    """One payment per hop so that the times lie closest together, the earliest of such choices: (span, its first time, amounts)."""
    events = sorted((t, i, a) for i, payments in enumerate(hops) for t, a in payments)
    count, held, low, best = [0] * len(hops), 0, 0, None
    for high, (t, i, _) in enumerate(events):
        held += count[i] == 0
        count[i] += 1
        while held == len(hops):
            span = t - events[low][0]
            if best is None or span < best[0]:
                best = (span, low, high)
            count[events[low][1]] -= 1
            held -= count[events[low][1]] == 0
            low += 1
    if best is None:
        return -1, 0, []
    amounts: dict[int, float] = {}
    for _, i, a in events[best[1] : best[2] + 1]:
        amounts[i] = max(amounts.get(i, 0.0), a)
    return best[0], events[best[1]][0], [amounts[i] for i in range(len(hops))]


def timed_cycles(
    payments: DataFrame, components: DataFrame, longest: int = 6, within_s: int = 86_400, most_nodes: int | None = 12, shortest: int = 3
) -> DataFrame:
    """(component, nodes, length, span_s, value, status) of simple cycles of ``shortest`` to ``longest`` nodes.

    ``payments``: src, dst, t (microseconds), amount; ``components``: v, component.
    For each cycle one payment per hop is chosen so that their times lie closest
    together; cycles wider than ``within_s`` are left out; value is the least
    amount on the way. Of cycles over the same nodes and length the first in node
    order stays. With ``most_nodes`` a larger component isn't searched; it comes
    out once with status 'skipped', so nothing is lost silently. None searches all.
    Payments of a cycle lie within one of the overlapping slices of time, twice
    ``within_s`` long, so a component is grouped only slice by slice.
    """
    kind = components.schema["component"].dataType.simpleString()
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= shortest)
    inside = (
        payments.filter("src <> dst AND t IS NOT NULL AND amount > 0")
        .join(components.toDF("src", "component"), "src")
        .join(components.toDF("dst", "other"), "dst")
        .filter("component = other")
        .join(sizes, "component")
    )
    size = max(1, int(within_s * 1_000_000))
    slot = F.floor(F.col("t") / F.lit(size))
    sliced = inside.withColumn("slice", F.explode(F.array(slot - 1, slot)))
    if most_nodes is not None:
        sliced = sliced.filter(F.col("size") <= most_nodes)
    node = payments.schema["src"].dataType.simpleString()
    shape = f"component {kind}, members string, nodes string, path array<{node}>, length int, span long, began long, value double"

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        hops: dict[tuple, list] = {}
        for s, d, t, a in zip(pdf["src"], pdf["dst"], pdf["t"], pdf["amount"]):
            hops.setdefault((s, d), []).append((t, a))
        out_of: dict = {}
        into: dict = {}
        for s, d in sorted(hops):
            out_of.setdefault(s, []).append(d)
            into.setdefault(d, []).append(s)
        rows = []
        for root in sorted(out_of):
            # hops that lead back to the root over larger nodes: longer ways aren't begun
            back, edge = {root: 0}, [root]
            while edge:
                edge = [*{p: 0 for n in edge for p in into.get(n, []) if p > root and p not in back and back[n] < longest - 1}]
                if edge:
                    far = max(back.values()) + 1
                    back.update(dict.fromkeys(edge, far))
            paths = [(root,)]
            while paths:
                path = paths.pop()
                for nxt in out_of.get(path[-1], []):
                    if nxt == root and len(path) >= shortest:
                        span, began, amounts = _best_span([hops[a, b] for a, b in zip(path, (*path[1:], root))])
                        if 0 <= span <= size:
                            rows.append((repr((*sorted(path), len(path))), path, span, began, min(amounts)))
                    elif nxt > root and nxt in back and nxt not in path and len(path) + back[nxt] <= longest:
                        paths.append((*path, nxt))
        one = pdf["component"].iloc[0]
        return pd.DataFrame(
            [(one, m, ">".join(map(str, p)), [*p], len(p), s, b, v) for m, p, s, b, v in rows],
            columns=["component", "members", "nodes", "path", "length", "span", "began", "value"],
        )

    # the closest choice of each cycle over all slices, then the first of cycles over the same nodes
    each = sliced.groupBy("component", "slice").applyInPandas(search, shape)
    best = each.groupBy("component", "members", "nodes", "path", "length").agg(F.min_by(F.struct("span", "value"), F.struct("span", "began")).alias("x"))
    cycles = best.groupBy("component", "members", "length").agg(F.min_by(F.struct("nodes", "x"), "path").alias("y")).select(
        "component", "y.nodes", "length", (F.col("y.x.span") / F.lit(1e6)).alias("span_s"), F.col("y.x.value").alias("value"), F.lit("found").alias("status")
    )
    if most_nodes is None:
        return cycles
    skipped = sizes.filter(F.col("size") > most_nodes).select(
        "component", F.lit(None).cast("string").alias("nodes"), F.col("size").cast("int").alias("length"),
        F.lit(None).cast("double").alias("span_s"), F.lit(None).cast("double").alias("value"), F.lit("skipped").alias("status"),
    )
    return cycles.unionByName(skipped)
