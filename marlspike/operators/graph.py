"""Graphs as edge tables: aggregation, components, cycles, reachability."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlspike.session import durable


def trade_edges(trades: DataFrame) -> DataFrame:
    """(src, dst, volume, cnt): base to counter; rows without counter are skipped, self-loops stay."""
    return (
        trades.filter(F.col("counter").isNotNull())
        .groupBy(F.col("base").alias("src"), F.col("counter").alias("dst"))
        .agg(
            F.sum(F.greatest(F.col("amount"), F.lit(0.0)).cast("decimal(38,8)")).cast("double").alias("volume"),
            F.count(F.lit(1)).alias("cnt"),
        )
    )


def _trim(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round: (edges between nodes that have both directions, nodes that lack one)."""
    heads, tails = edges.select(F.col("dst").alias("v")).distinct(), edges.select(F.col("src").alias("v")).distinct()
    kept = edges.join(heads.withColumnRenamed("v", "src"), "src", "left_semi").join(tails.withColumnRenamed("v", "dst"), "dst", "left_semi")
    lone = heads.unionAll(tails).distinct().join(heads.intersect(tails), "v", "left_anti")
    return kept.select("src", "dst"), lone


def components_of(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Component number of each of ``n`` nodes, by one depth-first pass with a stack of open roots.

    Explicit stacks, so depth has no limit; linear in nodes and edges.
    """
    order = np.argsort(src, kind="stable")
    start = np.searchsorted(src[order], np.arange(n + 1)).tolist()
    heads = dst[order].tolist()
    number, component = [0] * n, [-1] * n
    count, found = 0, 0
    for origin in range(n):
        if number[origin]:
            continue
        count += 1
        number[origin] = count
        trail, at = [origin], [start[origin]]  # the path and the next edge of each of its nodes
        pending, roots = [origin], [origin]
        while trail:
            v, i = trail[-1], at[-1]
            if i < start[v + 1]:
                at[-1] = i + 1
                w = heads[i]
                if not number[w]:
                    count += 1
                    number[w] = count
                    trail.append(w)
                    at.append(start[w])
                    pending.append(w)
                    roots.append(w)
                elif component[w] < 0:
                    while number[roots[-1]] > number[w]:
                        roots.pop()
            else:
                trail.pop()
                at.pop()
                if roots[-1] == v:
                    roots.pop()
                    while True:
                        w = pending.pop()
                        component[w] = found
                        if w == v:
                            break
                    found += 1
    return np.array(component)


def _by_numpy(pdf: pd.DataFrame) -> pd.DataFrame:
    codes, names = pd.factorize(np.concatenate([pdf["src"], pdf["dst"]]), sort=True)
    half = len(pdf)
    c = components_of(codes[:half], codes[half:], len(names))
    least = np.full(c.max() + 1, len(names))
    np.minimum.at(least, c, np.arange(len(names)))
    return pd.DataFrame({"v": names, "component": names[least[c]]})


def _components_in_one_task(edges: DataFrame) -> DataFrame:
    kind = edges.schema["src"].dataType.simpleString()

    def run(frames):
        parts = [f for f in frames if len(f)]
        if parts:
            yield _by_numpy(pd.concat(parts))

    return edges.repartition(1).mapInPandas(run, f"v {kind}, component {kind}")


def weak_components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(v, component): nodes connected by edges in any direction, named by their least node.

    Each round every component joins its least neighbour; chains of such joins are
    followed to their end by pointer doubling, and the graph is contracted to the
    new components. At least half of the components that have a neighbour vanish
    in a round. Null ends are left out; a self-loop makes a component of one.
    """
    e = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst")
    label = durable(e.select(F.explode(F.array("src", "dst")).alias("v")).distinct().withColumn("component", F.col("v")), "wcc")
    links = durable(e.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "wcc")
    for _ in range(max_rounds):
        if not links.limit(1).count():
            break
        # towards smaller names only, so chains end; the least of a component stays
        roots = tree_roots(links, "b", "a").select("node", "root")
        roots = durable(roots, "wcc")
        label = durable(
            label.join(roots.withColumnRenamed("node", "component"), "component", "left").select("v", F.coalesce("root", "component").alias("component")), "wcc"
        )
        ends = links.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
        ends = ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b")
        links = durable(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "wcc")
    else:
        raise RuntimeError(f"weak components are left after {max_rounds} rounds")
    return label


def strong_components(edges: DataFrame, max_rounds: int = 10_000, one_task_edges: int = 1_000_000) -> DataFrame:
    """(v, component): strongly connected components, named by their least node.

    A graph of at most ``one_task_edges`` different edges (they are counted) is
    handled by one linear pass in one task. Otherwise it is split into weakly
    connected parts; those of at most that many edges get one pass each, all at
    once, and larger ones are handled by joins:

    Colouring: after trimming nodes without an edge in or out, every node takes
    the least name that can reach it; the nodes of a colour that can reach the
    node it is named after form its component, which leaves the graph; the rest
    goes on. All steps are joins and min aggregates over edges; each step's state
    is written to the shared folder, so lineage stays short. Nothing is
    collected but counts. Parallel edges, self-loops and null ends are allowed;
    nodes that only have self-loops are components of their own. The joins need
    as many rounds as a large part's paths are long; where ``max_rounds`` don't
    do, that is an error, never a result.
    """
    e = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct()
    e = durable(e, "edges")
    total = e.count()
    if total <= one_task_edges:
        return _components_in_one_task(e)
    weak = weak_components(e)
    tagged = durable(e.join(weak.toDF("src", "w"), "src"), "scc")
    sizes = tagged.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    kind = e.schema["src"].dataType.simpleString()
    small = tagged.join(sizes.filter(F.col("n") <= one_task_edges).select("w"), "w", "left_semi")
    # parts share passes: a pass holds about a quarter of the limit, besides the largest part in it
    passes = F.pmod(F.xxhash64("w"), F.lit(max(8, -(-4 * total // max(1, one_task_edges)))))
    passed = small.groupBy(passes.alias("p")).applyInPandas(lambda pdf: _by_numpy(pdf), f"v {kind}, component {kind}")
    large = sizes.filter(F.col("n") > one_task_edges).select("w")
    if not large.limit(1).count():
        return passed
    e = durable(tagged.join(large, "w", "left_semi").select("src", "dst"), "edges")
    return passed.unionByName(_components_by_joins(e, max_rounds))


def _components_by_joins(e: DataFrame, max_rounds: int) -> DataFrame:
    """Strongly connected components of different edges, by joins and min aggregates only."""
    nodes = e.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    loose = e.filter("src <> dst")
    done: DataFrame | None = None
    current = durable(loose, "scc")
    for _ in range(max_rounds):
        for _ in range(max_rounds):
            before = current.count()
            current = durable(_trim(current)[0], "scc")
            if current.count() == before:
                break
        else:
            raise RuntimeError(f"trimming took more than {max_rounds} rounds")
        if not current.count():
            break
        colour = current.select(F.explode(F.array("src", "dst")).alias("v")).distinct().withColumn("c", F.col("v"))
        colour = durable(colour, "scc")
        for _ in range(max_rounds):
            reached = current.join(colour.withColumnRenamed("v", "src"), "src").select(F.col("dst").alias("v"), "c")
            fresh = durable(colour.unionByName(reached).groupBy("v").agg(F.min("c").alias("c")), "scc")
            moved = fresh.join(colour.withColumnRenamed("c", "old"), "v").filter("c < old").limit(1).count()
            colour = fresh
            if not moved:
                break
        else:
            raise RuntimeError(f"colouring took more than {max_rounds} rounds")
        same = (
            current.join(colour.toDF("src", "cs"), "src").join(colour.toDF("dst", "cd"), "dst").filter("cs = cd").select("src", "dst")
        )
        same = durable(same, "scc")
        found = durable(colour.filter("v = c"), "scc")
        front = found
        for _ in range(max_rounds):
            back = same.join(front.withColumnRenamed("v", "dst"), "dst").select(F.col("src").alias("v"), "c").distinct()
            front = durable(back.join(found, "v", "left_anti"), "scc")
            if not front.limit(1).count():
                break
            found = durable(found.unionByName(front), "scc")
        else:
            raise RuntimeError(f"the way back took more than {max_rounds} rounds")
        done = found if done is None else done.unionByName(found)
        gone = found.select("v")
        current = durable(
            current.join(gone.withColumnRenamed("v", "src"), "src", "left_anti").join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti").select("src", "dst"),
            "scc",
        )
    else:
        raise RuntimeError(f"components are left after {max_rounds} rounds")
    if done is None:
        return nodes.select("v", F.col("v").alias("component"))
    return nodes.join(done.withColumnRenamed("c", "component"), "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def bottleneck_cycle(weights: np.ndarray, least_size: int = 3) -> float:
    """Greatest w such that a simple cycle of at least ``least_size`` nodes has all edges >= w; 0 without one.

    Edges are added from the heaviest on, by bisection over the distinct weights;
    for a threshold the existence of a long enough simple cycle is decided over
    subsets of nodes, each cycle counted from its least node. For at most a
    dozen nodes.
    """
    n = len(weights)
    levels = np.unique(weights[(weights > 0) & ~np.eye(n, dtype=bool)])

    def has_cycle(limit: float) -> bool:
        ok = (weights >= limit) & ~np.eye(n, dtype=bool)
        out = [int(sum(1 << j for j in range(n) if ok[i, j])) for i in range(n)]
        for root in range(n - least_size + 1):
            above = ((1 << n) - 1) & ~((1 << (root + 1)) - 1)
            ends = {1 << root: 1 << root}  # visited set -> possible last nodes
            while ends:
                longer: dict[int, int] = {}
                for seen, last in ends.items():
                    for v in range(n):
                        if not last >> v & 1:
                            continue
                        if seen.bit_count() >= least_size and out[v] >> root & 1:
                            return True
                        step = out[v] & above & ~seen
                        while step:
                            low = step & -step
                            longer[seen | low] = longer.get(seen | low, 0) | low
                            step ^= low
                ends = longer
        return False

    low, high, best = 0, len(levels) - 1, 0.0
    while low <= high:
        mid = (low + high) // 2
        if has_cycle(levels[mid]):
            best, low = float(levels[mid]), mid + 1
        else:
            high = mid - 1
    return best


def wash_rings(edges: DataFrame, components: DataFrame, least: int = 3, most: int = 10) -> DataFrame:
    """(component, size, volume, avg_count, cycle_volume, truncated) of components with at least ``least`` nodes.

    Up to ``most`` nodes the cycle volume is the best bottleneck of a simple
    cycle; larger components get half their volume and are marked truncated:
    their edges are only summed, never gathered. Small ones have at most
    most * (most - 1) edges, which go to one Python call each.
    """
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    inside = (
        edges.filter("src <> dst")
        .join(components.toDF("src", "component"), "src")
        .join(components.toDF("dst", "other"), "dst")
        .filter("component = other")
        .join(sizes, "component")
    )
    totals = inside.groupBy("component", "size").agg(F.sum("volume").alias("volume"), F.avg(F.col("cnt").cast("double")).alias("avg_count"))
    small = inside.filter(F.col("size") <= most).select("component", "src", "dst", "volume")

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["src"], *pdf["dst"]})
        at = {v: i for i, v in enumerate(names)}
        w = np.zeros((len(names), len(names)))
        np.add.at(w, ([at[x] for x in pdf["src"]], [at[x] for x in pdf["dst"]]), pdf["volume"].to_numpy())
        return pd.DataFrame({"component": [pdf["component"].iloc[0]], "cycle": [bottleneck_cycle(w, least)]})

    kind = components.schema["component"].dataType.simpleString()
    exact = small.groupBy("component").applyInPandas(best, f"component {kind}, cycle double")
    big = F.col("size") > most
    return totals.join(exact, "component", "left").select(
        "component", "size", "volume", "avg_count",
        F.when(big, F.col("volume") * 0.5).otherwise(F.coalesce("cycle", F.lit(0.0))).alias("cycle_volume"), big.alias("truncated"),
    )


def timing_spread(rows: DataFrame, group: str, ts: str) -> DataFrame:
    """(group, gaps, mean_gap_s, spread_s): population deviation of gaps between consecutive times of a group.

    A group's times are never brought together: gaps are taken within days, and
    between the last and first time of neighbouring active days.
    """
    day = F.to_date(ts)
    t = rows.select(F.col(group).alias("g"), day.alias("d"), F.timestamp_diff("MICROSECOND", F.lit("2020-01-01").cast("timestamp_ntz"), F.col(ts)).alias("t"))
    within = Window.partitionBy("g", "d").orderBy("t")
    gap = (F.col("t") - F.lag("t").over(within)) / F.lit(1e6)
    per_day = t.withColumn("gap", gap).groupBy("g", "d").agg(
        F.count("gap").alias("n"), F.coalesce(F.sum("gap"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0.0)).alias("q"),
        F.min("t").alias("lo"), F.max("t").alias("hi"),
    )
    between = (F.col("lo") - F.lag("hi").over(Window.partitionBy("g").orderBy("d"))) / F.lit(1e6)
    agg = per_day.withColumn("b", between).groupBy("g").agg(
        (F.sum("n") + F.count("b")).alias("gaps"), (F.sum("s") + F.coalesce(F.sum("b"), F.lit(0.0))).alias("s"),
        (F.sum("q") + F.coalesce(F.sum(F.col("b") * F.col("b")), F.lit(0.0))).alias("q"),
    )
    n = F.col("gaps")
    mean = F.when(n > 0, F.col("s") / n).otherwise(0.0)
    spread = F.when(n > 0, F.sqrt(F.greatest(F.col("q") / n - mean * mean, F.lit(0.0)))).otherwise(0.0)
    return agg.select(F.col("g").alias(group), "gaps", mean.alias("mean_gap_s"), spread.alias("spread_s"))


def directed_triangles(edges: DataFrame) -> DataFrame:
    """(v, cycles): how many directed cycles of three nodes each node lies on.

    Pairs are oriented from the node with fewer neighbours to the one with more;
    only paths that start twice at the lower node are formed, which bounds their
    number by edges^1.5 even around hubs.
    """
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    pair = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.max(F.col("src") < F.col("dst")).alias("ab"), F.max(F.col("src") > F.col("dst")).alias("ba")
    )
    degree = pair.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    p = pair.join(degree.toDF("a", "ka"), "a").join(degree.toDF("b", "kb"), "b")
    first = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    p = durable(
        p.select(
            F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("w"),
            F.when(first, F.col("ab")).otherwise(F.col("ba")).alias("out"), F.when(first, F.col("ba")).otherwise(F.col("ab")).alias("back"),
        ),
        "triangles",
    )
    one, two = p.toDF("u", "x", "ux", "xu"), p.toDF("u", "y", "uy", "yu")
    wedge = one.join(two, "u").filter((F.col("x") < F.col("y")) & ((F.col("ux") & F.col("yu")) | (F.col("uy") & F.col("xu"))))
    third = p.select(
        F.least("u", "w").alias("x"), F.greatest("u", "w").alias("y"),
        F.when(F.col("u") < F.col("w"), F.col("out")).otherwise(F.col("back")).alias("xy"),
        F.when(F.col("u") < F.col("w"), F.col("back")).otherwise(F.col("out")).alias("yx"),
    )
    cycles = (F.col("ux") & F.col("xy") & F.col("yu")).cast("long") + (F.col("uy") & F.col("yx") & F.col("xu")).cast("long")
    hit = wedge.join(third, ["x", "y"]).withColumn("k", cycles).filter("k > 0")
    return hit.select(F.explode(F.array("u", "x", "y")).alias("v"), "k").groupBy("v").agg(F.sum("k").alias("cycles"))


def tree_roots(links: DataFrame, child: str, parent: str, rounds: int = 40) -> DataFrame:
    """(node, root, depth): the end of each node's chain of parents, by pointer doubling.

    A chain of n links is followed in log2(n) joins. A node on or above a ring
    of parents has no end: its root is null. Of several parents the least counts.
    """
    one = links.filter(F.col(child).isNotNull() & F.col(parent).isNotNull() & (F.col(child) != F.col(parent)))
    one = one.groupBy(F.col(child).alias("v")).agg(F.min(parent).alias("p"))
    at = durable(one.select("v", "p", F.lit(1).cast("long").alias("k")), "roots")
    for _ in range(rounds):
        up = at.select(F.col("v").alias("p"), F.col("p").alias("pp"), F.col("k").alias("kk"))
        jumped = at.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"), (F.col("k") + F.coalesce("kk", F.lit(0))).alias("k"), F.col("pp").isNotNull().alias("moved"))
        jumped = durable(jumped, "roots")
        moved = jumped.filter("moved").limit(1).count()
        at = jumped.drop("moved")
        if not moved:
            break
    ends = at.join(at.select(F.col("v").alias("p")).distinct().withColumn("inner", F.lit(True)), "p", "left")
    return ends.select(F.col("v").alias("node"), F.when(F.col("inner").isNull(), F.col("p")).alias("root"), F.when(F.col("inner").isNull(), F.col("k")).alias("depth"))
