"""Items put into containers of fixed capacity with little space left over.

The plan is made on the histogram of sizes, which has at most ``capacity`` bars
whatever the number of items: a configuration LP gives patterns (how many items
of each size share a container) and how often each is used; items are then
handed to the patterns' places by their rank within their size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.session import durable

#: Parts of one size that one sub-group holds at most, about.
ROWS_PER_GROUP = 50_000


class _Knapsack:
    """Worth of the best filling of every room, by dynamic programming over ``grid`` units.

    Sizes are rounded up to units, so what is found always fits.
    """

    def __init__(self, sizes: np.ndarray, worth: np.ndarray, capacity: int, grid: int):
        self.units, self.room, self.worth = -(-sizes // grid), capacity // grid, worth
        # of sizes that round to one number of units, the worthiest stands for all
        best_of: dict[int, int] = {}
        for i in np.lexsort((-worth, self.units)):
            best_of.setdefault(int(self.units[i]), int(i))
        steps = np.array(sorted(best_of))
        items = np.array([best_of[u] for u in steps])
        gains = worth[items]
        self.value, self.choice = np.zeros(self.room + 1), np.full(self.room + 1, -1)
        for c in range(int(steps[0]), self.room + 1):
            k = int(np.searchsorted(steps, c, side="right"))
            total = self.value[c - steps[:k]] + gains[:k]
            j = int(total.argmax())
            if total[j] > self.value[c - 1]:
                self.value[c], self.choice[c] = total[j], items[j]
            else:
                self.value[c] = self.value[c - 1]

    def patterns(self, most: np.ndarray, many: int) -> list[np.ndarray]:
        """The ``many`` sizes worth most together with the best filling of the room beside one such item, as patterns.

        Of a size at most ``most`` items are taken.
        """
        beside = self.room - self.units
        total = np.where(beside >= 0, self.worth + self.value[np.maximum(beside, 0)], -1.0)
        out = []
        for j in np.argsort(-total, kind="stable")[:many]:
            if total[j] < 0:
                break
            taken, c = np.zeros(len(most), dtype=np.int64), int(beside[j])
            taken[j] = 1
            while c > 0:
                i = self.choice[c]
                if i < 0:
                    c -= 1
                    continue
                taken[i] += taken[i] < most[i]
                c -= int(self.units[i])
            out.append(taken)
        return out


def _fractional(
    sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, many: int, step: float, bounds: int = 0
) -> tuple[list[tuple[np.ndarray, float]], float]:
    """([(pattern, amount)], lower bound): the covering LP over configurations by multiplicative weights.

    Each size has a weight; the patterns worth most under the weights are priced
    out by the knapsack and get a share, and the weights of the sizes they cover
    fall. Amounts are scaled so that half of the sizes are covered in full. Any
    weights bound the LP from below by their sum over the items per worth of the
    best pattern; this is evaluated without a grid ``bounds`` times.
    """
    grid = max(1, capacity // 512)
    weight = sizes / (counts * sizes).sum()
    use: dict[bytes, float] = {}
    covered, bound = np.zeros(len(sizes)), float((counts * sizes).sum()) / capacity
    for r in range(rounds):
        if bounds and r % max(1, rounds // bounds) == 0:
            bound = max(bound, float((counts * weight).sum() / _Knapsack(sizes, weight, capacity, 1).value[-1]))
        found = _Knapsack(sizes, weight, capacity, grid).patterns(counts, many)
        more = np.zeros(len(sizes))
        for pattern in found:
            used = pattern > 0
            share = step / len(found) * float((counts[used] / pattern[used]).min())
            use[pattern.tobytes()] = use.get(pattern.tobytes(), 0.0) + share
            more += pattern * share
        covered += more
        weight = weight * np.exp(-4 * more / counts)
        weight /= (counts * weight).sum()
    scale = 1 / max(1e-12, float(np.median(covered / counts)))
    return [(np.frombuffer(k, dtype=np.int64), v * scale) for k, v in sorted(use.items(), key=lambda e: (-e[1], e[0]))], bound


def _fill_greedily(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns that use up ``counts`` exactly: largest size that fits first, repeated while it lasts."""
    left, out = counts.copy(), []
    while left.any():
        pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
        for i in range(len(sizes) - 1, -1, -1):
            if left[i] and sizes[i] <= room:
                n = min(left[i], room // sizes[i])
                pattern[i] = n
                room -= n * sizes[i]
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left -= pattern * times
        out.append((pattern, times))
    return out


@dataclass
class Plan:
    """Patterns (items per size, times) that hold a histogram exactly; the first ``by_lp`` items lie in the LP's patterns."""

    patterns: list[tuple[dict[int, int], int]]
    items: int
    by_lp: int
    bound: int  # no plan needs fewer containers


def plan_patterns(
    histogram: dict[int, int], capacity: int, rounds: int = 40, many: int = 24, step: float = 0.25, part: float = 0.3
) -> Plan:
    """A plan for a histogram of sizes in 1..capacity.

    The configuration LP is solved by ``_fractional`` and rounded in passes: the
    patterns with the largest amounts are taken, amounts rounded down but at
    least once, as far as the items left allow; the gap that is left in a pattern
    takes the largest items still to be had. After ``part`` of the LP's
    containers the residual LP is solved anew, so that what is left stays in the
    proportions that fill containers, until three items in a hundred are left.
    Patterns must be full at first; once a
    pass places next to nothing, up to 1 % of a container may stay empty, and
    more only while over a tenth of the items is left (sizes that fit together
    badly). What is left then is filled greedily. The greedy
    filling of everything replaces the plan only if it needs over 1 % fewer
    containers.
    """
    if not histogram:
        return Plan([], 0, 0, 0)
    sizes = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    left, plans, slack, bound = counts.copy(), [], 0.0, 0.0
    for turn in range(60):
        live = left > 0
        if left.sum() <= 0.03 * counts.sum():
            break
        amounts, lower = _fractional(sizes[live], left[live], capacity, rounds, many, step, bounds=0 if turn else 5)
        bound = bound or lower
        before, made = int(left.sum()), 0
        enough = part * float((left * sizes).sum()) / capacity + 4
        for short, amount in amounts:
            pattern = np.zeros(len(sizes), dtype=np.int64)
            pattern[live] = short
            used = pattern > 0
            times = min(max(1, int(amount)), int((left[used] // pattern[used]).min()))
            if times <= 0:
                continue
            full, room = pattern, capacity - int((pattern * sizes).sum())
            for i in range(int(np.searchsorted(sizes, room, side="right")) - 1, -1, -1):
                if room < sizes[0]:
                    break
                n = int(min(left[i] // times - full[i], room // sizes[i]))
                if n > 0:
                    full[i] += n
                    room -= n * int(sizes[i])
            if room > slack * capacity:
                continue
            plans.append((full, times))
            left = left - full * times
            made += times
            if made >= enough:
                break
        if before - int(left.sum()) < 0.03 * before:
            if slack >= (0.008 if left.sum() < 0.1 * counts.sum() else 0.5):
                break
            slack = 0.002 if slack == 0 else 2 * slack
    by_lp = int(counts.sum() - left.sum())
    plans += _fill_greedily(sizes, left, capacity)
    greedy = _fill_greedily(sizes, counts, capacity)
    if sum(t for _, t in greedy) < 0.99 * sum(t for _, t in plans):
        plans, by_lp = greedy, 0
    return Plan(
        [({int(sizes[i]): int(p[i]) for i in np.flatnonzero(p)}, t) for p, t in plans], int(counts.sum()), by_lp,
        int(np.ceil(bound - 1e-6)),
    )


def pack(items: DataFrame, key: str, size: str, capacity: int, rounds: int = 40) -> tuple[DataFrame, Plan]:
    """(assignment, plan). assignment: key, part, size, container; every item with a positive size in one container.

    An item larger than ``capacity`` is split: full containers of its own, and
    its rest as one more part; no other item is split. Items of size 0 or null
    need no container and don't come out. No container exceeds ``capacity``.
    ``key`` is unique; the result is the same in every run.

    Parts of a size are numbered without bringing them together: they are spread
    over sub-groups by hash (as many as keep ``ROWS_PER_GROUP`` parts in one even
    if all have one size), counted, and numbered within these; the offsets of
    sub-groups are states (sizes x sub-groups). Pattern places are looked up by
    size and number in a table with one row per pattern and size. The plan
    counts full containers of split items too.
    """
    spark = items.sparkSession
    whole = items.filter(F.col(size) > 0).select(F.col(key).alias("k"), F.col(size).cast("long").alias("n"))
    pieces = whole.select(
        "k", F.posexplode(
            F.transform(
                F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int")),
                lambda i: F.least(F.lit(capacity).cast("long"), F.col("n") - i * capacity),
            )
        ).alias("part", "s")
    )
    parts = whole.agg(F.sum(F.ceil(F.col("n") / capacity))).first()[0] or 0
    spread = max(8, -(-parts // ROWS_PER_GROUP))
    pieces = durable(pieces.select("k", "part", "s", F.pmod(F.xxhash64("k", "part"), F.lit(spread)).alias("g")), "pieces")
    states = pieces.groupBy("s", "g").agg(F.count(F.lit(1)).alias("n"))
    # sizes are at most the capacity: the histogram's bound
    histogram = {r["s"]: r["n"] for r in states.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(capacity, 0)
    plan = plan_patterns(histogram, capacity, rounds)
    patterns = plan.patterns
    if full:
        patterns.append(({capacity: 1}, full))
        plan = Plan(patterns, plan.items + full, plan.by_lp + full, plan.bound + full)
    rows, base, given = [], 0, {}
    for pattern, times in patterns:
        for s, n in pattern.items():
            start = given.get(s, 0)
            rows.append((s, start, start + n * times, base, n))
            given[s] = start + n * times
        base += times
    places = spark.createDataFrame(
        rows, T.StructType([T.StructField(c, T.LongType()) for c in ("s", "low", "high", "base", "each")])
    )
    # per size its places in order, found by the rank: a few patterns hold a size
    places = places.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("low", "high", "base", "each"))).alias("places"))
    offsets = states.select(
        "s", "g", (F.sum("n").over(Window.partitionBy("s").orderBy("g")) - F.col("n")).alias("before")
    )
    number = F.row_number().over(Window.partitionBy("s", "g").orderBy("k", "part")) - 1
    ranked = pieces.withColumn("r", number).join(offsets, ["s", "g"]).withColumn("rank", F.col("r") + F.col("before"))
    here = F.get(F.filter("places", lambda p: (p["low"] <= F.col("rank")) & (F.col("rank") < p["high"])), F.lit(0))
    # the table has at most one row per size
    found = ranked.join(F.broadcast(places), "s").withColumn("p", here)
    assigned = found.select(
        F.col("k").alias(key), "part", F.col("s").alias(size),
        (F.col("p.base") + F.floor((F.col("rank") - F.col("p.low")) / F.col("p.each"))).cast("long").alias("container"),
    )
    return assigned, plan
