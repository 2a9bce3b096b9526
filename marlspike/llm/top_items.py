"""The first N items of every group, with one order for all runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.functions.aggregates import bounded_heap


def top_per_group(rows: DataFrame, group: str, item: str, score: str, size: int, extra: list[str] | None = None) -> DataFrame:
    """(group, place, item, score, extra...): the ``size`` best items of each group.

    Higher score first, equal scores by item ascending (bytes); places 1, 2, ...
    without ties. An item stands once per group, with its highest score (and of
    equal rows the least ``extra``). Rows with a null group, item or score take no
    part; NaN counts as the highest score, as Spark orders it. A group with fewer
    items comes out whole.

    Nothing of a group is sorted or gathered: the rows are reduced to one per
    (group, item) by a max that starts before the shuffle, and these to a heap
    of ``size`` per group in each task, so a group sends ``size`` entries per
    task however many items it has.
    """
    extra = extra or []
    best = (
        rows.filter(F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull())
        .groupBy(F.col(group).alias("g"), F.col(item).alias("i"))
        .agg(
            F.max(score).alias("s"),
            *([F.max_by(F.struct(*extra), F.struct(F.col(score))).alias("x")] if extra else []),
        )
    )
    entry = F.struct((-F.col("s")).alias("down"), F.col("i"), F.col("s"), *(["x"] if extra else []))
    heaps = best.groupBy("g").agg(bounded_heap(entry, size).alias("h"))
    placed = heaps.select("g", F.posexplode("h").alias("p", "e"))
    return placed.select(
        F.col("g").alias(group),
        (F.col("p") + 1).alias("place"),
        F.col("e.i").alias(item),
        F.col("e.s").alias(score),
        *[F.col(f"e.x.{c}").alias(c) for c in extra],
    )
