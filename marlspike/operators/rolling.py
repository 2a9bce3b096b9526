"""Totals and averages over trailing periods of days, days without activity included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_totals(
    rows: DataFrame,
    entity: str,
    day: str,
    value: str,
    periods: tuple[int, ...] = (7, 30),
    at_least_active: int = 0,
) -> DataFrame:
    """Per entity and day: value and, per period, total, average per day and active days.

    Rows with a null entity, day or value don't count. Steps: aggregate per
    entity and day (partial sums before the shuffle, so an entity with a third
    of all rows costs no more than any other); cross every entity with its own
    calendar, first to last active day, which is the entity x calendar product
    without days that no period could fill; window sums over a fixed number of
    preceding rows, each row being one day. A row comes out for each of these
    days. Columns: entity, day, active (0 or 1), total, and ``total_n``,
    ``avg_n``, ``active_n`` for each period n. Averages divide by n, days before
    the first active day counting as zero. Values keep their type's exactness:
    decimals stay decimals.

    ``at_least_active``: entities with fewer active days in all are left out
    before the calendar is laid out - for callers that only want windows with
    at least so many active days, which such an entity can't have.

    A window holds the days of one entity, so a task's load is bounded by the
    length of the calendar, not by rows.
    """
    daily = (
        rows.filter(F.col(entity).isNotNull() & F.col(day).isNotNull() & F.col(value).isNotNull())
        .groupBy(F.col(entity).alias("e"), F.col(day).alias("d"))
        .agg(F.sum(value).alias("v"))
    )
    per_entity = Window.partitionBy("e")
    bounds = daily.select(
        "e", "d", "v",
        F.count(F.lit(1)).over(per_entity).alias("days"),
        F.min("d").over(per_entity).alias("first"),
        F.lead("d").over(per_entity.orderBy("d")).alias("next"),
    )
    if at_least_active > 1:
        bounds = bounds.filter(F.col("days") >= at_least_active)
    # each active day brings the empty days up to the next one: the entity's whole calendar
    until = F.coalesce(F.date_sub("next", 1), F.col("d"))
    dense = bounds.select(
        "e", "first", F.col("d").alias("active_day"), "v",
        F.explode(F.sequence(F.col("d"), until)).alias("d"),
    )
    here = F.col("d") == F.col("active_day")
    dense = dense.select(
        "e", "first", "d",
        here.cast("int").alias("active"),
        F.when(here, F.col("v")).otherwise(F.lit(0).cast(daily.schema["v"].dataType)).alias("v"),
    )
    by_day = Window.partitionBy("e").orderBy("d")

    def over(n: int) -> list[Column]:
        frame = by_day.rowsBetween(1 - n, 0)
        total = F.sum("v").over(frame)
        return [
            total.alias(f"total_{n}"),
            (total.cast("double") / n).alias(f"avg_{n}"),
            F.sum("active").over(frame).alias(f"active_{n}"),
        ]

    return dense.select(
        F.col("e").alias(entity), F.col("d").alias(day), F.col("first").alias("first_day"), "active",
        F.col("v").alias("total"), *[c for n in periods for c in over(n)],
    )
