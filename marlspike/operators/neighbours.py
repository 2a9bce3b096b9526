"""Looking a few rows back or ahead within a key without bringing the key's rows together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions.aggregates import bounded_heap


def with_neighbours(rows: DataFrame, keys: list[str], order: list[str], chunk: Column, back: int, ahead: int) -> DataFrame:
    """``rows`` cut into chunks of time, each with the rows just before and after it.

    Adds ``__chunk`` and ``__own``. Rows of a chunk are its own (true); up to
    ``back`` rows before and ``ahead`` rows after it, out of neighbouring chunks,
    are added with ``__own`` false. A window over (keys, ``__chunk``) ordered by
    ``order`` then sees, for every own row, as far back and ahead as a window over
    the keys would; keep own rows afterwards. ``chunk`` must not decrease along
    ``order`` (a day of the first order column); ``order`` must be total. A null
    chunk is a chunk of its own, before the others.

    Each chunk sends only its first and last few rows (bounded heaps, filled
    before the shuffle), and a window over the chunks of a key - as many as days -
    hands them on, so a key with a third of all rows is spread over its days.
    """
    names = rows.columns
    place = F.struct(*order)
    cut = rows.withColumn("__chunk", chunk)
    entry = F.struct(place.alias("o"), F.struct(*names).alias("r"))
    aggs = []
    if ahead:
        aggs.append(bounded_heap(entry, ahead).alias("heads"))
    if back:
        aggs.append(bounded_heap(entry, back, largest=True).alias("tails"))
    chunks = cut.groupBy(*keys, "__chunk").agg(*aggs)
    by = Window.partitionBy(*keys).orderBy("__chunk")
    parts = []
    if back:
        # every chunk holds a row at least, so ``back`` chunks are enough
        before = F.flatten(F.collect_list("tails").over(by.rowsBetween(-back, -1)))
        parts.append(F.slice(F.sort_array(before, asc=False), 1, back))
    if ahead:
        after = F.flatten(F.collect_list("heads").over(by.rowsBetween(1, ahead)))
        parts.append(F.slice(F.sort_array(after), 1, ahead))
    foreign = chunks.select("__chunk", F.concat(*parts).alias("near")).select("__chunk", F.explode("near").alias("e")).select("e.r.*", "__chunk", F.lit(False).alias("__own"))
    return cut.withColumn("__own", F.lit(True)).unionByName(foreign)
