"""Aggregates with a small state that merges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction


def bounded_heap(col: Column, size: int, largest: bool = False) -> Column:
    """Aggregate: the ``size`` least values ascending (or largest descending) as an array.

    Spark's own bounded priority queue: a heap of at most ``size`` values is
    filled in every map task and heaps are merged after the shuffle.
    """
    return InternalFunction._invoke_internal_function_over_columns(
        "collect_top_k", col, F.lit(size), F.lit(not largest)
    )
