"""Interfaces that users extend: filters, node features, vector indexes, event buses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    """A named filter: ``rejects`` gives a boolean column; null counts as not rejected."""

    name: str
    rejects: Callable[[DataFrame], Column]


def first_rejection(rows: DataFrame, filters: list[Filter]) -> DataFrame:
    """``rows`` with ``reason``: the name of the first filter in order that rejects a row, null if none does."""
    reasons = [F.when(F.coalesce(f.rejects(rows), F.lit(False)), F.lit(f.name)) for f in filters]
    return rows.withColumn("reason", F.coalesce(*reasons, F.lit(None).cast("string")))


#: A node feature: (rows of one slice's trades per node) -> aggregate column.
NodeFeature = Callable[[], Column]


def node_table(trades: DataFrame, features: dict[str, NodeFeature], width: str = "4 hours") -> DataFrame:
    """(slice, node, one column per feature): trades of each account per slice of time, aggregated by the given features.

    Columns a feature may use: amount, counterparty, ts.
    """
    sides = F.array(F.struct(F.col("base").alias("node"), F.col("counter").alias("counterparty")), F.struct(F.col("counter").alias("node"), F.col("base").alias("counterparty")))
    rows = trades.filter("counter IS NOT NULL AND base <> counter").select(F.window("ts", width)["start"].alias("slice"), "ts", "amount", F.explode(sides).alias("s")).select("slice", "ts", "amount", "s.*")
    return rows.groupBy("slice", "node").agg(*[make().alias(name) for name, make in features.items()])


class VectorIndex(Protocol):
    """Nearest neighbours of queries among rows."""

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, place, vec_id, similarity), places from 1."""


class EventBus(Protocol):
    """Topics of keyed text messages."""

    def publish(self, topic: str, messages: DataFrame) -> None:
        """Append (key, value) rows to a topic."""

    def consume(self, topic: str) -> DataFrame:
        """All (key, value) rows of a topic."""


class FolderBus:
    """An event bus in a folder that all executors share: each publication appends files to its topic."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def publish(self, topic: str, messages: DataFrame) -> None:
        messages.select("key", "value").write.mode("append").json(f"{self.root}/{topic}")

    def consume(self, topic: str) -> DataFrame:
        return self.spark.read.schema("key string, value string").json(f"{self.root}/{topic}")
