"""Readers and writers of stored tables: upserts, partitioned export, tiers, retention, dead letters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_new(existing: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows of ``incoming`` to append: one per key (the first by ``order``) that ``existing`` lacks. Null keys are never inserted."""
    names = incoming.columns
    first = incoming.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("x"))
    return first.select("x.*").join(existing.select(key), key, "left_anti").select(*names)


def latest_by_key(tables: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Upsert result: of all tables' rows the latest per key by ``order`` (null first, so any value wins)."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    names = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("x"))
    return best.select(*keys, "x.*")


def partition_states(rows: DataFrame, parts: list[str], token: str) -> DataFrame:
    """(parts..., rows, last): what tells whether an exported partition is out of date."""
    return rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("rows"), F.max(token).alias("last"))


def changed_partitions(now: DataFrame, manifest: DataFrame, parts: list[str]) -> DataFrame:
    """Partitions whose count or highest token differ from the manifest's, and new ones."""
    same = [now[p].eqNullSafe(manifest[p]) for p in parts] + [now["rows"] == manifest["rows"], now["last"].eqNullSafe(manifest["last"])]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return now.join(manifest, condition, "left_anti")


def export_partitions(rows: DataFrame, path: str, parts: list[str], manifest: DataFrame | None, token: str) -> DataFrame:
    """Write only partitions that changed, overwriting them alone; returns the new manifest.

    A partition column is part of the path; a partition is rewritten whole.
    """
    now = partition_states(rows, parts, token)
    todo = now if manifest is None else changed_partitions(now, manifest, parts)
    fresh = rows.join(todo.select(*parts), parts, "left_semi")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    return now


def day_partition(rows: DataFrame, ts: str) -> DataFrame:
    """Adds year, month and day, the layout of the cold tier."""
    return rows.withColumns({"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)})


def read_tier(spark: SparkSession, path: str, ts: str, since: dt.datetime | None = None, until: dt.datetime | None = None, **equal) -> DataFrame:
    """Cold tier rows in [since, until) with equality filters.

    The bounds are also put on year, month and day, so whole folders are skipped;
    what is left reaches the Parquet scan as pushed filters.
    """
    df = spark.read.parquet(path)
    code = F.col("year") * 10_000 + F.col("month") * 100 + F.col("day")
    number = lambda t: t.year * 10_000 + t.month * 100 + t.day
    if since is not None:
        df = df.filter((code >= number(since)) & (F.col(ts) >= F.lit(since).cast("timestamp_ntz")))
    if until is not None:
        df = df.filter((code <= number(until)) & (F.col(ts) < F.lit(until).cast("timestamp_ntz")))
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def archive(rows: DataFrame, ts: str, cutoff: Column, path: str) -> DataFrame:
    """Rows before ``cutoff`` go to the cold tier, the others are returned; nothing is dropped before it is written."""
    day_partition(rows.filter(F.col(ts) < cutoff), ts).write.mode("append").partitionBy("year", "month", "day").parquet(path)
    return rows.filter(F.coalesce(F.col(ts) >= cutoff, F.lit(True)))


def newest(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """Row-cap pruning: the ``most`` first rows by ``order`` (kept per task, then merged; no global sort)."""
    return rows.orderBy(*order).limit(most)


def chunk_table(spark: SparkSession, start: str, end: str, hours: int = 6) -> DataFrame:
    """(chunk_start, chunk_end): half-open chunks that cover [start, end), the last one cut at the end."""
    span = spark.range(1).select(F.lit(start).cast("timestamp_ntz").alias("a"), F.lit(end).cast("timestamp_ntz").alias("b"))
    step = F.expr(f"INTERVAL {int(hours)} HOURS")
    c = span.filter("a < b").select("b", F.explode(F.sequence(F.col("a"), F.greatest("a", "b"), step)).alias("chunk_start")).filter("chunk_start < b")
    return c.select("chunk_start", F.least(F.col("chunk_start") + step, "b").alias("chunk_end"))


def open_chunks(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks a restart still has to load."""
    return chunks.join(done.select("chunk_start"), "chunk_start", "left_anti")


def labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with at least wallet and label (int); other columns stay text. A missing one is an error."""
    df = spark.read.option("header", True).csv(path)
    missing = {"wallet", "label"} - set(df.columns)
    if missing:
        raise ValueError(f"{path} lacks {sorted(missing)}")
    return df.withColumn("label", F.col("label").try_cast("int"))


def split_bad(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows without error, and rows with their ``error_class``."""
    marked = rows.withColumn("error_class", error)
    return marked.filter("error_class IS NULL").drop("error_class"), marked.filter("error_class IS NOT NULL")


def word_to_double(word: Column, signed: bool = False, scale: float = 1e18) -> Column:
    """A 32-byte hexadecimal word (64 digits, with or without 0x) as number / ``scale``; null if it has another length."""
    digits = F.lower(F.regexp_replace(word, "^0x", ""))
    limb = [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("double") for i in range(8)]
    total = limb[0]
    for x in limb[1:]:
        total = total * F.lit(4294967296.0) + x
    if signed:
        total = F.when(limb[0] >= 2147483648.0, total - F.lit(2.0**256)).otherwise(total)
    return F.when(digits.rlike("^[0-9a-f]{64}$"), total / F.lit(scale))
