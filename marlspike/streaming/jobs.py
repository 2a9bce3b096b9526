"""Streams over landed files: deduplication, windows, per-wallet state.

A checkpoint folder holds offsets and state together, so a restarted job goes on
where it stopped with the state it had. Each job's sink is idempotent per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlspike.session import shared_dir


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet file or folder as a stream with the schema of what is there now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # as a pattern, so that a single file may stand where a folder is expected
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, label: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that has landed, then read its sink.

    ``append`` writes files with the exactly-once file sink; ``complete`` and
    ``update`` write each batch to a folder of its own, which a repeated batch
    overwrites (complete: the last batch is the result). With a ``checkpoint``
    folder of the caller's the sink lies in it, and a restarted job goes on with
    both.
    """
    spark = stream.sparkSession
    place = checkpoint or shared_dir(spark, f"{label}-state")
    out = f"{checkpoint}/sink" if checkpoint else shared_dir(spark, label)
    writer = stream.writeStream.option("checkpointLocation", place).trigger(availableNow=True)
    if mode == "append":
        writer.outputMode("append").format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    seen: list[int] = []

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        seen.append(batch_id)

    writer.outputMode(mode).foreachBatch(keep).start().awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    wanted = [f"{out}/batch={seen[-1]}"] if mode == "complete" else [f"{out}/batch={b}" for b in seen]
    return spark.read.schema(stream.schema).parquet(*wanted)


def first_by_key(stream: DataFrame, key: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """One row per key: for ever without ``time``, else within the watermark ``delay`` (later repeats pass, late rows are dropped)."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, time: str, width: str, keys: list[str], delay: str | None = None) -> DataFrame:
    """Count and exact sum of ``amount`` per tumbling window and keys; with ``delay`` windows close and leave the state."""
    if delay:
        stream = stream.withWatermark(time, delay)
    return stream.groupBy(F.window(time, width)["start"].alias("start"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("amount").cast("decimal(38,8)")).cast("double").alias("volume")
    )


def changed_by(stream: DataFrame, key: str, order: list[str], value: str, least: float, idle: str | None = None) -> DataFrame:
    """(key, order..., value): the first value of a key, then each that differs by ``least`` from the last one emitted.

    Rows of a batch are taken in ``order``; rows of an earlier batch never come
    back. State is one number per key; with ``idle`` (e.g. '30 days') a key's
    state expires after that much processing time without rows.
    """
    columns = [key, *order, value]
    fields = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = ", ".join(f"`{c}` {fields[c]}" for c in columns)

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(order)
        last = state.get[0] if state.exists else None
        keep = []
        for v in rows[value].to_numpy(float):
            emit = last is None or abs(v - last) >= least
            keep.append(emit)
            last = float(v) if emit else last
        state.update((last,))
        if idle:
            state.setTimeoutDuration(idle)
        yield rows.loc[keep, columns]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return stream.select(*columns).groupBy(key).applyInPandasWithState(step, out, "last double", "append", timeout)


def in_sequence(stream: DataFrame, key: str, number: str, payload: str, hold: int = 1000) -> DataFrame:
    """(key, number, payload): rows of a key in order of consecutive numbers, gaps waited for.

    A row comes out when all numbers from the key's first one on have; at most
    ``hold`` rows wait per key, then the lowest go on past the gap. Numbers that
    were already emitted, and repeats, are ignored. Keys are feeds, so state is
    at most ``hold`` rows per feed.
    """
    fields = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = f"`{key}` {fields[key]}, `{number}` bigint, `{payload}` string"

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, numbers, texts = state.get if state.exists else (None, [], [])
        waiting = dict(zip(numbers, texts))
        for frame in frames:
            for n, t in zip(frame[number], frame[payload]):
                if following is None or n >= following:
                    waiting.setdefault(int(n), t)
        if following is None and waiting:
            following = min(waiting)
        ready = []
        while waiting and (following in waiting or len(waiting) > hold):
            n = following if following in waiting else min(waiting)
            ready.append((name[0], n, waiting.pop(n)))
            following = n + 1
        state.update((following, list(waiting), list(waiting.values())))
        if ready:
            yield pd.DataFrame(ready, columns=[key, number, payload])

    shape = "following bigint, numbers array<bigint>, texts array<string>"
    return stream.select(key, F.col(number).cast("long").alias(number), payload).groupBy(key).applyInPandasWithState(
        step, out, shape, "append", GroupStateTimeout.NoTimeout
    )
