"""Event-time streams: windows, sessions, merging, fan-out and state, as plans that run alike on tables and streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Aggregates = Sequence[Column]


def replay(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as a stream, some files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _bounds(df: DataFrame) -> DataFrame:
    others = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("start"), F.col("window.end").alias("finish"), *others)


def tumbling(df: DataFrame, time: str, width: str, by: Sequence[str], aggregates: Aggregates, late: str = "0 seconds") -> DataFrame:
    """Aggregates per half-open window of ``width``; rows later than ``late`` are left out of a stream."""
    return _bounds(df.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(*aggregates))


def sliding(df: DataFrame, time: str, width: str, step: str, by: Sequence[str], aggregates: Aggregates, late: str = "0 seconds") -> DataFrame:
    """Aggregates per window of ``width``, a new one every ``step``."""
    return _bounds(df.withWatermark(time, late).groupBy(F.window(time, width, step), *by).agg(*aggregates))


def sessions(df: DataFrame, time: str, gap: str, by: Sequence[str], aggregates: Aggregates, late: str = "0 seconds") -> DataFrame:
    """Aggregates per session: rows of a key with less than ``gap`` between neighbours."""
    found = df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), *by).agg(*aggregates)
    return _bounds(found)


def distinct_events(df: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """The first row of each key; a stream remembers keys for as long as rows may be late."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def merge(*streams: DataFrame) -> DataFrame:
    """Rows of several streams as they come."""
    first, *rest = streams
    for other in rest:
        first = first.unionByName(other)
    return first


def fan_out(stream: DataFrame, sinks: Sequence[Callable[[DataFrame, int], None]], checkpoint: str):
    """Start a query that hands every batch to several sinks; the batch is kept until all have it."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks:
                sink(held, number)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def gather(df: DataFrame, by: str, value: str, step: Callable[[float, float], float], zero: float) -> DataFrame:
    """(by, state) after each batch: a fold over each key's values of a stream that ends with the state so far."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = state.get[0] if state.exists else zero
        for frame in frames:
            for x in frame[value]:
                s = step(s, float(x))
        state.update((s,))
        yield pd.DataFrame({by: [key[0]], "state": [s]})

    kind = df.select(by).schema[0].dataType.simpleString()
    return df.groupBy(by).applyInPandasWithState(fold, f"{by} {kind}, state double", "s double", "update", "NoTimeout")


def run_to_end(stream: DataFrame, spark: SparkSession, path: str, mode: str = "append") -> DataFrame:
    """What a finite stream comes to, as a table below ``path``, a folder that all share; no row passes the driver.

    With ``append`` the engine's file sink writes each batch once. With ``update`` and ``complete`` each batch is a folder of
    its own, written anew if the batch runs again; an update gives all of them, ``complete`` the last.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{path}/rows").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")
    last = []

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/{number}")
        last.append(number)

    writer.foreachBatch(each).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/batches/{last[-1]}" if mode == "complete" else f"{path}/batches/*")
