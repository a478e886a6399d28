"""Streaming forms of the run-log operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def once_a_minute(ticks: DataFrame, key: str = "source", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """At most one tick of a source a minute, in a stream late ones included up to the watermark."""
    ticks = ticks.withColumn("minute", F.date_trunc("minute", ts))
    if not ticks.isStreaming:
        return ticks.dropDuplicates([key, "minute"])
    return ticks.withWatermark("minute", late).dropDuplicatesWithinWatermark([key, "minute"])


def increase(runs: DataFrame, columns: list[str], ts: str = "finished_at", window: str = "30 hours", step: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sums of run counters of each source in sliding windows."""
    return runs.withWatermark(ts, late).groupBy("source", F.window(ts, window, step)).agg(*[F.sum(c).alias(c) for c in columns], F.count("*").alias("runs"))


def counters(events: DataFrame, ts: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by user, type and tumbling window."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), "user_id", "event_type").agg(F.count("*").alias("n"))


def sync_batches(fetched: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A stream of fetched pages, each micro-batch through the batch sync with the purge off.

    A micro-batch is an incomplete enumeration, so absence says nothing there.
    """
    return fetched.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
