"""Streaming forms, which go beyond the batch operators: windows over events and value counts that follow a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from silomesh.operators.value_counts import ValueCountTable, value_deltas


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 hour", streaming: bool = True) -> DataFrame:
    """Events and their value by window and type; a stream drops events later than the watermark.

    The same expression runs on a table, where nothing is late.
    """
    held = events.withWatermark("ts", late) if streaming else events
    by = held.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user that end after a gap without events."""
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return by.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def follow_counts(stream: DataFrame, table: ValueCountTable, groups: list[str], value: str, checkpoint: str) -> StreamingQuery:
    """Apply each micro-batch of a stream to a value-count table as signed deltas."""

    def apply(batch: DataFrame, _: int) -> None:
        table.apply(value_deltas(batch, groups, F.col(value)))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
