"""Queries beyond the batch inventory: event windows, as a table is the stream's end state."""

from __future__ import annotations

from pyspark.sql import functions as F

from silomesh.runtime import read
from silomesh.streaming import events


def stream_daily_windows(spark, d):
    """Extension: daily windows over events."""
    w = events.windowed(read(spark, d, "events"), streaming=False)
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_approximate_users(spark, d):
    """Extension: approximate distinct users by event type."""
    return read(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("n_users"))


QUERIES = {f.__name__: f for f in (stream_daily_windows, stream_approximate_users)}
SQL = {"stream_daily_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"}
