"""Windowed counts and sessions over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmaq.streaming import event_time


def tumbling_counts(events: DataFrame, ts: str, size: str, keys: list[str],
                    delay: str = "1 day") -> DataFrame:
    """Events per time window and keys (partial counts before the shuffle).

    A window is emitted, and its state dropped, once the watermark has closed it.
    """
    return (event_time(events.select(ts, *keys), ts, delay)
            .groupBy(F.window(ts, size), *keys).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                    *keys, "n"))


def stream_sessions(events: DataFrame, user: str, ts: str, idle_minutes: int,
                    delay: str = "1 hour") -> DataFrame:
    """Closed sessions, emitted once the watermark has passed their end.

    A session is one row of state that merges as events come in.
    """
    session = F.session_window(ts, f"{idle_minutes} minutes")
    return (event_time(events.select(user, ts), ts, delay)
            .groupBy(user, session).agg(F.count(F.lit(1)).alias("requests"))
            .select(user, F.col("session_window.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("session_window.end").cast("timestamp_ntz").alias("session_end"),
                    "requests"))
