"""Usage counts per tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def usage_counts(events: DataFrame, *, ts: str = "ts", tool: str = "event_type", window: str = "10 minutes",
                 late: str | None = "1 hour") -> DataFrame:
    """Calls per tool and tumbling window.  The same plan runs on a batch or a stream."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    return rows.groupBy(F.window(ts, window), F.col(tool).alias("tool")).agg(F.count("*").alias("calls")).select(
        F.col("window.start").alias("window_start"), "tool", "calls")
