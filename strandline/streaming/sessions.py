"""Structured Streaming forms of two timeline operators (an extension: the batch operators are the core).

Both are incremental and bounded by a watermark: intervals later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_stream(events: DataFrame, gap: str = "1 second", late: str = "10 minutes", key: str = "source_id") -> DataFrame:
    """Repeated equal texts of a source within ``gap`` become one session: the streaming form of cue merging."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), key, "text")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(key, "text", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def window_counts(events: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str = "10 minutes", key: str = "source_id") -> DataFrame:
    """Counts and value sums per (overlapping) window."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        events.withWatermark("ts", late)
        .groupBy(w.alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")
    )
