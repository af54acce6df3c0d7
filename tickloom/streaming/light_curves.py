"""Light curves, sessions and dead time of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_light_curve(events: DataFrame, time: str, bin_size: str, late: str, *keys: str) -> DataFrame:
    """Counts in tumbling windows; events later than the watermark are dropped: keys, start, stop, counts."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, bin_size), *keys).agg(F.count(F.lit(1)).alias("counts"))
    return rows.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "counts")


def streaming_intervals(events: DataFrame, time: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Good intervals as sessions: runs of events less than a gap apart: keys, start, stop, counts."""
    # Streams can't aggregate sessions without a key beside them, and a literal would be optimised away.
    rows = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *(keys or [F.pmod(F.hash(time), F.lit(1)).alias("__k")])).agg(F.count(F.lit(1)).alias("counts"))
    return rows.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "counts")
