"""Time windows over streams and batches: the same functions serve both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str = "30 seconds", ts: str = "ts", late: str | None = None) -> DataFrame:
    df = events.withWatermark(ts, late) if late else events
    return df.groupBy(F.window(ts, size)).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def sliding(events: DataFrame, size: str, step: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    df = events.withWatermark(ts, late) if late else events
    return df.groupBy(F.window(ts, size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, key: str, gap: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    """Sessions by key that a longer gap ends; the last event's time plus the gap is not part of `last`."""
    df = events.withWatermark(ts, late) if late else events
    out = df.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"), F.max(ts).alias("last"))
    return out.select(key, F.col("session_window.start").alias("start"), "last", "n")
