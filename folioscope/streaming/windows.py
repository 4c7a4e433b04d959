"""Event-time windows; the same functions take a batch table or a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Only streams need it: state of windows older than ``late`` is let go. Watermarks take timestamps with a zone only."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def daily(events: DataFrame) -> DataFrame:
    """(day, event_type, n, total) of tumbling days."""
    w = watermarked(events).groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    rows = w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").cast("date").alias("day"), "event_type", "n", "total")


def weekly_sliding(events: DataFrame) -> DataFrame:
    """(start_day, event_type, n) of seven-day windows that start each day."""
    rows = watermarked(events).groupBy(F.window("ts", "7 days", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").cast("date").alias("start_day"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start_us, n): a user's events with less than ``gap`` between them."""
    rows = watermarked(events).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "n")


def first_seen(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key's first event; a stream forgets keys older than the watermark."""
    if events.isStreaming:
        return watermarked(events, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def settled(changes: DataFrame, quiet: str = "300 seconds", after_withdrawal: str = "60 seconds") -> DataFrame:
    """(site_id, due_us, n, withdrawn): bursts of edits (site_id, ts, withdrawn) and when a refresh is due, once no edit has come for ``quiet``.

    An edit that withdraws something waits for less.
    """
    gap = F.when(F.col("withdrawn"), F.lit(after_withdrawal)).otherwise(F.lit(quiet))
    rows = watermarked(changes).groupBy("site_id", F.session_window("ts", gap).alias("w"))
    burst = rows.agg(F.count(F.lit(1)).alias("n"), F.max("withdrawn").alias("withdrawn"))
    return burst.select("site_id", F.unix_micros(F.col("w.end").cast("timestamp")).alias("due_us"), "n", "withdrawn")
