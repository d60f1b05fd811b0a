"""Continuous forms of the batch metrics. An extension: with availableNow they end with the batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(window, event_type, n) in tumbling hours of events (ts, event_type)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))


def failures(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(window, ip, n) of failures in windows of 15 minutes that slide by 5."""
    return events.where("event_type = 'login_failure'").withWatermark("ts", late).groupBy(F.window("ts", "15 minutes", "5 minutes"), "ip").agg(F.count("*").alias("n"))


def conversations(events: DataFrame, idle: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of runs of events with no gap of an hour."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", idle).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without repeats of their id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
