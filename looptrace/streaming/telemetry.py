"""Sensor reports as streams, in append mode: a row comes out once its window has closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from looptrace.functions.timefn import since
from looptrace.operators.latest import latest


def _timed(readings: DataFrame, delay: str) -> DataFrame:
    at = F.col("measured_at").cast("timestamp")
    return readings.withColumn("measured_at", at).withWatermark("measured_at", delay)


def st_temp_breaches(
    readings: DataFrame,
    limit_c: float = 35,
    window: str = "24 hours",
    slide: str = "1 hour",
    delay: str = "1 hour",
) -> DataFrame:
    """(window_start, window_end, instance_id, max_temp) where a window goes above the limit.

    Only readings above the limit enter the state, as they alone can be such a maximum.
    A reading that is sent twice counts once.
    """
    hot = readings.filter((F.col("sensor_type") == "temperature") & (F.col("value") > limit_c))
    return (
        _timed(hot.select("reading_id", "instance_id", "value", "measured_at"), delay)
        .dropDuplicatesWithinWatermark(["reading_id"])
        .groupBy(F.window("measured_at", window, slide), "instance_id")
        .agg(F.max("value").alias("max_temp"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "instance_id",
            "max_temp",
        )
    )


def st_latest_reading(
    readings: DataFrame, every: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """The newest reading per item and sensor type of each time window."""
    newest = F.max_by(
        F.struct("reading_id", "value", "measured_at"), F.struct("measured_at", "reading_id")
    )
    columns = ["reading_id", "instance_id", "sensor_type", "value", "measured_at"]
    timed = _timed(readings.select(columns), delay)
    windows = timed.groupBy(F.window("measured_at", every), "instance_id", "sensor_type")
    return windows.agg(newest.alias("last")).select("instance_id", "sensor_type", "last.*")


def latest_running(feed: DataFrame, readings: DataFrame, every: str = "1 hour") -> DataFrame:
    """The newest reading per item and sensor type up to now, open windows included.

    What ``st_latest_reading`` wrote stands for all windows up to its last one; only the
    readings after that are read from the log itself, by day where the log has days.
    """
    closed = feed.agg(F.max(F.window("measured_at", every).end).alias("end")).first().end
    recent = readings
    if closed is not None:
        recent = readings.filter(since(readings, "measured_at", closed))
    columns = ["reading_id", "instance_id", "sensor_type", "value", "measured_at"]
    at = F.col("measured_at").cast("timestamp")
    return latest_of_feed(
        feed.select(columns).unionByName(recent.withColumn("measured_at", at).select(columns))
    )


def latest_of_feed(feed: DataFrame) -> DataFrame:
    """The newest reading per item and sensor type of the rows ``st_latest_reading`` wrote."""
    out = latest(feed, ["instance_id", "sensor_type"], ["measured_at", "reading_id"])
    return out.select("instance_id", "sensor_type", "value", "measured_at")
