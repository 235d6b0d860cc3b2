"""Reports on sensor readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from looptrace.functions.numfn import mean
from looptrace.functions.timefn import AsOf, since
from looptrace.operators.latest import latest
from looptrace.schemas import SENSOR_TYPES


def sen_latest_reading(sensor_readings: DataFrame, ordered: bool = True) -> DataFrame:
    """Newest reading per item and sensor type; readings without an item form one group."""
    out = latest(sensor_readings, ["instance_id", "sensor_type"], ["measured_at", "reading_id"])
    out = out.select("instance_id", "sensor_type", "value", "measured_at")
    return out.orderBy("instance_id", "sensor_type") if ordered else out


def hot_readings(
    sensor_readings: DataFrame, as_of: AsOf, hours: int = 24, limit_c: float = 35
) -> DataFrame:
    """Temperature readings above the limit; the maximum over these is the maximum over all."""
    return sensor_readings.filter(
        (F.col("sensor_type") == "temperature")
        & since(sensor_readings, "measured_at", as_of, hours=hours)
        & (F.col("value") > limit_c)
    )


def sen_temp_breaches(
    sensor_readings: DataFrame,
    as_of: AsOf,
    hours: int = 24,
    limit_c: float = 35,
    ordered: bool = True,
) -> DataFrame:
    peak = f"max_temp_{hours}h"
    out = (
        hot_readings(sensor_readings, as_of, hours, limit_c)
        .groupBy("instance_id")
        .agg(F.max("value").alias(peak))
    )
    return out.orderBy(F.desc(peak), "instance_id") if ordered else out


def sen_daily_pivot(
    sensor_readings: DataFrame, as_of: AsOf, days: int = 3, ordered: bool = True
) -> DataFrame:
    """Daily mean per sensor type, one column per type."""
    out = (
        sensor_readings.filter(since(sensor_readings, "measured_at", as_of, days=days))
        .groupBy(F.to_date("measured_at").alias("date"))
        .pivot("sensor_type", list(SENSOR_TYPES))
        .agg(mean(F.col("value")))
    )
    return out.orderBy("date") if ordered else out
