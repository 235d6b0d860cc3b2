"""Reports on wash cycles and inspections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from looptrace.functions.numfn import mean, ratio, whole_mean
from looptrace.functions.timefn import minutes_between
from looptrace.operators.latest import latest


def wsh_cycle_stats(wash_cycles: DataFrame) -> DataFrame:
    """Open cycles count, but have no duration."""
    return wash_cycles.agg(
        F.count("*").alias("cycles"),
        whole_mean(minutes_between(F.col("start_time"), F.col("end_time"))).alias("avg_minutes"),
        mean(F.col("temp_c")).alias("avg_temp_c"),
    )


def wsh_pass_rate_by_hub(
    inspections: DataFrame,
    wash_cycles: DataFrame,
    hubs: DataFrame,
    locations: DataFrame,
    ordered: bool = True,
) -> DataFrame:
    """Inspections without a known wash or hub share the NULL group."""
    names = hubs.join(locations, "location_id").select("hub_id", F.col("name").alias("hub_name"))
    passed = F.count_if(F.col("result") == "pass")
    out = (
        inspections.groupBy("wash_id")
        .agg(F.count("*").alias("n"), passed.alias("ok"))
        .join(wash_cycles.select("wash_id", "hub_id"), "wash_id", "left")
        .groupBy("hub_id")
        .agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
        .join(names, "hub_id", "left")
        .groupBy("hub_name")
        .agg(ratio(F.sum("ok"), F.sum("n")).alias("pass_rate"))
    )
    return out.orderBy(F.desc("pass_rate"), "hub_name") if ordered else out


def latest_inspections(inspections: DataFrame) -> DataFrame:
    return latest(inspections, ["instance_id"], ["inspected_at", "inspection_id"])


def wsh_latest_failures(inspections: DataFrame, ordered: bool = True) -> DataFrame:
    """Items whose newest inspection failed."""
    out = (
        latest_inspections(inspections)
        .filter(F.col("result") == "fail")
        .select("instance_id", "result", "inspected_at", "notes")
    )
    return out.orderBy(F.desc("inspected_at"), "instance_id") if ordered else out
