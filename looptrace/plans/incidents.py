"""Reports on contamination incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from looptrace.functions.timefn import AsOf, since


def inc_recent_by_kind_severity(
    contamination_incidents: DataFrame, as_of: AsOf, days: int = 30, ordered: bool = True
) -> DataFrame:
    out = (
        contamination_incidents.filter(
            since(contamination_incidents, "detected_at", as_of, days=days)
        )
        .groupBy("kind", "severity")
        .agg(F.count("*").alias(f"incidents_{days}d"))
    )
    return out.orderBy(F.desc(f"incidents_{days}d"), "kind", "severity") if ordered else out


def inc_repeat_instances(
    contamination_incidents: DataFrame, min_n: int = 2, ordered: bool = True
) -> DataFrame:
    out = (
        contamination_incidents.groupBy("instance_id")
        .agg(F.count("*").alias("total_incidents"))
        .filter(F.col("total_incidents") >= min_n)
    )
    return out.orderBy(F.desc("total_incidents"), "instance_id") if ordered else out
