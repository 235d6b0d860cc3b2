"""Reports on movements between places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from looptrace.functions.timefn import AsOf, clock, hours_between
from looptrace.operators.latest import latest, newest


def mov_scan(movements: DataFrame) -> DataFrame:
    return movements.drop("event_date")


def mov_flow_matrix(
    movements: DataFrame, locations: DataFrame, ordered: bool = True
) -> DataFrame:
    """Moves by kind of source and kind of target; unknown places keep a NULL kind."""

    def kinds(role: str) -> DataFrame:
        return locations.select(
            F.col("location_id").alias(f"{role}_loc_id"), F.col("kind").alias(f"{role}_kind")
        )

    out = (
        movements.groupBy("from_loc_id", "to_loc_id")
        .agg(F.count("*").alias("n"))
        .join(kinds("from"), "from_loc_id", "left")
        .join(kinds("to"), "to_loc_id", "left")
        .groupBy("from_kind", "to_kind")
        .agg(F.sum("n").alias("moves"))
    )
    return out.orderBy(F.desc("moves"), "from_kind", "to_kind") if ordered else out


def _place_names(locations: DataFrame) -> DataFrame:
    return locations.select(
        F.col("location_id").alias("to_loc_id"), F.col("name").alias("last_location")
    )


def mov_dwell(movements: DataFrame, locations: DataFrame, ordered: bool = True) -> DataFrame:
    """Hours between an item's last two moves, that is the stay before its last place."""
    moves = movements.select("instance_id", "to_loc_id", "moved_at", "mv_id")
    last, before = F.col("rank") == 1, F.col("rank") == 2
    out = (
        newest(moves, ["instance_id"], ["moved_at", "mv_id"], n=2)
        .groupBy("instance_id")
        .agg(
            F.max(F.when(last, F.col("to_loc_id"))).alias("to_loc_id"),
            F.max(F.when(last, F.col("moved_at"))).alias("moved_at"),
            F.max(F.when(before, F.col("moved_at"))).alias("prev_move"),
        )
        .join(_place_names(locations), "to_loc_id", "left")
        .select(
            "instance_id",
            "last_location",
            hours_between(F.col("prev_move"), F.col("moved_at")).alias("dwell_hours"),
        )
    )
    return out.orderBy(F.desc("dwell_hours"), "instance_id") if ordered else out


def dwell_current(
    movements: DataFrame, locations: DataFrame, as_of: AsOf, ordered: bool = True
) -> DataFrame:
    """Hours from an item's last move to ``as_of``, the stay at its last known place."""
    now = clock(movements, "moved_at", as_of)
    moves = movements.select("instance_id", "to_loc_id", "moved_at", "mv_id")
    out = (
        latest(moves, ["instance_id"], ["moved_at", "mv_id"])
        .join(_place_names(locations), "to_loc_id", "left")
        .select(
            "instance_id",
            "last_location",
            hours_between(F.col("moved_at"), now).alias("dwell_hours"),
        )
    )
    return out.orderBy(F.desc("dwell_hours"), "instance_id") if ordered else out
