"""Which items may have been contaminated: by an incident, or by sharing a place with such an item.

An item stays at a place from one movement to its next.  From its first grave incident on, an item
exposes all that are at its place while it is there, or come before it leaves; those carry on to the
places they go to next, and so forth.  What counts is the order of time: nobody is exposed by a stay
that ended before.

Stays of a place are never paired.  A stay that begins while some exposing stay is open is exposed at
once: a running maximum of the ends tells.  Else the next exposing stay that begins before it ends
exposes it: a minimum over the starts behind it tells.  Both are scans over slices, so a place may
hold any share of all rows.  Rounds go on until no item is exposed earlier than before: as many as the
longest chain of places has links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from looptrace.functions.timefn import AsOf
from looptrace.operators.slices import previous, scanned, sliced
from looptrace.session import stored


def stays(movements: DataFrame, as_of: AsOf, slices: int | None = None) -> DataFrame:
    """(instance_id, place, came, left): where items were, up to ``as_of``; an unknown place is none."""
    now = F.lit(str(as_of)).cast("timestamp")
    moves = movements.select(
        "instance_id", F.col("to_loc_id").alias("place"), F.col("moved_at").cast("timestamp").alias("came"),
        (-F.unix_micros(F.col("moved_at").cast("timestamp"))).alias("_back"),
        F.bitwise_not("mv_id").alias("_down"),
    ).filter(F.col("came") <= now)
    following = previous(moves, "instance_id", ["_back", "_down"], ["came"], slices)
    return following.filter("place IS NOT NULL").select(
        "instance_id", "place", "came", F.coalesce("prev.came", now).alias("left")
    )


def _round(visits: DataFrame, exposed: DataFrame, slices: int | None) -> DataFrame:
    """(instance_id, at): when the exposed items' stays expose others, and themselves, at the earliest."""
    spreading = visits.join(exposed, "instance_id").filter(F.col("left") >= F.col("exposed_at"))
    starts = spreading.select(
        "place",
        F.greatest("came", "exposed_at").alias("at"),
        F.lit(0).alias("step"),  # before those that come at the same instant
        F.col("left").alias("open_until"),
        F.lit(None).cast("timestamp").alias("left"),
        F.lit(None).cast("bigint").alias("instance_id"),
    )
    met = visits.select(
        "place",
        F.col("came").alias("at"),
        F.lit(1).alias("step"),
        F.lit(None).cast("timestamp").alias("open_until"),
        "left",
        "instance_id",
    )
    order = ["at", "step"]
    cut = sliced(starts.unionByName(met), "place", order, slices)
    found = scanned(cut, "place", order, open_until_before=("max", F.col("open_until")))
    starting = F.when(F.col("step") == 0, F.col("at"))
    found = scanned(found, "place", order, after=True, next_start=("min", starting))
    when = F.when(F.col("open_until_before") >= F.col("at"), F.col("at")).when(
        F.col("next_start") <= F.col("left"), F.col("next_start")
    )
    return found.filter("step = 1").groupBy("instance_id").agg(F.min(when).alias("at"))


def exposed_items(
    movements: DataFrame,
    contamination_incidents: DataFrame,
    as_of: AsOf,
    min_severity: int = 4,
    slices: int | None = None,
) -> DataFrame:
    """(instance_id, exposed_at, incident): items exposed up to ``as_of``, when first, and whether by an
    incident of their own."""
    now = F.lit(str(as_of)).cast("timestamp")
    at = F.col("detected_at").cast("timestamp")
    own = (
        contamination_incidents.filter((F.col("severity") >= min_severity) & (at <= now))
        .groupBy("instance_id")
        .agg(F.min(at).alias("reported_at"))
        .filter("instance_id IS NOT NULL")
    )
    own = stored(own, "incidents")
    visits = stored(stays(movements.filter("instance_id IS NOT NULL"), as_of, slices), "stays")
    exposed = own.withColumnRenamed("reported_at", "exposed_at")
    while True:
        reached = _round(visits, exposed, slices).filter("at IS NOT NULL")
        both = exposed.join(reached, "instance_id", "full").select(
            "instance_id",
            F.least("exposed_at", "at").alias("exposed_at"),
            F.coalesce(F.col("at") < F.col("exposed_at"), F.col("exposed_at").isNull()).alias("earlier"),
        )
        both = stored(both, "exposed")
        exposed = both.drop("earlier")
        if both.filter("earlier").isEmpty():
            break
    return exposed.join(own, "instance_id", "left").select(
        "instance_id",
        "exposed_at",
        F.coalesce(F.col("reported_at") <= F.col("exposed_at"), F.lit(False)).alias("incident"),
    )
