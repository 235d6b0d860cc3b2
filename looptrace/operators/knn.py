"""The k nearest places for each of many points, within a distance, exactly.

Points and places are put into space.  The places are counted in cubes at several levels, each
four times as fine as the one above.  A point starts with the occupied cubes around it and
goes down: at each level the counts tell how far its k-th place can be at most, cubes whose
nearest corner lies beyond that are left out, and only the others are split.  At the first
level at which no cube holds more than k places, those in the cubes that are left are compared
themselves.  So the work per point follows k, wherever the places lie: beside a dense cluster
only its near edge is opened.

Before that, equal coordinates are folded: points with one position share an answer, and of
the places at one position only the k lowest ids can be in any answer.  Space cubes have no
trouble with poles or the date line.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from looptrace.functions.geofn import EARTH_KM, sphere_xyz
from looptrace.session import stored

FINEST_KM = 0.002
FINER = 4  # times, from level to level
TIE_KM = 1e-6  # distances are ranked to the millimetre
AXES = ["x", "y", "z"]
CUBE = ["cx", "cy", "cz"]
SPOT = ["lat", "lng"]


def _in_space(df: DataFrame) -> DataFrame:
    """``df`` + (x, y, z) in km; rows without a position are left out."""
    df = df.filter("lat IS NOT NULL AND lng IS NOT NULL")
    return df.withColumns(dict(zip(AXES, sphere_xyz(F.col("lat"), F.col("lng")))))


def _finest(max_km: float) -> int:
    return max(1, math.ceil(math.log(max_km / FINEST_KM, FINER)))


def _cube(level: int, max_km: float) -> list[Column]:
    """(cx, cy, cz): the cube of a level that holds the position; those of the first are max_km wide."""
    return [F.floor(F.col(a) * (FINER**level / max_km)).alias(c) for c, a in zip(CUBE, AXES)]


def _around(df: DataFrame) -> DataFrame:
    """A row for each of the 27 cubes around and including (cx, cy, cz)."""
    for axis in CUBE:
        df = df.withColumn(axis, F.explode(F.sequence(F.col(axis) - 1, F.col(axis) + 1)))
    return df


def _counts(sites: DataFrame, max_km: float) -> DataFrame:
    """(level, cx, cy, cz, n) of the occupied cubes of all levels."""
    levels = range(_finest(max_km) + 1)
    each = F.explode(F.array(*(
        F.struct(F.lit(i).alias("level"), *_cube(i, max_km)) for i in levels
    )))
    held = sites.select(each.alias("at")).groupBy("at").agg(F.count("*").alias("n"))
    return stored(held.select("at.*", "n"), "cubes")


def _deepest(counts: DataFrame, k: int) -> int:
    """The first level at which no cube holds more than k places, or the last one: a finer one would
    tell nothing more."""
    most = counts.groupBy("level").agg(F.max("n").alias("n")).collect()  # a row per level
    crowded = [r.level for r in most if r.n > k]
    return min(max(crowded, default=-1) + 1, max((r.level for r in most), default=0))


def _length(parts: list[Column]) -> Column:
    return F.sqrt(sum(p * p for p in parts))


def _within_reach(pairs: DataFrame, size: float, k: int, max_km: float) -> DataFrame:
    """Of (spot, cube, n, and the reach that the level above left) the cubes that may hold one of the
    spot's k nearest places."""
    low = {a: F.col(c) * size for a, c in zip(AXES, CUBE)}
    apart = [F.greatest(low[a] - F.col(a), F.col(a) - low[a] - size, F.lit(0.0)) for a in AXES]
    across = [F.greatest(F.abs(F.col(a) - low[a]), F.abs(low[a] + size - F.col(a))) for a in AXES]
    measured = pairs.withColumn("near", _length(apart)).withColumn("far", _length(across))
    by = Window.partitionBy(*SPOT)
    upto = by.orderBy("far", *CUBE).rowsBetween(Window.unboundedPreceding, 0)
    return (
        measured.filter(F.col("near") <= F.col("reach"))  # before anything is sorted
        .withColumn("places", F.sum("n").over(upto))
        .withColumn("reach", F.min(F.when(F.col("places") >= k, F.col("far"))).over(by))
        .withColumn("reach", F.least("reach", F.lit(max_km)) + 2 * TIE_KM)
        .filter("near <= reach")
        .select(*SPOT, *AXES, *CUBE, "reach")
    )


def candidates(spots: DataFrame, sites: DataFrame, k: int, max_km: float) -> DataFrame:
    """(lat, lng, location_id, straight_km): the pairs that are compared, a few times k per spot."""
    counts = _counts(sites, max_km)
    last = _deepest(counts, k)
    pairs = _around(spots.select(*SPOT, *AXES, *_cube(0, max_km)))
    pairs = pairs.withColumn("reach", F.lit(max_km + 2 * TIE_KM))
    for level in range(last + 1):
        held = counts.filter(F.col("level") == level).drop("level")
        if level:  # from the cubes kept to their parts
            held = held.select(
                *CUBE, "n", *(F.floor(F.col(c) / FINER).alias(f"in_{c}") for c in CUBE)
            )
            above = pairs.select(*SPOT, *AXES, "reach", *(F.col(c).alias(f"in_{c}") for c in CUBE))
            pairs = above.join(held, [f"in_{c}" for c in CUBE])
        else:
            pairs = pairs.join(held, CUBE)
        pairs = _within_reach(pairs, max_km / FINER**level, k, max_km)
    targets = sites.select(
        "location_id",
        *_cube(last, max_km),
        *(F.col(a).alias(f"to_{a}") for a in AXES),
    )
    straight = _length([F.col(f"to_{a}") - F.col(a) for a in AXES])
    return (
        pairs.join(targets, CUBE)
        .select(*SPOT, "location_id", straight.alias("straight_km"), "reach")
        .filter("straight_km <= reach")
        .drop("reach")
    )


def _arc(straight_km: Column) -> Column:
    return F.asin(F.least(F.lit(1.0), straight_km / (2 * EARTH_KM))) * (2 * EARTH_KM)


def knn_places(points: DataFrame, places: DataFrame, k: int, max_km: float) -> DataFrame:
    """(point_id, location_id, distance_km, rank) for points (point_id, lat, lng) and places.

    Equal distances, to the millimetre, go by the lower ``location_id``.
    """
    same_spot = Window.partitionBy(*SPOT).orderBy("location_id")
    sites = (
        _in_space(places.select("location_id", *SPOT))
        .withColumn("nth", F.row_number().over(same_spot))
        .filter(F.col("nth") <= k)
        .drop("nth")
    )
    spots = _in_space(points.select(*SPOT).distinct())
    near = (
        candidates(spots, sites, k, max_km)
        .withColumn("distance_km", _arc(F.col("straight_km")))
        .filter(F.col("distance_km") <= max_km)
    )
    by = Window.partitionBy(*SPOT).orderBy(F.round("distance_km", 6), "location_id")
    best = near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return points.join(best, SPOT).select(
        "point_id", "location_id", F.round("distance_km", 6).alias("distance_km"), "rank"
    )
