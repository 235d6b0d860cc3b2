"""Reports on places: retailers, washing hubs and drop boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from looptrace.functions.geofn import arc_km


def loc_counts_by_kind(locations: DataFrame, ordered: bool = True) -> DataFrame:
    out = locations.groupBy("kind").agg(F.count("*").alias("total"))
    return out.orderBy(F.desc("total"), "kind") if ordered else out


def loc_retailer_directory(
    retailers: DataFrame, locations: DataFrame, ordered: bool = True
) -> DataFrame:
    out = retailers.join(locations, "location_id").select(
        "retailer_id", F.col("name").alias("retailer_name"), "address", "lat", "lng"
    )
    return out.orderBy("retailer_id") if ordered else out


def loc_hub_directory(hubs: DataFrame, locations: DataFrame, ordered: bool = True) -> DataFrame:
    out = hubs.join(locations, "location_id").select(
        "hub_id", F.col("name").alias("hub_name"), "washer_model", "address"
    )
    return out.orderBy("hub_id") if ordered else out


def loc_nearby_bbox(
    locations: DataFrame,
    lat: float,
    lng: float,
    dlat: float = 0.05,
    dlng: float = 0.06,
    ordered: bool = True,
) -> DataFrame:
    """Places in a box of degrees around a point, borders included."""

    def within(column: str, centre: float, reach: float):
        low, high = (F.lit(f"{centre + s * reach:.6f}").cast("decimal(9,6)") for s in (-1, 1))
        return F.col(column).between(low, high)

    out = locations.filter(within("lat", lat, dlat) & within("lng", lng, dlng)).select(
        "location_id", "name", "kind", "lat", "lng"
    )
    return out.orderBy("name") if ordered else out


def loc_nearest_places(
    locations: DataFrame,
    retailers: DataFrame,
    lat: float,
    lng: float,
    k: int = 10,
    max_km: float | None = None,
) -> DataFrame:
    """The ``k`` retailers nearest to a point; ``max_km`` bounds the distance when given."""
    near = (
        locations.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
        .join(retailers.select("location_id"), "location_id")
        .select(
            "location_id",
            "name",
            "address",
            arc_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")).alias("distance_km"),
        )
    )
    if max_km is not None:
        near = near.filter(F.col("distance_km") <= max_km)
    return (
        near.orderBy("distance_km", "location_id")
        .limit(k)
        .withColumn("distance_km", F.round("distance_km", 3))
    )
