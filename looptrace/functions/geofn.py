"""Great-circle distance from latitude and longitude in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0  # fixed value: radius all distances use


def _radians(degrees: Column) -> Column:
    return F.radians(degrees.cast("double"))


def arc_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Spherical law of cosines; the cosine is clamped, as rounding can pass 1."""
    a, b = _radians(lat1), _radians(lat2)
    turn = F.cos(_radians(lng2.cast("double") - lng1.cast("double")))
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * turn
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))) * EARTH_KM


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Same arc, well conditioned for near points."""
    a, b = _radians(lat1), _radians(lat2)
    half_lng = _radians(lng2.cast("double") - lng1.cast("double")) / 2
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(half_lng), 2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * 2 * EARTH_KM


def sphere_xyz(lat: Column, lng: Column) -> list[Column]:
    """Point on the sphere in km; straight-line distance never exceeds the arc."""
    a, b = _radians(lat), _radians(lng)
    return [F.cos(a) * F.cos(b) * EARTH_KM, F.cos(a) * F.sin(b) * EARTH_KM, F.sin(a) * EARTH_KM]
