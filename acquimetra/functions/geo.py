"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def near_box(lat: Column, lon: Column, lat0: float, lon0: float, km: float) -> Column:
    """A cheap test that every point within ``km`` passes, for the scan to push down."""
    import math

    d = math.degrees(km / EARTH_KM)
    w = d / max(0.01, math.cos(math.radians(min(89.0, abs(lat0) + d))))
    return in_box(lat, lon, lat0 - d, lon0 - w, lat0 + d, lon0 + w)
