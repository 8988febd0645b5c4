"""WGS84 positions and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres on a sphere."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (
        half_lon * half_lon
    )
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(chord))


def within_degrees(lat: Column, lon: Column) -> Column:
    """Both values inside WGS84. NaN sorts above every number, so it fails."""
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def valid_coordinates(lat: Column, lon: Column) -> Column:
    """Either no position at all, or a complete one inside WGS84."""
    return (lat.isNull() & lon.isNull()) | F.coalesce(within_degrees(lat, lon), F.lit(False))


def usable_position(lat: Column, lon: Column) -> Column:
    """A complete position that is not the (0, 0) placeholder."""
    return lat.isNotNull() & lon.isNotNull() & ~((lat == 0.0) & (lon == 0.0))
