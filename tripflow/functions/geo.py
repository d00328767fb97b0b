"""Great-circle geometry on latitude/longitude columns in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in miles.
EARTH_RADIUS_MILES = 3958.7613


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = F.sin(F.radians(lat2 - lat1) / 2)
    half_dlon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = F.pow(half_dlat, 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(half_dlon, 2)
    # rounding can push the term a hair over 1 for antipodal points
    return F.lit(2 * EARTH_RADIUS_MILES) * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def midpoint(a: Column, b: Column) -> Column:
    """Plain average of two coordinates, as used for the trip midpoint."""
    return (a + b) / 2
