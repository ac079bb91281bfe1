"""Great-circle distance as a column expression (runs inside codegen)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the distance formula's unit conversion -------------------
# arc degrees -> nautical-ish miles -> statute miles -> km
MINUTES_PER_DEGREE = 60.0
MILES_PER_NAUTICAL_MILE = 1.1515
KM_PER_MILE = 1.609344
# --- end of fixed values ----------------------------------------------------

# km per degree of arc, for bounds (the formula itself multiplies in order)
KM_PER_DEGREE = MINUTES_PER_DEGREE * MILES_PER_NAUTICAL_MILE * KM_PER_MILE


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def deg2rad(c) -> Column:
    return _c(c) * F.lit(math.pi) / F.lit(180.0)


def rad2deg(c) -> Column:
    return _c(c) * F.lit(180.0) / F.lit(math.pi)


def arc_from_cosine(cos_d) -> Column:
    """Angle in degrees of a cosine, clamped to [-1, 1]."""
    return rad2deg(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), _c(cos_d)))))


def arc_degrees(lat1, lon1, lat2, lon2) -> Column:
    """Central angle in degrees by the spherical law of cosines.

    The cosine is clamped to [-1, 1] so coincident points give 0 instead of
    NaN.  Callers drop NaN coordinates first (clamping would turn NaN into 1).
    """
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    theta = lon1 - lon2
    cos_d = (
        F.sin(deg2rad(lat1)) * F.sin(deg2rad(lat2))
        + F.cos(deg2rad(lat1)) * F.cos(deg2rad(lat2)) * F.cos(deg2rad(theta))
    )
    return arc_from_cosine(cos_d)


def _km(arc: Column) -> Column:
    return arc * F.lit(MINUTES_PER_DEGREE) * F.lit(MILES_PER_NAUTICAL_MILE) * F.lit(KM_PER_MILE)


def distance_km(lat1, lon1, lat2, lon2) -> Column:
    """Distance in km between two coordinate pairs (degrees)."""
    return _km(arc_degrees(lat1, lon1, lat2, lon2))


def km_from_cosine(cos_d) -> Column:
    """Distance in km whose central angle has the given cosine."""
    return _km(arc_from_cosine(cos_d))


def valid_coordinate(lat, lon) -> Column:
    """Both present and numeric (NaN is treated as missing)."""
    lat, lon = _c(lat), _c(lon)
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
