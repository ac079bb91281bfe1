"""Column-expression building blocks (all JVM-side, no Python UDFs)."""

from .classify import DEFAULT_TEMP_RULES, classify, temperature_from_tenths
from .geo import arc_degrees, deg2rad, distance_km, rad2deg, valid_coordinate
from .parse import empty_to_null, parse_double, parse_flag, parse_int, parse_token, parse_yyyymmdd
from .timefmt import event_time, render_instant

__all__ = [
    "DEFAULT_TEMP_RULES", "classify", "temperature_from_tenths",
    "arc_degrees", "deg2rad", "distance_km", "rad2deg", "valid_coordinate",
    "empty_to_null", "parse_double", "parse_flag", "parse_int", "parse_token",
    "parse_yyyymmdd", "event_time", "render_instant",
]
