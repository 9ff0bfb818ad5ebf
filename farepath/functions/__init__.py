"""Column expressions: native Spark functions only, so every one of them
stays inside whole-stage code generation."""

from farepath.functions.formatting import delimited_line, fixed_decimals, money
from farepath.functions.geo import EARTH_RADIUS_KM, haversine_km
from farepath.functions.predicates import all_finite, all_nonzero
from farepath.functions.time import (
    duration_minutes,
    hour_from_text,
    hour_of_day,
    in_hour_window,
    parse_timestamp,
)

__all__ = [
    "EARTH_RADIUS_KM",
    "all_finite",
    "all_nonzero",
    "delimited_line",
    "duration_minutes",
    "fixed_decimals",
    "haversine_km",
    "hour_from_text",
    "hour_of_day",
    "in_hour_window",
    "money",
    "parse_timestamp",
]
