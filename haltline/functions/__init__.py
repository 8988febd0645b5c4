"""Column expressions used by every operator. No Python runs on executors here."""

from haltline.functions.dates import compact_date, gtfs_date, iso_date, iso_to_date, service_weekday
from haltline.functions.geo import (
    haversine_m,
    usable_position,
    valid_coordinates,
    within_degrees,
)
from haltline.functions.text import (
    empty_to_null,
    fold_text,
    normalize_name,
    search_terms,
    strict_double,
    strict_long,
)
from haltline.functions.times import day_offset, gtfs_seconds, gtfs_time_text

__all__ = [
    "compact_date",
    "day_offset",
    "empty_to_null",
    "fold_text",
    "gtfs_date",
    "gtfs_seconds",
    "gtfs_time_text",
    "haversine_m",
    "iso_date",
    "iso_to_date",
    "normalize_name",
    "search_terms",
    "service_weekday",
    "strict_double",
    "strict_long",
    "usable_position",
    "valid_coordinates",
    "within_degrees",
]
