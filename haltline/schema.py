"""Fixed column lists: GTFS files as published and the tables we keep."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame

SCHEMA_VERSION = 1

REQUIRED_FILES = ("agency", "routes", "stops", "stop_times", "trips")
OPTIONAL_FILES = ("calendar", "calendar_dates", "shapes", "transfers", "feed_info")

# GTFS columns by file. Kinds: text, byte (0-255), short (0-65535),
# int (0-4294967295), double, date, time. "!" marks a column that must be in the header,
# "?" a value that may be empty.
GTFS_COLUMNS: dict[str, dict[str, str]] = {
    "agency": {
        "agency_id": "text",
        "agency_name": "text!",
        "agency_url": "text!",
        "agency_timezone": "text!",
    },
    "stops": {
        "stop_id": "text!",
        "stop_code": "text",
        "stop_name": "text",
        "stop_lat": "double?",
        "stop_lon": "double?",
        "location_type": "byte?",
        "parent_station": "text",
        "platform_code": "text",
    },
    "routes": {
        "route_id": "text!",
        "agency_id": "text",
        "route_short_name": "text",
        "route_long_name": "text",
        "route_type": "short!",
        "route_color": "text",
        "route_text_color": "text",
    },
    "trips": {
        "route_id": "text!",
        "service_id": "text!",
        "trip_id": "text!",
        "trip_headsign": "text",
        "trip_short_name": "text",
        "direction_id": "byte?",
        "shape_id": "text",
    },
    "stop_times": {
        "trip_id": "text!",
        "arrival_time": "time?",
        "departure_time": "time?",
        "stop_id": "text!",
        "stop_sequence": "int!",
        "stop_headsign": "text",
        "pickup_type": "byte?",
        "drop_off_type": "byte?",
        "timepoint": "byte?",
    },
    "calendar": {
        "service_id": "text!",
        "monday": "byte!",
        "tuesday": "byte!",
        "wednesday": "byte!",
        "thursday": "byte!",
        "friday": "byte!",
        "saturday": "byte!",
        "sunday": "byte!",
        "start_date": "date!",
        "end_date": "date!",
    },
    "calendar_dates": {
        "service_id": "text!",
        "date": "date!",
        "exception_type": "byte!",
    },
    "shapes": {
        "shape_id": "text!",
        "shape_pt_lat": "double!",
        "shape_pt_lon": "double!",
        "shape_pt_sequence": "int!",
        "shape_dist_traveled": "double?",
    },
    "transfers": {
        "from_stop_id": "text",
        "to_stop_id": "text",
        "from_route_id": "text",
        "to_route_id": "text",
        "from_trip_id": "text",
        "to_trip_id": "text",
        "transfer_type": "byte",
        "min_transfer_time": "int?",
    },
    "feed_info": {
        "feed_publisher_name": "text!",
        "feed_publisher_url": "text!",
        "feed_lang": "text!",
        "default_lang": "text",
        "feed_start_date": "date?",
        "feed_end_date": "date?",
        "feed_version": "text",
        "feed_contact_email": "text",
        "feed_contact_url": "text",
    },
}

# Fixed value: calendar flag columns, Sunday first to match `service_weekday`.
WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")


@dataclass(frozen=True)
class Feed:
    """Typed GTFS records under their GTFS column names, each with a `row_no` in file order."""

    agency: DataFrame
    stops: DataFrame
    routes: DataFrame
    trips: DataFrame
    stop_times: DataFrame
    calendar: DataFrame
    calendar_dates: DataFrame
    shapes: DataFrame
    transfers: DataFrame
    feed_info: DataFrame
    frequencies: DataFrame

    def files(self) -> Iterator[tuple[str, DataFrame]]:
        for name in GTFS_COLUMNS:
            yield name, getattr(self, name)


@dataclass(frozen=True)
class Timetable:
    """The tables queries run on."""

    agencies: DataFrame
    stops: DataFrame
    routes: DataFrame
    trips: DataFrame
    stop_times: DataFrame
    service_calendars: DataFrame
    service_exceptions: DataFrame
    shape_points: DataFrame
    transfers: DataFrame
    feed_info: DataFrame
    #: What a published version keeps for other ways of reading it, see `haltline.operators.indexes`.
    indexes: Mapping[str, DataFrame] = field(default_factory=dict)

    def tables(self) -> Iterator[tuple[str, DataFrame]]:
        for name in self.table_names():
            yield name, getattr(self, name)

    @classmethod
    def table_names(cls) -> list[str]:
        return [one.name for one in fields(cls) if one.name != "indexes"]

    @classmethod
    def from_tables(
        cls, tables: Mapping[str, DataFrame], indexes: Mapping[str, DataFrame] | None = None
    ) -> Timetable:
        return cls(**{name: tables[name] for name in cls.table_names()}, indexes=indexes or {})


# Column lists of the query results.
STOP_COLUMNS = (
    "stop_id",
    "code",
    "name",
    "latitude",
    "longitude",
    "location_type",
    "parent_stop_id",
    "platform_code",
)
ROUTE_COLUMNS = (
    "route_id",
    "agency_id",
    "short_name",
    "long_name",
    "route_type",
    "color",
    "text_color",
)
TRIP_COLUMNS = (
    "trip_id",
    "route_id",
    "service_id",
    "headsign",
    "short_name",
    "direction_id",
    "shape_id",
)
AGENCY_COLUMNS = ("agency_id", "name", "url", "timezone")
GROUP_COLUMNS = (
    "group_id",
    "name",
    "latitude",
    "longitude",
    "min_latitude",
    "min_longitude",
    "max_latitude",
    "max_longitude",
    "member_count",
)
