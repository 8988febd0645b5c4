"""Validated GTFS records to the tables queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltline.functions import empty_to_null
from haltline.schema import GTFS_COLUMNS, WEEKDAYS, Feed, Timetable


def _optional(source: str, name: str):
    return empty_to_null(F.col(source)).alias(name)


def normalize_feed(feed: Feed) -> Timetable:
    """Renamed, typed tables. Empty optional text becomes NULL, required text stays empty.

    No row is dropped here: `dangling_references` must be empty before the result is published.
    """
    routes = feed.routes.select(
        "route_id",
        _optional("agency_id", "agency_id"),
        _optional("route_short_name", "short_name"),
        _optional("route_long_name", "long_name"),
        "route_type",
        _optional("route_color", "color"),
        _optional("route_text_color", "text_color"),
    )
    stops = feed.stops.select(
        "stop_id",
        _optional("stop_code", "code"),
        F.col("stop_name").alias("name"),
        F.col("stop_lat").alias("latitude"),
        F.col("stop_lon").alias("longitude"),
        "location_type",
        _optional("parent_station", "parent_stop_id"),
        _optional("platform_code", "platform_code"),
    )
    return Timetable(
        agencies=feed.agency.select(
            "agency_id",
            F.col("agency_name").alias("name"),
            F.col("agency_url").alias("url"),
            F.col("agency_timezone").alias("timezone"),
        ),
        stops=stops,
        routes=routes,
        trips=feed.trips.select(
            "trip_id",
            "route_id",
            "service_id",
            _optional("trip_headsign", "headsign"),
            _optional("trip_short_name", "short_name"),
            "direction_id",
            _optional("shape_id", "shape_id"),
        ),
        stop_times=feed.stop_times.select(
            "trip_id",
            "stop_id",
            "stop_sequence",
            F.col("arrival_time").alias("arrival_seconds"),
            F.col("departure_time").alias("departure_seconds"),
            _optional("stop_headsign", "stop_headsign"),
            "pickup_type",
            "drop_off_type",
            "timepoint",
        ),
        service_calendars=feed.calendar.select("service_id", *WEEKDAYS, "start_date", "end_date"),
        service_exceptions=feed.calendar_dates.select(
            "service_id", F.col("date").alias("service_date"), "exception_type"
        ),
        shape_points=feed.shapes.select(
            "shape_id",
            F.col("shape_pt_sequence").alias("sequence"),
            F.col("shape_pt_lat").alias("latitude"),
            F.col("shape_pt_lon").alias("longitude"),
            F.col("shape_dist_traveled").alias("distance_traveled"),
        ),
        transfers=feed.transfers.select(*GTFS_COLUMNS["transfers"]),
        feed_info=feed.feed_info.select(
            F.col("feed_publisher_name").alias("publisher_name"),
            F.col("feed_publisher_url").alias("publisher_url"),
            "feed_lang",
            _optional("default_lang", "default_lang"),
            F.col("feed_start_date").alias("start_date"),
            F.col("feed_end_date").alias("end_date"),
            _optional("feed_version", "source_version"),
            _optional("feed_contact_email", "contact_email"),
            _optional("feed_contact_url", "contact_url"),
        ),
    )


def dangling_references(timetable: Timetable) -> DataFrame:
    """Keys that trips and stop times use but no table defines, with how often.

    Keys are counted before the shuffle, so a key used by a third of the rows travels once
    per task.
    """
    checks = (
        ("route", timetable.trips, timetable.routes, "route_id"),
        ("trip", timetable.stop_times, timetable.trips, "trip_id"),
        ("stop", timetable.stop_times, timetable.stops, "stop_id"),
    )
    result = None
    for entity, rows, owners, key in checks:
        part = (
            rows.groupBy(key)
            .agg(F.count(F.lit(1)).alias("n"))
            .join(owners.select(key), key, "left_anti")
            .select(F.lit(entity).alias("entity"), F.col(key).alias("key"), "n")
        )
        result = part if result is None else result.unionByName(part)
    return result
