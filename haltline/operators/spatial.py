"""Nearby stops and everything inside a rectangle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltline.functions import haversine_m
from haltline.functions.geo import EARTH_RADIUS_M, METRES_PER_DEGREE
from haltline.operators.cover import first_keys_in_boxes
from haltline.operators.grid import (
    CELL_SIZES,
    cell_keys,
    distinct_spots,
    points_in_boxes,
)
from haltline.operators.ranking import DEFAULT_RECT_LIMIT, top_per_request, with_limits
from haltline.operators.requests import valid_requests
from haltline.operators.stops import stop_view
from haltline.schema import GROUP_COLUMNS, STOP_COLUMNS, Timetable
from haltline.session import keep_table


def _with_rule_box(requests: DataFrame) -> DataFrame:
    """The degree box a nearby answer must lie in, in addition to the distance; never beyond the globe."""
    lat_delta = F.col("radius") / METRES_PER_DEGREE
    lon_scale = F.greatest(F.abs(F.cos(F.radians("lat"))), F.lit(0.01))
    lon_delta = F.col("radius") / (F.lit(METRES_PER_DEGREE) * lon_scale)
    return (
        requests.withColumn("min_lat", F.greatest(F.col("lat") - lat_delta, F.lit(-90.0)))
        .withColumn("max_lat", F.least(F.col("lat") + lat_delta, F.lit(90.0)))
        .withColumn("min_lon", F.greatest(F.col("lon") - lon_delta, F.lit(-180.0)))
        .withColumn("max_lon", F.least(F.col("lon") + lon_delta, F.lit(180.0)))
    )


def _reach(spots: DataFrame, boxed: DataFrame) -> DataFrame:
    """(request_id, reach): a distance within which `limit` answers are certain to lie.

    Stops are counted per cell of every size. The smallest cell around the request that lies in
    its box and holds enough stops bounds the distance of the last answer, so a dense city is
    never scanned out to the full radius. Requests without such a cell get no row.
    """
    cell = ["cell_level", "cell_y", "cell_x"]
    counts = (
        cell_keys(spots.select("latitude", "longitude"))
        .groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    size = F.element_at(F.array(*map(F.lit, CELL_SIZES)), F.col("cell_level") + 1)
    south, west = F.col("cell_y") * size, F.col("cell_x") * size
    north, east = south + size, west + size
    # To any point of the cell: a step in latitude, then one in longitude.
    steps = F.greatest(F.col("lat") - south, north - F.col("lat")) + F.greatest(
        F.col("lon") - west, east - F.col("lon")
    )
    own_cells = cell_keys(
        boxed.withColumn("latitude", F.col("lat")).withColumn("longitude", F.col("lon"))
    )
    return (
        own_cells.join(counts.hint("merge"), cell)
        .withColumn("reach", F.radians(steps) * EARTH_RADIUS_M)
        .filter(
            (F.col("n") >= F.col("limit"))
            & (F.col("reach") <= F.col("radius"))
            & (south >= F.col("min_lat"))
            & (north <= F.col("max_lat"))
            & (west >= F.col("min_lon"))
            & (east <= F.col("max_lon"))
        )
        .groupBy("request_id")
        .agg(F.min("reach").alias("reach"))
    )


def _shrunk_to_reach(boxed: DataFrame) -> DataFrame:
    """Cut the box to the smallest one around the circle of `reach`, where that is known."""
    angle = F.col("reach") / EARTH_RADIUS_M
    ratio = F.sin(angle) / F.cos(F.radians("lat"))
    lat_delta = F.degrees(angle) + 1e-6
    lon_delta = (
        F.when((angle < 1.0) & (ratio > 0) & (ratio < 1), F.degrees(F.asin(ratio))).otherwise(360.0)
        + 1e-6
    )
    # greatest and least skip NULLs, so a box without a reach stays as it is.
    return (
        boxed.withColumn("min_lat", F.greatest("min_lat", F.col("lat") - lat_delta))
        .withColumn("max_lat", F.least("max_lat", F.col("lat") + lat_delta))
        .withColumn(
            "min_lon",
            F.when(F.col("reach").isNull(), F.col("min_lon")).otherwise(
                F.greatest("min_lon", F.col("lon") - lon_delta)
            ),
        )
        .withColumn(
            "max_lon",
            F.when(F.col("reach").isNull(), F.col("max_lon")).otherwise(
                F.least("max_lon", F.col("lon") + lon_delta)
            ),
        )
    )


def nearby_stops(timetable: Timetable, requests: DataFrame) -> DataFrame:
    """requests(request_id, lat, lon, radius, limit) to the closest stops within the radius.

    Stops without a position are never near. Equal distances are ordered by id. Requests that break a
    rule get no answer, see `request_issues`.
    """
    requests, largest = with_limits(valid_requests(requests, "nearby_stops"))
    stops = stop_view(timetable.stops).filter(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    )
    spots = keep_table(
        distinct_spots(stops.select("stop_id", "latitude", "longitude"), "stop_id", largest)
    )
    boxed = _with_rule_box(requests)
    # Sizes are guessed from compressed files, in which cells and names count for nothing: without the hints, a million
    # stops in ten sizes of cells would be broadcast.
    boxes = keep_table(_shrunk_to_reach(boxed.join(_reach(spots, boxed).hint("merge"), "request_id", "left")))
    candidates = (
        points_in_boxes(spots, boxes)
        .withColumn(
            "distance_m",
            haversine_m(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude")),
        )
        .filter(F.col("distance_m") <= F.col("radius"))
        .select("request_id", "limit", "stop_id", "distance_m")
    )
    best = top_per_request(candidates, ["distance_m", "stop_id"], largest)
    return best.join(stops.hint("merge"), "stop_id").select("request_id", "rank", *STOP_COLUMNS, "distance_m")


def stops_in_rect(timetable: Timetable, requests: DataFrame) -> DataFrame:
    """requests(request_id, min_lat, min_lon, max_lat, max_lon, limit) to stops by id."""
    requests, largest = with_limits(
        valid_requests(requests, "stops_in_rect"), DEFAULT_RECT_LIMIT
    )
    stops = stop_view(timetable.stops)
    spots = distinct_spots(
        stops.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
            "stop_id", "latitude", "longitude"
        ),
        "stop_id",
        largest,
    )
    found = first_keys_in_boxes(spots, "stop_id", requests, largest)
    best = top_per_request(found, ["stop_id"], largest)
    return best.join(stops.hint("merge"), "stop_id").select("request_id", *STOP_COLUMNS)


def stop_groups_in_rect(groups: DataFrame, requests: DataFrame) -> DataFrame:
    """As `stops_in_rect` for groups by their representative point."""
    requests, largest = with_limits(
        valid_requests(requests, "stop_groups_in_rect"), DEFAULT_RECT_LIMIT
    )
    spots = distinct_spots(
        groups.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
            "group_id", "latitude", "longitude"
        ),
        "group_id",
        largest,
    )
    found = first_keys_in_boxes(spots, "group_id", requests, largest)
    best = top_per_request(found, ["group_id"], largest)
    return best.join(groups.hint("merge"), "group_id").select("request_id", *GROUP_COLUMNS)


__all__ = ["nearby_stops", "stop_groups_in_rect", "stops_in_rect"]
