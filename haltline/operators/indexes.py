"""What a published version keeps besides its tables, so that requests read little of it.

    calls_by_trip    a covering copy of stop_times in the order of (trip_id, stop_sequence), while stop_times
                     itself lies by stop; calls of a trip are neighbours in it
    stop_routes      (stop_id, route_id) of all calls, each once
    trip_order       (route_id, range_no, trip_id): the trips of a route in id order, `RANGE_KEYS` to a range
    trip_ranges      (route_id, range_no, first): the first id of each range, an order-statistics index for pages

Parquet skips what lies outside of the requested keys, see `rows_of_keys`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haltline.operators.ranking import first_per_group, rank_by_range
from haltline.schema import Timetable

#: Keys that are sent to a scan one by one; beyond, their least and greatest are.
MANY_KEYS = 1_000
#: Every range but the last of its group holds so many keys.
RANGE_KEYS = 1_000

#: Sort keys of each index, as for the tables.
INDEX_CLUSTERING = {
    "calls_by_trip": ("trip_id", "stop_sequence"),
    "stop_routes": ("stop_id", "route_id"),
    "trip_order": ("route_id", "range_no", "trip_id"),
    "trip_ranges": ("route_id", "range_no"),
}


def build_indexes(timetable: Timetable) -> dict[str, DataFrame]:
    ranked = rank_by_range(timetable.trips.select("route_id", "trip_id"), ["route_id"], [F.col("trip_id")])
    order = ranked.select("route_id", F.floor((F.col("rank") - 1) / RANGE_KEYS).alias("range_no"), "trip_id")
    return {
        "calls_by_trip": timetable.stop_times,
        "stop_routes": stop_route_pairs(timetable),
        "trip_order": order,
        "trip_ranges": order.groupBy("route_id", "range_no").agg(F.min("trip_id").alias("first")),
    }


def rows_of_keys(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose `key` is among `wanted`, with the keys pushed down into the scan.

    At most `MANY_KEYS` + 1 keys come to the driver. More keys only send their least and greatest.
    """
    distinct = wanted.select(key).distinct()
    few = [row[0] for row in distinct.limit(MANY_KEYS + 1).collect()]
    if len(few) <= MANY_KEYS:
        few = sorted(one for one in few if one is not None)
        if not few:
            return rows.filter(F.lit(False))
        # Statistics know a range; beyond a few values Spark sends no list.
        return rows.filter(F.col(key).between(few[0], few[-1]) & F.col(key).isin(few))
    low, high = wanted.agg(F.min(key), F.max(key)).first()
    return rows.filter(F.col(key).between(low, high)).join(distinct, key, "left_semi")


def stop_route_pairs(timetable: Timetable, stops: DataFrame | None = None) -> DataFrame:
    """Distinct (stop_id, route_id) over all calls, optionally of some stops only."""
    kept = timetable.indexes.get("stop_routes")
    if kept is not None:
        return kept if stops is None else rows_of_keys(kept, "stop_id", stops)
    calls = timetable.stop_times.select("stop_id", "trip_id")
    if stops is not None:
        calls = calls.join(stops.select("stop_id").distinct(), "stop_id", "left_semi")
    return (
        calls.join(timetable.trips.select("trip_id", "route_id"), "trip_id")
        .select("stop_id", "route_id")
        .distinct()
    )


def calls_of_trips(timetable: Timetable, trips: DataFrame) -> DataFrame:
    """All columns of stop_times for the `trip_id` values of `trips`."""
    kept = timetable.indexes.get("calls_by_trip")
    if kept is not None:
        return rows_of_keys(kept, "trip_id", trips)
    return timetable.stop_times.join(trips.select("trip_id").distinct(), "trip_id", "left_semi")


def trips_behind(timetable: Timetable, requests: DataFrame, n: int) -> DataFrame:
    """requests(request_id, route_id, after_key) to the next `n` trips of the route, with their `nth` from 1.

    The range that a key falls into is found among the first keys of the ranges; a request then meets that range and
    those behind it that `n` keys can reach, whatever its route holds.
    """
    asked = requests.select("request_id", "route_id", "after_key")
    ranges = rows_of_keys(timetable.indexes["trip_ranges"], "route_id", asked)
    places = ranges.select("route_id", F.col("first").alias("key"), "range_no").unionByName(
        asked.withColumnRenamed("after_key", "key"), allowMissingColumns=True
    )
    # Ranges before requests of the same key; a key before all ranges falls into the first.
    upto = (
        Window.partitionBy("route_id")
        .orderBy("key", F.col("range_no").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    home = F.coalesce(F.last("range_no", ignorenulls=True).over(upto), F.lit(0))
    reach = -(-n // RANGE_KEYS)
    touched = (
        places.withColumn("home", home)
        .filter(F.col("request_id").isNotNull())
        .select(
            "request_id",
            "route_id",
            F.col("key").alias("after_key"),
            F.explode(F.sequence(F.col("home"), F.col("home") + reach)).alias("range_no"),
        )
    )
    order = rows_of_keys(timetable.indexes["trip_order"], "route_id", asked)
    found = order.join(touched, ["route_id", "range_no"]).filter(F.col("trip_id") > F.col("after_key"))
    return first_per_group(found, ["request_id"], ["trip_id"], n).select(
        "request_id", "route_id", "trip_id", F.col("rank").alias("nth")
    )
