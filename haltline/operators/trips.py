"""Trips, their calls and their shapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltline.functions import gtfs_time_text
from haltline.operators.indexes import calls_of_trips
from haltline.operators.ranking import rank_by_bucket
from haltline.operators.spread import MOST_PASSING_TASKS, spread_join
from haltline.operators.stops import stop_view
from haltline.schema import STOP_COLUMNS, TRIP_COLUMNS, Timetable
from haltline.session import keep_table

POINTS_PER_LINE_PART = 10_000
POINTS_PER_BUCKET = 4_096
#: Parts of calls that one task joins with their part of the shape: such rows are long.
CALL_PART_TASK_ROWS = 1 << 18

POINT_COLUMNS = ("sequence", "latitude", "longitude", "distance_traveled")
CALL_COLUMNS = (
    "stop_sequence",
    "scheduled_arrival",
    "scheduled_arrival_seconds",
    "scheduled_departure",
    "scheduled_departure_seconds",
    "headsign",
    "pickup_type",
    "drop_off_type",
    "timepoint",
)


def lookup_trips(timetable: Timetable, requests: DataFrame) -> DataFrame:
    return requests.select("request_id", "trip_id").join(
        timetable.trips.select(*TRIP_COLUMNS), "trip_id"
    )


def call_view(timetable: Timetable, trips: DataFrame | None = None) -> DataFrame:
    """Every call with its stop as a struct, optionally of some trips only.

    Pickup, drop-off and timepoint stay as given.
    """
    given = timetable.stop_times if trips is None else calls_of_trips(timetable, trips)
    return _with_stops(timetable, given, "trip_id")


def _with_stops(timetable: Timetable, calls: DataFrame, *keys: str) -> DataFrame:
    """Calls with their stop. Times become text and stops are attached last: neither is shuffled again."""
    stops = stop_view(timetable.stops).select(
        "stop_id", F.struct(*STOP_COLUMNS).alias("stop")
    )
    return calls.join(stops, "stop_id").select(
        *keys,
        "stop",
        "stop_sequence",
        gtfs_time_text(F.col("arrival_seconds")).alias("scheduled_arrival"),
        F.col("arrival_seconds").alias("scheduled_arrival_seconds"),
        gtfs_time_text(F.col("departure_seconds")).alias("scheduled_departure"),
        F.col("departure_seconds").alias("scheduled_departure_seconds"),
        F.col("stop_headsign").alias("headsign"),
        "pickup_type",
        "drop_off_type",
        "timepoint",
    )


def trip_calls(timetable: Timetable, requests: DataFrame) -> DataFrame:
    """requests(request_id, trip_id) to the trip's calls; order them by `stop_sequence`."""
    wanted = requests.select("request_id", "trip_id")
    calls = calls_of_trips(timetable, wanted).join(wanted, "trip_id")
    return _with_stops(timetable, calls, "request_id", "trip_id").select("request_id", "trip_id", "stop", *CALL_COLUMNS)


def _with_points(timetable: Timetable, asked: DataFrame) -> DataFrame:
    """asked(request_id, shape_id, …) with every point of the shape.

    Points travel packed, `POINTS_PER_BUCKET` sequence numbers to a row, and are unpacked in the task that gives them.
    """
    packed = (
        timetable.shape_points.groupBy("shape_id", F.floor(F.col("sequence") / POINTS_PER_BUCKET).alias("bucket"))
        .agg(F.collect_list(F.struct(*POINT_COLUMNS)).alias("points"))
    )
    joined = spread_join(
        asked,
        packed,
        ["shape_id"],
        ["request_id"],
        F.size("points"),
        deal="bucket",
        most_tasks=MOST_PASSING_TASKS,
    )
    return joined.select(*asked.columns, F.inline("points"))


def trip_shape(timetable: Timetable, requests: DataFrame) -> DataFrame:
    """requests(request_id, trip_id) to the shape points of the trip; no shape, no rows."""
    shapes = timetable.trips.filter(F.col("shape_id").isNotNull()).select("trip_id", "shape_id")
    asked = requests.select("request_id", "trip_id").join(shapes, "trip_id")
    return _with_points(timetable, asked).select("request_id", "trip_id", *POINT_COLUMNS)


def _shape_sizes(timetable: Timetable) -> DataFrame:
    return timetable.shape_points.groupBy("shape_id").agg(
        F.count(F.lit(1)).alias("shape_points")
    )


def shape_points_of(timetable: Timetable, requests: DataFrame) -> DataFrame:
    """requests(request_id, shape_id) to all points of the shape, however many."""
    asked = requests.select("request_id", "shape_id").filter(F.col("shape_id").isNotNull())
    return _with_points(timetable, asked).select("request_id", "shape_id", *POINT_COLUMNS)


def trip_sizes(
    timetable: Timetable,
    max_calls: int | None = None,
    max_points: int | None = None,
) -> DataFrame:
    """Calls and shape points of every trip, and whether either exceeds what the caller can show."""

    def beyond(name: str, bound: int | None) -> Column:
        return F.lit(False) if bound is None else F.col(name) > bound

    calls = timetable.stop_times.groupBy("trip_id").agg(F.count(F.lit(1)).alias("stop_calls"))
    return (
        timetable.trips.select("trip_id", "shape_id")
        .join(calls, "trip_id", "left")
        .join(_shape_sizes(timetable), "shape_id", "left")
        .select(
            "trip_id",
            F.coalesce("stop_calls", F.lit(0)).alias("stop_calls"),
            F.coalesce("shape_points", F.lit(0)).alias("shape_points"),
        )
        .withColumn("too_many_calls", beyond("stop_calls", max_calls))
        .withColumn("too_many_points", beyond("shape_points", max_points))
    )


def trip_detail(
    timetable: Timetable,
    requests: DataFrame,
    part_rows: int = POINTS_PER_LINE_PART,
    calls_as: Callable[[str], Column] | None = None,
    shape_as: Callable[[str], Column] | None = None,
) -> DataFrame:
    """requests(request_id, trip_id) to the trip with its calls and shape as ordered arrays.

    A row holds the calls and the shape points number `part` * `part_rows` and on, `part_rows` of each at
    most, so a trip of any length is answered in full and no array grows without bound. Every known trip has
    part 0; a part without calls or without points has NULL there.

    `calls_as` and `shape_as` make something else of the column of arrays they are told the name of, a text for example.
    That is done once for a part of a shape, not once for each trip that has it.
    """
    asked = requests.select("trip_id").distinct()
    trips = timetable.trips.join(asked, "trip_id", "left_semi").select(*TRIP_COLUMNS)
    heads = keep_table(requests.select("request_id", "trip_id").join(trips, "trip_id"))

    def numbered(rows: DataFrame, key: str, sequence: str) -> DataFrame:
        bucket = F.floor(F.col(sequence) / POINTS_PER_BUCKET)
        ranked = rank_by_bucket(rows.withColumn("bucket", bucket), [key], "bucket", [sequence])
        return ranked.withColumn("part", F.floor((F.col("rank") - 1) / part_rows).cast("int"))

    def parts(rows: DataFrame, key: str, columns: Column, name: str, finish: Callable | None) -> DataFrame:
        packed = rows.groupBy(key, "part").agg(F.array_sort(F.collect_list(columns)).alias(name))
        return packed if finish is None else packed.withColumn(name, finish(name))

    # Stops are wide, so they are attached once calls are numbered.
    own_calls = numbered(calls_of_trips(timetable, asked), "trip_id", "stop_sequence")
    call = F.struct("stop_sequence", "stop", *CALL_COLUMNS[1:])
    with_stops = _with_stops(timetable, own_calls, "trip_id", "part")
    calls = keep_table(parts(with_stops, "trip_id", call, "calls", calls_as))
    points = timetable.shape_points.join(heads.select("shape_id").distinct(), "shape_id", "left_semi")
    own_points = numbered(points, "shape_id", "sequence")
    shapes = keep_table(parts(own_points, "shape_id", F.struct(*POINT_COLUMNS), "shape", shape_as))
    # Parts with calls, or the first one, meet their own points; the other parts of a shape follow, packed. Nothing
    # is shuffled once parts are multiplied by trips.
    first = heads.join(calls, "trip_id", "left").withColumn("part", F.coalesce("part", F.lit(0)))
    columns = ["request_id", *TRIP_COLUMNS, "part", "calls", "shape"]
    begun = spread_join(
        first, shapes, ["shape_id", "part"], ["request_id"], how="left", task_rows=CALL_PART_TASK_ROWS
    ).select(*columns)
    packed = shapes.groupBy("shape_id", F.floor(F.col("part") * part_rows / POINTS_PER_BUCKET).alias("bucket")).agg(
        F.collect_list(F.struct("part", "shape")).alias("parts")
    )
    begun_parts = calls.groupBy("trip_id").agg((F.max("part") + 1).alias("begun"))
    rest = heads.filter(F.col("shape_id").isNotNull()).join(begun_parts, "trip_id", "left")
    rest = spread_join(
        rest,
        packed,
        ["shape_id"],
        ["request_id"],
        F.size("parts"),
        deal="bucket",
        most_tasks=MOST_PASSING_TASKS,
    )
    # Few parts go again, row by row: looking through packed parts would copy them for every trip.
    rest = rest.select("request_id", *TRIP_COLUMNS, "begun", F.inline("parts")).filter(
        F.col("part") >= F.coalesce("begun", F.lit(1))
    )
    rest = rest.withColumn("calls", F.lit(None).cast(calls.schema["calls"].dataType))
    return begun.unionByName(rest.select(*columns))


def _ranked_points(timetable: Timetable) -> DataFrame:
    """Points with their `rank` from 1 along each shape."""
    return rank_by_bucket(
        timetable.shape_points.withColumn(
            "bucket", F.floor(F.col("sequence") / POINTS_PER_BUCKET)
        ),
        ["shape_id"],
        "bucket",
        ["sequence"],
    ).drop("bucket")


def shape_linestrings(timetable: Timetable, part_points: int = POINTS_PER_LINE_PART) -> DataFrame:
    """(shape_id, part, points, wkt), longitude first.

    A shape of up to `part_points` points is one part. A longer one continues in further parts,
    which read one after the other give the whole line.
    """
    return (
        _ranked_points(timetable)
        .withColumn("part", F.floor((F.col("rank") - 1) / part_points).cast("int"))
        .groupBy("shape_id", "part")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "sequence",
                        F.col("longitude").alias("lon"),
                        F.col("latitude").alias("lat"),
                    )
                )
            ).alias("points")
        )
        .withColumn("wkt", _wkt(F.col("points")))
    )


def _wkt(points: Column) -> Column:
    return F.concat(
        F.lit("LINESTRING ("),
        F.array_join(
            F.transform(
                points,
                lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string")),
            ),
            ", ",
        ),
        F.lit(")"),
    )


def _extent(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(
        F.min("latitude").alias("min_lat"),
        F.min("longitude").alias("min_lon"),
        F.max("latitude").alias("max_lat"),
        F.max("longitude").alias("max_lon"),
    )


BOUNDS = ("min_lat", "min_lon", "max_lat", "max_lon")


def trip_extent(timetable: Timetable) -> DataFrame:
    """Bounding box and centre of each trip over its shape and located calls.

    Shapes are reduced once per shape, not once per trip. Trips without any position are left
    out.
    """
    located = timetable.stops.filter(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    ).select("stop_id", "latitude", "longitude")
    by_calls = _extent(
        timetable.stop_times.select("trip_id", "stop_id").join(located, "stop_id"), "trip_id"
    )
    by_shape = _extent(timetable.shape_points, "shape_id")
    from_shape = timetable.trips.select("trip_id", "shape_id").join(by_shape, "shape_id").select(
        "trip_id", *BOUNDS
    )
    return (
        by_calls.unionByName(from_shape)
        .groupBy("trip_id")
        .agg(
            F.min("min_lat").alias("min_lat"),
            F.min("min_lon").alias("min_lon"),
            F.max("max_lat").alias("max_lat"),
            F.max("max_lon").alias("max_lon"),
        )
        .withColumn("center_lat", (F.col("min_lat") + F.col("max_lat")) / 2)
        .withColumn("center_lon", (F.col("min_lon") + F.col("max_lon")) / 2)
    )


def colocated_calls(timetable: Timetable) -> DataFrame:
    """Calls that share their exact position with another call of the same trip."""
    located = timetable.stops.filter(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    ).select("stop_id", "latitude", "longitude")
    calls = timetable.stop_times.select("trip_id", "stop_id", "stop_sequence").join(
        located, "stop_id"
    )
    spot = ["trip_id", "latitude", "longitude"]
    shared = (
        calls.groupBy(*spot)
        .agg(F.count(F.lit(1)).alias("calls_here"))
        .filter(F.col("calls_here") > 1)
    )
    return calls.join(shared, spot).select(
        "trip_id", "stop_sequence", "stop_id", "latitude", "longitude", "calls_here"
    )


def thin_shapes(timetable: Timetable, target: int = 2_000) -> DataFrame:
    """Every n-th point of each shape plus its last one, n = max(points div target, 1)."""
    return (
        _ranked_points(timetable)
        .join(_shape_sizes(timetable), "shape_id")
        .withColumn("step", F.greatest(F.floor(F.col("shape_points") / target), F.lit(1)))
        .filter(
            ((F.col("rank") - 1) % F.col("step") == 0) | (F.col("rank") == F.col("shape_points"))
        )
        .select("shape_id", *POINT_COLUMNS)
    )
