"""Stop lookups, departures and the routes and trips that call at a stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltline.functions import gtfs_time_text, iso_date
from haltline.operators.calendar import service_active_on
from haltline.operators.indexes import stop_route_pairs
from haltline.operators.ranking import (
    by_crowd,
    first_per_group,
    ids_repeat,
    merge_lists,
    ranked_lists,
    top_per_request,
    with_limits,
)
from haltline.operators.requests import valid_requests
from haltline.operators.spread import spread_join
from haltline.schema import ROUTE_COLUMNS, STOP_COLUMNS, TRIP_COLUMNS, Timetable
from haltline.session import keep_table, side_by_side

NO_PICKUP = 1
#: Departures on dates that one task of a board looks at, about.
BOARD_TASK_ROWS = 1 << 20
#: Calls that one task of `stop_trips` reduces, about.
CALL_TASK_ROWS = 1 << 20
#: Departures of quiet stops that one task of `departures` looks through, about.
QUIET_TASK_ROWS = 1 << 18


def stop_view(stops: DataFrame) -> DataFrame:
    return stops.withColumn("location_type", F.coalesce("location_type", F.lit(0))).select(
        *STOP_COLUMNS
    )


def lookup_stops(timetable: Timetable, requests: DataFrame) -> DataFrame:
    """requests(request_id, stop_id). Unknown ids give no row, see `missing_keys`."""
    return requests.select("request_id", "stop_id").join(stop_view(timetable.stops), "stop_id")


def boardable_calls(timetable: Timetable) -> DataFrame:
    """Calls passengers can board: a departure time and pickup not forbidden."""
    return timetable.stop_times.filter(
        F.col("departure_seconds").isNotNull()
        & (F.coalesce("pickup_type", F.lit(0)) != NO_PICKUP)
    ).select(
        "stop_id",
        "trip_id",
        "stop_sequence",
        "departure_seconds",
        "stop_headsign",
        F.coalesce("pickup_type", F.lit(0)).alias("pickup_type"),
        F.coalesce("drop_off_type", F.lit(0)).alias("drop_off_type"),
        F.coalesce("timepoint", F.lit(1)).alias("timepoint"),
    )


def running_services(timetable: Timetable, dates: DataFrame) -> DataFrame:
    """(service_id, service_date): one row per service and requested date."""
    return service_active_on(timetable, dates)


def running_months(timetable: Timetable, dates: DataFrame) -> DataFrame:
    """(service_id, month, days): the requested dates a service runs on, bit n for the day n behind the first."""
    bit = F.call_function("shiftleft", F.lit(1), F.dayofmonth("service_date") - 1)
    return (
        running_services(timetable, dates)
        .groupBy("service_id", F.to_date(F.trunc("service_date", "MM")).alias("month"))
        .agg(F.bit_or(bit).alias("days"))
    )


def on_running_days(rows: DataFrame, months: DataFrame) -> DataFrame:
    """Rows whose service runs on their `service_date`, by a kept table of `running_months`.

    One number stands for a month of a service, so the table is small beside the rows, and they stay where they lie.
    """
    return (
        rows.withColumn("month", F.to_date(F.trunc("service_date", "MM")))
        .join(months, ["service_id", "month"])
        .filter(F.getbit("days", F.dayofmonth("service_date") - 1) == 1)
        .drop("month", "days")
    )


def first_per_service(
    rows: DataFrame, group: str, order: Sequence[str], cap: int
) -> DataFrame:
    """The first `cap` rows of every (group, service_id).

    The first rows of a date are among the first rows of the services running on it, so rows
    can be cut per service before they are repeated for many dates.
    """
    return first_per_group(rows, [group, "service_id"], order, cap).drop("rank")


DEPARTURE_ORDER = ("trip_id", "stop_sequence")


def _departing_trips(calls: DataFrame, timetable: Timetable) -> DataFrame:
    return (
        calls.join(
            timetable.trips.select("trip_id", "service_id", "route_id", "headsign"), "trip_id"
        )
        .withColumn("headsign", F.coalesce("stop_headsign", "headsign"))
        .drop("stop_headsign")
    )


def _departure_view(rows: DataFrame, timetable: Timetable, *keys: str) -> DataFrame:
    names = timetable.routes.select(
        "route_id",
        F.col("short_name").alias("route_short_name"),
        F.col("long_name").alias("route_long_name"),
    )
    return rows.join(names, "route_id").select(
        *keys,
        "trip_id",
        "route_id",
        "route_short_name",
        "route_long_name",
        "headsign",
        "stop_sequence",
        iso_date(F.col("service_date")).alias("service_date"),
        gtfs_time_text(F.col("departure_seconds")).alias("scheduled_departure"),
        F.col("departure_seconds").alias("scheduled_departure_seconds"),
        "pickup_type",
        "drop_off_type",
        "timepoint",
    )


def departures(timetable: Timetable, requests: DataFrame) -> DataFrame:
    """requests(request_id, stop_id, service_date, after, limit) to the next departures.

    The few calls of a quiet stop are looked through where they meet its requests; what requests and calls give
    together is not shuffled. At a busy stop the departures of each service are ranked in time order once, whatever
    dates are asked for, and the services that run on a request's date are merged like sorted lists: each is read only
    as far as all of them together surely hold `limit` departures. Calls joined grow with answers, not with services,
    dates or the calls of a busy stop.
    """
    requests, largest = with_limits(valid_requests(requests, "departures"))
    served, second = ["stop_id", "service_id"], "departure_seconds"
    calls = boardable_calls(timetable).join(
        requests.groupBy("stop_id").agg(F.min("after").alias("earliest")), "stop_id"
    )
    calls = calls.filter(F.col(second) >= F.col("earliest")).drop("earliest")
    # Counted and ranked from below, so the scan and joins are done once.
    rows, months, repeated = side_by_side(
        [
            lambda: keep_table(_departing_trips(calls, timetable)),
            lambda: keep_table(running_months(timetable, requests)),
            lambda: ids_repeat(requests),
        ]
    )
    quiet, busy = by_crowd(requests, rows, "stop_id")
    calm, merged = rows, None
    if not busy.isEmpty():
        loud = busy.select("stop_id").distinct()
        calm = rows.join(loud.join(quiet, "stop_id", "left_anti"), "stop_id", "left_anti")
        crowded = rows.join(loud, "stop_id", "left_semi")
        times = busy.select("stop_id", F.col("after").alias(second)).distinct()
        marks = times.join(crowded.select(*served).distinct(), "stop_id")
        ranked, before = ranked_lists(crowded, served, second, DEPARTURE_ORDER, largest, marks)
        asked = on_running_days(
            busy.join(before.withColumnRenamed(second, "after"), ["stop_id", "after"]), months
        ).select("request_id", *served, "service_date", "limit", "before")
        merged = merge_lists(ranked, asked, served, second, ["request_id"])
    # Stops meet their requests in tasks cut by the rows this gives, and each request is cut where its rows lie.
    sizes = quiet.groupBy("stop_id").agg(F.sum("n_rows").cast("double").alias("n_rows"))
    met = spread_join(
        quiet.drop("n_rows"), calm, ["stop_id"], ["request_id"], sizes=sizes, task_rows=QUIET_TASK_ROWS, keep_slot=True
    )
    found = on_running_days(met.filter(F.col(second) >= F.col("after")).drop("after"), months)
    order = [second, *DEPARTURE_ORDER]
    if repeated:
        if merged is not None:
            found = found.select(*merged.columns).unionByName(merged)
        best = top_per_request(found, order, largest)
    else:
        best = top_per_request(found, order, largest, "stop_id", "slot")
        if merged is not None:
            best_merged = top_per_request(merged, order, largest)
            best = best.select(*best_merged.columns).unionByName(best_merged)
    return _departure_view(best, timetable, "request_id", "stop_id")


def departure_board(timetable: Timetable, dates: DataFrame, k: int) -> DataFrame:
    """The first `k` departures of every stop on every date, with `rank`.

    The dates of a service travel as one number for each month, so that departures are not shuffled once per date.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    order = ["departure_seconds", *DEPARTURE_ORDER]
    few = keep_table(
        first_per_service(
            _departing_trips(boardable_calls(timetable), timetable), "stop_id", order, k
        )
    )
    months = keep_table(running_months(timetable, dates))
    on_days = few.join(months, "service_id")
    sizes = few.groupBy("service_id").agg(F.count(F.lit(1)).alias("n"))
    n_dated = sizes.join(months, "service_id").agg(F.sum(F.col("n") * F.bit_count("days"))).first()[0] or 0
    # Dates are listed where their stops already lie, in tasks cut by the rows this gives.
    dealt = on_days.repartition(n_dated // BOARD_TASK_ROWS + 1, "stop_id", "month")
    day = F.explode(F.filter(F.sequence(F.lit(0), F.lit(30)), lambda d: F.getbit("days", d) == 1))
    dated = dealt.withColumn("day", day).withColumn("service_date", F.date_add("month", F.col("day")))
    first = first_per_group(dated, ["stop_id", "month", "service_date"], order, k)
    return _departure_view(first, timetable, "stop_id", "rank")


def stop_routes(timetable: Timetable, requests: DataFrame) -> DataFrame:
    """requests(request_id, stop_id, limit) to the routes calling there on any date.

    Routes are reduced once per stop before any request is attached.
    """
    requests, largest = with_limits(valid_requests(requests, "stop_routes"))
    best = first_per_group(
        stop_route_pairs(timetable, requests), ["stop_id"], ["route_id"], largest
    )
    return (
        requests.join(best, "stop_id")
        .filter(F.col("rank") <= F.col("limit"))
        .join(timetable.routes, "route_id")
        .select("request_id", "stop_id", *ROUTE_COLUMNS)
    )


def first_running_trips(
    timetable: Timetable, trips: DataFrame, asked: DataFrame, group: str, largest: int
) -> DataFrame:
    """(group, service_date, trip_id, rank) of the first `limit` trips by id for asked(group, service_date, limit).

    trips(group, trip_id, service_id) are distinct. Only services that run on the date are looked at, and those
    of a group with many trips only as far as `limit` asks.
    """
    served, day = [group, "service_id"], [group, "service_date"]
    trips = keep_table(trips)
    months = keep_table(running_months(timetable, asked))
    columns = [*day, "trip_id"]
    quiet, busy = by_crowd(asked, trips, group)
    found = on_running_days(quiet.join(trips, group), months).select(*columns)
    if not busy.isEmpty():
        crowded = trips.join(busy.select(group).distinct(), group, "left_semi")
        ranked, _ = ranked_lists(crowded, served, "trip_id", [], largest)
        pairs = on_running_days(busy.join(crowded.select(*served).distinct(), group), months).withColumn(
            "before", F.lit(0).cast("long")
        )
        found = found.unionByName(merge_lists(ranked, pairs, served, "trip_id", day).select(*columns))
    return first_per_group(found, day, ["trip_id"], largest)


def _trips_at_stops(timetable: Timetable, asked: DataFrame) -> DataFrame:
    """(stop_id, trip_id, service_id), each once, of the stops asked for.

    Hardly any trip calls at a stop twice, so calls meet their trips before repeats are looked for, in tasks cut by
    the number of calls: reduced in the scan, each task would hold all calls of its piece of a file.
    """
    n_tasks = timetable.stop_times.count() // CALL_TASK_ROWS + 1
    return (
        timetable.stop_times.select("stop_id", "trip_id")
        .join(asked.select("stop_id").distinct(), "stop_id", "left_semi")
        .repartition(n_tasks, "trip_id")
        .distinct()
        .join(timetable.trips.select("trip_id", "service_id"), "trip_id")
    )


def stop_trips(timetable: Timetable, requests: DataFrame) -> DataFrame:
    """requests(request_id, stop_id, service_date, limit) to the trips calling there that day.

    Trips of a (stop, service) are ranked once; the services running on a date are merged up to its limit.
    """
    requests, largest = with_limits(valid_requests(requests, "stop_trips"))
    day = ["stop_id", "service_date"]
    asked = requests.groupBy(*day).agg(F.max("limit").alias("limit"))
    best = first_running_trips(timetable, _trips_at_stops(timetable, asked), asked, "stop_id", largest)
    return (
        requests.join(best, day)
        .filter(F.col("rank") <= F.col("limit"))
        .join(timetable.trips, "trip_id")
        .select(
            "request_id",
            "stop_id",
            iso_date(F.col("service_date")).alias("service_date"),
            *TRIP_COLUMNS,
        )
    )
