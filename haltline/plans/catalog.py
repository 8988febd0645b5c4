"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haltline.functions import (
    compact_date,
    day_offset,
    gtfs_date,
    gtfs_seconds,
    gtfs_time_text,
    iso_date,
    service_weekday,
)
from haltline.operators import (
    calendar,
    groups,
    load,
    requests,
    routes,
    search,
    spatial,
    stops,
    trips,
    validation,
)
from haltline.plans.benchfeed import bench_feed, bench_timetable, faulty_feed, given_sql
from haltline.plans.requests import SPARK_REQUEST_SQL
from haltline.schema import STOP_COLUMNS, Timetable
from haltline.sources.archive import feed_file_issues
from haltline.sources.feed import feed_counts, unreadable_values
from haltline.sources.store import schedule_metadata

Query = Callable[[SparkSession, str], DataFrame]


def _asks(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return given_sql(spark, sf_dir, SPARK_REQUEST_SQL[name])


def _answers(
    operator: Callable[[Timetable, DataFrame], DataFrame],
    request: str,
    finish: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return finish(operator(bench_timetable(spark, sf_dir), _asks(spark, sf_dir, request)))

    return query


def _tables(build: Callable[[Timetable], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(bench_timetable(spark, sf_dir))


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


def _flat_calls(df: DataFrame) -> DataFrame:
    return df.select(
        "request_id",
        "trip_id",
        *(F.col(f"stop.{name}").alias(name) for name in STOP_COLUMNS),
        *(name for name in trips.CALL_COLUMNS),
    )


def _joined(array: str, *parts: Callable[[Column], Column]) -> Column:
    """An array of structs as text, for engines that compare flat values."""
    return F.array_join(
        F.transform(
            array,
            lambda item: F.concat_ws(
                "/", *(F.coalesce(part(item).cast("string"), F.lit("-")) for part in parts)
            ),
        ),
        " ",
    )


def _field(*path: str) -> Callable[[Column], Column]:
    def get(item: Column) -> Column:
        for name in path:
            item = item[name]
        return item

    return get


def _calls_text(calls: str) -> Column:
    return _joined(
        calls, _field("stop_sequence"), _field("stop", "stop_id"), _field("scheduled_departure")
    )


def _trip_detail_text(df: DataFrame) -> DataFrame:
    return df.select(
        "request_id",
        "trip_id",
        "route_id",
        "part",
        F.coalesce("calls", F.lit("")).alias("calls"),
        F.coalesce("shape", F.lit("")).alias("shape"),
    )


def _linestring_text(df: DataFrame) -> DataFrame:
    return df.select(
        "shape_id",
        "part",
        F.size("points").cast("long").alias("n_points"),
        _joined(
            "points",
            _field("sequence"),
            lambda p: F.format_string("%.3f", p["lon"]),
            lambda p: F.format_string("%.3f", p["lat"]),
        ).alias("line"),
    )


def _grouped(
    build: Callable[[Timetable, DataFrame, DataFrame], DataFrame],
) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        timetable = bench_timetable(spark, sf_dir)
        all_groups, members = groups.derive_stop_groups(timetable.stops)
        return build(timetable, all_groups, members)

    return query


GROUP_NUMBERS = (
    "latitude",
    "longitude",
    "min_latitude",
    "min_longitude",
    "max_latitude",
    "max_longitude",
)


def _stop_groups_in_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_groups, _ = groups.derive_stop_groups(bench_timetable(spark, sf_dir).stops)
    found = spatial.stop_groups_in_rect(all_groups, _asks(spark, sf_dir, "rects"))
    return _rounded(found, 9, *GROUP_NUMBERS)


def _stop_group_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    timetable = bench_timetable(spark, sf_dir)
    all_groups, members = groups.derive_stop_groups(timetable.stops)
    detail = groups.stop_group_details(
        timetable, all_groups, members, _asks(spark, sf_dir, "groups")
    )
    return detail.select(
        "request_id",
        "group_id",
        "name",
        "member_count",
        "part",
        _joined(
            "members",
            _field("stop_id"),
            lambda m: F.array_join(m["route_ids"], "+"),
            lambda m: F.array_join(m["agency_ids"], "+"),
        ).alias("members"),
        _joined("routes", _field("route_id")).alias("routes"),
        _joined("agencies", _field("agency_id")).alias("agencies"),
    )


def _validated(family: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return validation.RULE_FAMILIES[family](faulty_feed(spark, sf_dir)).select(
            "code", "record"
        )

    return query


def _normalized(table: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = getattr(bench_timetable(spark, sf_dir), table)
        dates = [name for name, kind in df.dtypes if kind == "date"]
        return df.withColumns({name: iso_date(F.col(name)) for name in dates})

    return query


def _issues_of(request: str, kind: str) -> Query:
    return lambda spark, sf_dir: requests.request_issues(_asks(spark, sf_dir, request), kind)


def _parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _asks(spark, sf_dir, "text_stop_times")
    seconds = gtfs_seconds(F.col("arrival_time"))
    return texts.select(
        "row_no",
        seconds.alias("seconds"),
        gtfs_time_text(seconds).alias("text"),
        day_offset(seconds).alias("day_offset"),
        gtfs_seconds(F.col("departure_time")).alias("departure_seconds"),
    )


def _parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = gtfs_date(F.col("text"))
    return _asks(spark, sf_dir, "text_dates").select(
        "k",
        iso_date(date).alias("iso"),
        compact_date(date).alias("compact"),
        service_weekday(date).alias("weekday"),
    )


def _unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _asks(spark, sf_dir, "text_stop_times").withColumns(
        {name: F.lit(None).cast("string") for name in ("stop_headsign", "drop_off_type", "timepoint")}
    )
    return unreadable_values(texts, "stop_times")


def _feed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_counts(dict(bench_feed(spark, sf_dir).files()))


def _dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.dangling_references(load.normalize_feed(faulty_feed(spark, sf_dir)))


def _active_on(timetable: Timetable, dates: DataFrame) -> DataFrame:
    return _dated(calendar.service_active_on(timetable, dates))


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("service_date", iso_date(F.col("service_date")))


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = given_sql(
        spark,
        sf_dir,
        "SELECT 'schedule_version' AS key, 'v' || count(*) AS value FROM {orders} "
        "UNION ALL SELECT 'imported_at_unix', CAST(count(*) AS STRING) FROM {lineitem}",
    )
    return schedule_metadata(entries, bench_timetable(spark, sf_dir).feed_info)


def _missing_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    timetable = bench_timetable(spark, sf_dir)
    return requests.missing_keys(_asks(spark, sf_dir, "stops"), timetable.stops, "stop_id")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validation_report(validation.validate(validation.staged(faulty_feed(spark, sf_dir)))).drop(
        "message"
    )


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.issue_counts(validation.validate(validation.staged(faulty_feed(spark, sf_dir))))


THIN_TARGET = 5
DETAIL_PART = 4
PAGE = 4
BOARD_SIZE = 3

QUERIES: dict[str, Query] = {
    "departures": _answers(stops.departures, "departures"),
    "departure_board": _answers(
        lambda t, dates: stops.departure_board(t, dates, BOARD_SIZE), "dates"
    ),
    "service_active_on": _answers(_active_on, "dates"),
    "service_dates": _tables(lambda t: _dated(calendar.service_dates(t))),
    "lookup_stops": _answers(stops.lookup_stops, "stops"),
    "missing_stops": _missing_stops,
    "search_stops": _answers(search.search_stops, "stop_search", lambda df: _rounded(df, 6, "score")),
    "nearby_stops": _answers(
        spatial.nearby_stops, "nearby", lambda df: _rounded(df, 3, "distance_m")
    ),
    "stops_in_rect": _answers(spatial.stops_in_rect, "rects"),
    "stop_routes": _answers(stops.stop_routes, "stop_routes"),
    "stop_trips": _answers(stops.stop_trips, "stop_trips"),
    "lookup_routes": _answers(routes.lookup_routes, "routes"),
    "search_routes": _answers(routes.search_routes, "route_search"),
    "route_trips": _answers(routes.route_trips, "route_trips"),
    "route_shapes": _answers(routes.route_shapes, "routes"),
    "routes_page": _answers(lambda t, r: routes.routes_page(t, r, PAGE), "routes_page"),
    "trips_page": _answers(lambda t, r: routes.trips_page(t, r, PAGE), "trips_page"),
    "lookup_trips": _answers(trips.lookup_trips, "trips"),
    "trip_calls": _answers(trips.trip_calls, "trips", _flat_calls),
    "trip_shape": _answers(trips.trip_shape, "trips"),
    "shape_points_of": _answers(trips.shape_points_of, "shapes"),
    "trip_sizes": _tables(lambda t: trips.trip_sizes(t, max_calls=8, max_points=14)),
    "trip_detail": _answers(
        lambda t, r: trips.trip_detail(
            t, r, DETAIL_PART, _calls_text, lambda shape: _joined(shape, _field("sequence"))
        ),
        "trips",
        _trip_detail_text,
    ),
    "shape_linestrings": _tables(
        lambda t: _linestring_text(trips.shape_linestrings(t, part_points=10))
    ),
    "trip_extent": _tables(
        lambda t: _rounded(
            trips.trip_extent(t),
            9,
            "min_lat",
            "min_lon",
            "max_lat",
            "max_lon",
            "center_lat",
            "center_lon",
        )
    ),
    "colocated_calls": _tables(trips.colocated_calls),
    "thin_shapes": _tables(lambda t: trips.thin_shapes(t, THIN_TARGET)),
    "stop_groups": _grouped(lambda t, g, m: _rounded(g, 9, *GROUP_NUMBERS)),
    "stop_group_members": _grouped(lambda t, g, m: m),
    "stop_groups_in_rect": _stop_groups_in_rect,
    "group_member_routes": _grouped(lambda t, g, m: groups.group_member_routes(t, m, whole=True)),
    "group_routes": _grouped(lambda t, g, m: groups.group_routes(t, m, whole=True)),
    "group_agencies": _grouped(lambda t, g, m: groups.group_agencies(t, m, whole=True)),
    "stop_group_details": _stop_group_details,
    "feed_counts": _feed_counts,
    "feed_file_issues": lambda spark, sf_dir: feed_file_issues(
        _asks(spark, sf_dir, "manifest"), max_files=64, max_bytes=2 * 1024**3
    ),
    "unreadable_records": _unreadable,
    "dangling_references": _dangling,
    "parse_times": _parse_times,
    "parse_dates": _parse_dates,
    "schedule_metadata": _metadata,
    "request_issues_departures": _issues_of("text_departures", "departures"),
    "request_issues_nearby": _issues_of("odd_nearby", "nearby_stops"),
    "request_issues_rect": _issues_of("odd_rects", "stops_in_rect"),
    "request_issues_route_search": _issues_of("route_search", "search_routes"),
    **{
        f"normalize_{table}": _normalized(table)
        for table in Timetable.table_names()
    },
    **{f"validate_{family}": _validated(family) for family in validation.RULE_FAMILIES},
    "validation_counts": _counts,
    "validation_report": _report,
}


