"""Feed validation: every broken rule becomes one row (code, record, message).

Rules that look at one record only run in a single pass per file. Repeated keys and unknown
references are found on keys reduced before the shuffle; the records behind them are fetched
afterwards, which costs nothing in a clean feed because the list of bad keys is empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haltline.functions import within_degrees
from haltline.schema import WEEKDAYS, Feed
from haltline.session import cut_lineage, keep_table, side_by_side

REPORT_CAP = 100
ROWS_PER_CHUNK_BITS = 20
#: A group of more records than this is read in chunks of the file. Groups are counted in so many buckets.
LONG_GROUP, GROUP_BUCKETS = 1 << 20, 1 << 16
STATION, PLATFORM = 1, 0


def _issue(code: str, record: Column | str, message: str) -> Column:
    record = F.lit(record) if isinstance(record, str) else record
    return F.struct(
        F.lit(code).alias("code"), record.alias("record"), F.lit(message).alias("message")
    )


def _per_record(rows: DataFrame, rules: Sequence[tuple[Column, Column]]) -> DataFrame:
    """One pass over `rows`: every (condition, issue) that holds, as rows."""
    found = F.array_compact(F.array(*(F.when(broken, issue) for broken, issue in rules)))
    return rows.select(F.explode(found).alias("issue")).select("issue.*")


def _as_issues(rows: DataFrame, code: str, record: Column, message: str) -> DataFrame:
    return rows.select(_issue(code, record, message).alias("issue")).select("issue.*")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _first_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.min("row_no").alias("first_row"), F.count(F.lit(1)).alias("copies")
    )


def _repeats(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Second and later records of a key. A key repeated without end is never sorted."""
    repeated = _first_rows(rows, keys).filter(F.col("copies") > 1).select(*keys, "first_row")
    return rows.join(repeated, list(keys)).filter(F.col("row_no") != F.col("first_row"))


def _unknown(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Records whose `column` is not a `key` of `known`."""
    bad = (
        rows.select(F.col(column).alias("bad_key"))
        .distinct()
        .join(known.select(F.col(key).alias("bad_key")).distinct(), "bad_key", "left_anti")
    )
    return rows.join(bad.withColumnRenamed("bad_key", column), column, "left_semi")


def _unknown_references(
    rows: DataFrame, references: Sequence[tuple[str, DataFrame, str]], optional: Sequence[str] = ()
) -> DataFrame:
    """Records with a column `no_<column>` for each reference, true where the column holds no key of its table.

    A reference is (column, owners, key); blank values of `optional` columns are none. All columns, and all keys, are
    reduced to distinct values before a shuffle. What is left after the anti-join are the bad values only; they are
    written, so that their true size decides how the records meet them. For a clean feed the records themselves
    are never shuffled, and one pass over them lists these issues and all others of single records.
    """

    def value(column: str) -> Column:
        return F.nullif(F.col(column), F.lit("")) if column in optional else F.col(column)

    pairs = F.explode(
        F.array(
            *(
                F.struct(F.lit(column).alias("column"), value(column).alias("value"))
                for column, *_ in references
            )
        )
    )
    values = rows.select(pairs.alias("p")).select("p.*").distinct()
    known = _union(
        [
            owners.select(F.lit(column).alias("column"), F.col(key).alias("value")).distinct()
            for column, owners, key in references
        ]
    )
    bad = keep_table(values.join(known, ["column", "value"], "left_anti").filter(F.col("value").isNotNull()))
    for column, *_ in references:
        own = bad.filter(F.col("column") == column)
        own = own.select(F.col("value").alias(column), F.lit(True).alias(f"no_{column}"))
        rows = rows.join(own, column, "left")
    return rows


def _not_increasing(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Records whose `value` is not above the one before it in file order of the group.

    Groups are counted in buckets of their hash, which shuffles next to nothing. Where a bucket holds few records
    for a group of `LONG_GROUP`, its groups are read in order, in one shuffle; other buckets, of which
    there are fewer than records by `LONG_GROUP`, may hold a long group and are read in chunks.
    """
    bucket = F.pmod(F.xxhash64(group), F.lit(GROUP_BUCKETS))
    counted = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    long = [row.bucket for row in counted.filter(F.col("n") > LONG_GROUP).select("bucket").collect()]
    in_order = Window.partitionBy(group).orderBy("row_no")
    falls = F.col(value) <= F.col("previous")
    if not long:
        return rows.withColumn("previous", F.lag(value).over(in_order)).filter(falls)
    short = rows.filter(~bucket.isin(long)).withColumn("previous", F.lag(value).over(in_order)).filter(falls)
    return short.drop("previous").unionByName(_not_increasing_by_chunk(rows.filter(bucket.isin(long)), group, value))


def _not_increasing_by_chunk(rows: DataFrame, group: str, value: str) -> DataFrame:
    """As `_not_increasing` for groups of any length.

    Records are compared inside chunks of the file; the last value of each chunk is carried to
    the next chunk of the group, so even a single group spanning the file is spread out.
    """
    chunked = rows.withColumn("chunk", F.shiftright("row_no", ROWS_PER_CHUNK_BITS))
    here = Window.partitionBy(group, "chunk").orderBy("row_no")
    across = Window.partitionBy(group).orderBy("chunk")
    carried = (
        chunked.groupBy(group, "chunk")
        .agg(F.max_by(value, "row_no").alias("last"))
        .withColumn("carried", F.lag("last").over(across))
        .filter(F.col("carried").isNotNull())
        .select(group, "chunk", "carried")
    )
    return (
        chunked.withColumn("previous", F.lag(value).over(here))
        .join(carried, [group, "chunk"], "left")
        .filter(F.col(value) <= F.coalesce("previous", "carried"))
        .select(*rows.columns)
    )


def _blank(*columns: str) -> Column:
    condition = F.lit(False)
    for column in columns:
        condition |= F.col(column) == ""
    return condition


def frequencies_issues(feed: Feed) -> DataFrame:
    return _as_issues(
        feed.frequencies.limit(1),
        "unsupported_frequencies",
        F.lit("frequencies.txt"),
        "service by frequency cannot be imported",
    )


def feed_info_issues(feed: Feed) -> DataFrame:
    record = F.lit("feed_info.txt")
    rows = feed.feed_info
    too_many = rows.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return _union(
        [
            _per_record(
                rows,
                [
                    (
                        _blank("feed_publisher_name", "feed_publisher_url", "feed_lang"),
                        _issue(
                            "incomplete_feed_info", record, "publisher name, url and language needed"
                        ),
                    ),
                    (
                        F.col("feed_start_date") > F.col("feed_end_date"),
                        _issue("invalid_feed_date_range", record, "start date behind end date"),
                    ),
                ],
            ),
            _as_issues(
                too_many, "multiple_feed_info_records", record, "only one record is allowed"
            ),
        ]
    )


def agency_issues(feed: Feed) -> DataFrame:
    rows = feed.agency
    ids = rows.agg(
        F.countDistinct("agency_id").alias("ids"),
        F.coalesce(F.max(F.col("agency_id") == ""), F.lit(False)).alias("has_blank"),
    )
    file = F.lit("agency.txt")
    return _union(
        [
            _per_record(
                rows,
                [
                    (
                        _blank("agency_name", "agency_url", "agency_timezone"),
                        _issue(
                            "incomplete_agency",
                            F.col("agency_id"),
                            "name, url and time zone needed",
                        ),
                    )
                ],
            ),
            _as_issues(
                _repeats(rows, ["agency_id"]),
                "duplicate_agency",
                F.col("agency_id"),
                "agency_id used before",
            ),
            _per_record(
                ids,
                [
                    (
                        F.col("ids") == 0,
                        _issue("missing_agency", file, "the feed names no agency"),
                    ),
                    (
                        (F.col("ids") > 1) & F.col("has_blank"),
                        _issue("missing_agency_id", file, "several agencies, one without id"),
                    ),
                ],
            ),
        ]
    )


def stop_issues(feed: Feed) -> DataFrame:
    rows = feed.stops
    stop = F.col("stop_id")
    lat, lon = F.col("stop_lat"), F.col("stop_lon")
    return _union(
        [
            _per_record(
                rows,
                [
                    (stop == "", _issue("missing_stop_id", "stops.txt", "stop_id is blank")),
                    (
                        lat.isNotNull() & lon.isNotNull() & ~within_degrees(lat, lon),
                        _issue("invalid_coordinates", stop, "position outside WGS84"),
                    ),
                    (
                        lat.isNull() != lon.isNull(),
                        _issue("incomplete_coordinates", stop, "only one of latitude, longitude"),
                    ),
                ],
            ),
            _as_issues(
                _repeats(rows, ["stop_id"]), "duplicate_stop", stop, "stop_id used before"
            ),
        ]
    )


def first_stops(feed: Feed) -> DataFrame:
    """(stop_id, location_type, parent_station) of the first record of each stop id."""
    first = F.min_by(
        F.struct(
            F.coalesce("location_type", F.lit(0)).alias("location_type"), "parent_station"
        ),
        "row_no",
    )
    return feed.stops.groupBy("stop_id").agg(first.alias("s")).select("stop_id", "s.*")


def stop_hierarchy_issues(feed: Feed) -> DataFrame:
    stops = first_stops(feed)
    stop, kind, parent = F.col("stop_id"), F.col("location_type"), F.col("parent_station")
    needs_parent = kind.isin(2, 3, 4)
    has_parent = (kind <= 4) & (kind != STATION) & (parent != "")
    own = _per_record(
        stops,
        [
            (kind > 4, _issue("invalid_location_type", stop, "location_type above 4")),
            (
                (kind == STATION) & (parent != ""),
                _issue("unexpected_parent_station", stop, "a station has a parent"),
            ),
            (
                needs_parent & (parent == ""),
                _issue("missing_parent_station", stop, "this kind of stop needs a parent"),
            ),
            (
                has_parent & (parent == stop),
                _issue("self_parent_station", stop, "the stop is its own parent"),
            ),
        ],
    )
    children = stops.filter(has_parent & (parent != stop))
    unknown = _as_issues(
        _unknown(children, "parent_station", stops, "stop_id"),
        "unknown_parent_station",
        stop,
        "the parent does not exist",
    )
    kinds = stops.select(
        F.col("stop_id").alias("parent_station"), F.col("location_type").alias("parent_kind")
    )
    expected = F.when(kind == 4, PLATFORM).otherwise(STATION)
    wrong = _as_issues(
        children.join(kinds, "parent_station").filter(F.col("parent_kind") != expected),
        "invalid_parent_location_type",
        stop,
        "the parent is of the wrong kind",
    )
    return _union([own, unknown, wrong])


def route_issues(feed: Feed) -> DataFrame:
    rows = feed.routes
    route = F.col("route_id")
    agencies = feed.agency.agg(F.countDistinct("agency_id")).scalar()
    named = rows.filter(F.col("agency_id") != "")
    return _union(
        [
            _per_record(
                rows,
                [
                    (route == "", _issue("missing_route_id", "routes.txt", "route_id is blank")),
                    (
                        (F.col("route_short_name") == "") & (F.col("route_long_name") == ""),
                        _issue("missing_route_name", route, "short or long name needed"),
                    ),
                    (
                        (F.col("agency_id") == "") & (agencies != 1),
                        _issue("missing_route_agency", route, "several agencies, none chosen"),
                    ),
                ],
            ),
            _as_issues(
                _repeats(rows, ["route_id"]), "duplicate_route", route, "route_id used before"
            ),
            _as_issues(
                _unknown(named, "agency_id", feed.agency, "agency_id"),
                "unknown_agency",
                route,
                "the agency does not exist",
            ),
        ]
    )


def calendar_issues(feed: Feed) -> DataFrame:
    rows = feed.calendar
    service = F.col("service_id")
    return _union(
        [
            _per_record(
                rows,
                [
                    (
                        F.greatest(*WEEKDAYS) > 1,
                        _issue("invalid_calendar_weekday", service, "weekday flag above 1"),
                    ),
                    (
                        F.col("start_date") > F.col("end_date"),
                        _issue("invalid_calendar_range", service, "start date behind end date"),
                    ),
                ],
            ),
            _as_issues(
                _repeats(rows, ["service_id"]),
                "duplicate_calendar",
                service,
                "service_id used before",
            ),
        ]
    )


def calendar_date_issues(feed: Feed) -> DataFrame:
    rows = feed.calendar_dates
    record = F.concat_ws(":", "service_id", F.date_format("date", "yyyy-MM-dd"))
    return _union(
        [
            _per_record(
                rows,
                [
                    (
                        ~F.col("exception_type").isin(1, 2),
                        _issue("invalid_exception_type", record, "neither 1 nor 2"),
                    )
                ],
            ),
            _as_issues(
                _repeats(rows, ["service_id", "date"]),
                "duplicate_calendar_date",
                record,
                "service and date used before",
            ),
        ]
    )


def shape_issues(feed: Feed) -> DataFrame:
    rows = feed.shapes
    record = F.concat_ws(":", "shape_id", F.col("shape_pt_sequence").cast("string"))
    distance = F.col("shape_dist_traveled")
    return _union(
        [
            _per_record(
                rows,
                [
                    (
                        ~within_degrees(F.col("shape_pt_lat"), F.col("shape_pt_lon")),
                        _issue("invalid_shape_coordinates", record, "position outside WGS84"),
                    ),
                    (
                        ~distance.between(0.0, 1.7976931348623157e308),
                        _issue("invalid_shape_distance", record, "distance negative or infinite"),
                    ),
                ],
            ),
            _as_issues(
                _not_increasing(rows, "shape_id", "shape_pt_sequence"),
                "non_increasing_shape_sequence",
                record,
                "sequence does not rise",
            ),
        ]
    )


def trip_issues(feed: Feed) -> DataFrame:
    rows = feed.trips
    trip = F.col("trip_id")
    services = feed.calendar.select("service_id").unionByName(
        feed.calendar_dates.select("service_id")
    )
    checked = _unknown_references(
        rows,
        [
            ("route_id", feed.routes, "route_id"),
            ("service_id", services, "service_id"),
            ("shape_id", feed.shapes, "shape_id"),
        ],
        optional=["shape_id"],
    )
    return _union(
        [
            _per_record(
                checked,
                [
                    (F.col("no_route_id"), _issue("unknown_route", trip, "the route does not exist")),
                    (F.col("no_service_id"), _issue("unknown_service", trip, "the service does not exist")),
                    (F.col("no_shape_id"), _issue("unknown_shape", trip, "the shape does not exist")),
                    (
                        _blank("trip_id", "route_id", "service_id"),
                        _issue("incomplete_trip", trip, "trip, route and service needed"),
                    ),
                    (
                        F.col("direction_id") > 1,
                        _issue("invalid_direction_id", trip, "direction above 1"),
                    ),
                ],
            ),
            _as_issues(
                _repeats(rows, ["trip_id"]), "duplicate_trip", trip, "trip_id used before"
            ),
        ]
    )


# Fixed value: the order of the ids in a transfer's record text.
TRANSFER_KEY = (
    "from_stop_id",
    "to_stop_id",
    "from_trip_id",
    "to_trip_id",
    "from_route_id",
    "to_route_id",
)


def _transfer_ends(rows: DataFrame) -> DataFrame:
    """Each transfer twice, once per end, with the ids of that end."""
    ends = F.explode(
        F.array(
            *(
                F.struct(
                    F.col(f"{end}_stop_id").alias("stop_id"),
                    F.col(f"{end}_trip_id").alias("trip_id"),
                    F.col(f"{end}_route_id").alias("route_id"),
                )
                for end in ("from", "to")
            )
        )
    )
    return rows.select("record", "transfer_type", ends.alias("end")).select(
        "record", "transfer_type", "end.*"
    )


def transfer_issues(feed: Feed) -> DataFrame:
    rows = feed.transfers.withColumn("record", F.concat_ws(":", *TRANSFER_KEY))
    record, kind = F.col("record"), F.col("transfer_type")
    own = _per_record(
        rows,
        [
            (kind > 5, _issue("invalid_transfer_type", record, "transfer_type above 5")),
            (
                (kind <= 3) & _blank("from_stop_id", "to_stop_id"),
                _issue("missing_transfer_stop", record, "types 0 to 3 need both stops"),
            ),
            (
                kind.isin(4, 5) & _blank("from_trip_id", "to_trip_id"),
                _issue("missing_linked_trip", record, "types 4 and 5 need both trips"),
            ),
            (
                (kind == 2) & F.col("min_transfer_time").isNull(),
                _issue("missing_transfer_time", record, "type 2 needs a minimum time"),
            ),
        ],
    )
    ends = _transfer_ends(rows)
    at_stop = ends.filter(F.col("stop_id") != "")
    on_route = ends.filter(F.col("route_id") != "")
    on_trip = ends.filter(F.col("trip_id") != "")
    stop_kinds = first_stops(feed).select("stop_id", "location_type")
    allowed = F.when(kind.isin(4, 5), F.col("location_type") == PLATFORM).otherwise(
        F.col("location_type").isin(PLATFORM, STATION)
    )
    trip_routes = feed.trips.groupBy("trip_id").agg(
        F.min_by("route_id", "row_no").alias("actual_route")
    )
    return _union(
        [
            own,
            _as_issues(
                _repeats(rows, TRANSFER_KEY), "duplicate_transfer", record, "same ids before"
            ),
            _as_issues(
                _unknown(at_stop, "stop_id", feed.stops, "stop_id"),
                "unknown_transfer_stop",
                record,
                "a stop does not exist",
            ),
            _as_issues(
                at_stop.join(stop_kinds, "stop_id").filter(~allowed),
                "invalid_transfer_stop_type",
                record,
                "a stop is of the wrong kind",
            ),
            _as_issues(
                _unknown(on_route, "route_id", feed.routes, "route_id"),
                "unknown_transfer_route",
                record,
                "a route does not exist",
            ),
            _as_issues(
                _unknown(on_trip, "trip_id", feed.trips, "trip_id"),
                "unknown_transfer_trip",
                record,
                "a trip does not exist",
            ),
            _as_issues(
                on_trip.filter(F.col("route_id") != "")
                .join(trip_routes, "trip_id")
                .filter(F.col("route_id") != F.col("actual_route")),
                "transfer_trip_route_mismatch",
                record,
                "a trip belongs to another route",
            ),
        ]
    )


# Largest value of each enumeration in stop_times.
STOP_TIME_ENUMS = {"pickup_type": 3, "drop_off_type": 3, "timepoint": 1}


def stop_time_issues(feed: Feed) -> DataFrame:
    rows = feed.stop_times
    record = F.concat_ws(":", "trip_id", F.col("stop_sequence").cast("string"))
    checked = _unknown_references(
        rows, [("trip_id", feed.trips, "trip_id"), ("stop_id", feed.stops, "stop_id")]
    )
    return _union(
        [
            _per_record(
                checked,
                [
                    (F.col("no_trip_id"), _issue("unknown_trip", record, "the trip does not exist")),
                    (F.col("no_stop_id"), _issue("unknown_stop", record, "the stop does not exist")),
                    (
                        _blank("trip_id", "stop_id"),
                        _issue("incomplete_stop_time", record, "trip and stop needed"),
                    ),
                    *(
                        (
                            F.col(field) > maximum,
                            _issue(
                                "invalid_stop_time_enum", record, f"{field} above {maximum}"
                            ),
                        )
                        for field, maximum in STOP_TIME_ENUMS.items()
                    ),
                ],
            ),
            _as_issues(
                _not_increasing(rows, "trip_id", "stop_sequence"),
                "non_increasing_stop_sequence",
                record,
                "sequence does not rise",
            ),
        ]
    )


RULE_FAMILIES = {
    "frequencies": frequencies_issues,
    "feed_info": feed_info_issues,
    "agency": agency_issues,
    "stops": stop_issues,
    "stop_hierarchy": stop_hierarchy_issues,
    "routes": route_issues,
    "calendar": calendar_issues,
    "calendar_dates": calendar_date_issues,
    "shapes": shape_issues,
    "trips": trip_issues,
    "transfers": transfer_issues,
    "stop_times": stop_time_issues,
}


def staged(feed: Feed) -> Feed:
    """The typed records written once, so that no rule reads and parses the files again."""
    names = list(Feed.__dataclass_fields__)
    kept = side_by_side([partial(keep_table, getattr(feed, name)) for name in names])
    return Feed(**dict(zip(names, kept, strict=True)))


def validate(feed: Feed) -> DataFrame:
    """All issues of the feed. The feed is valid when there are none.

    Rules read a file several times; pass a `staged` feed if its files are costly to parse.
    """
    # Some rules write the bad keys they find before their issues can be listed.
    return _union(side_by_side([partial(family, feed) for family in RULE_FAMILIES.values()]))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def validation_report(issues: DataFrame, cap: int = REPORT_CAP) -> DataFrame:
    """The first `cap` issues by code and record, each with how many were left out.

    The issues are written once, so that counting them does not validate the feed again.
    """
    issues = cut_lineage(issues)
    total = issues.agg(F.count(F.lit(1))).scalar()
    return (
        issues.orderBy("code", "record", "message")
        .limit(cap)
        .withColumn("omitted_issue_count", F.greatest(total - cap, F.lit(0)))
    )
