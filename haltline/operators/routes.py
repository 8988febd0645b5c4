"""Route lookups, route search and pages of routes and trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haltline.functions import iso_date
from haltline.operators.indexes import rows_of_keys, trips_behind
from haltline.operators.ranking import first_per_group, rank_by_range, with_limits
from haltline.operators.requests import valid_requests
from haltline.operators.stops import first_running_trips
from haltline.schema import ROUTE_COLUMNS, TRIP_COLUMNS, Timetable

PAGE_SIZE = 100
GRAM = 3


def lookup_routes(timetable: Timetable, requests: DataFrame) -> DataFrame:
    return requests.select("request_id", "route_id").join(
        timetable.routes.select(*ROUTE_COLUMNS), "route_id"
    )


def _substrings(text: Column, size: Column) -> Column:
    """All substrings of `size` characters; none for a shorter text."""
    return F.when(
        F.length(text) >= size,
        F.transform(
            F.sequence(F.lit(1), F.length(text) - size + 1),
            lambda start: F.substring(text, start, size),
        ),
    ).otherwise(F.array().cast("array<string>"))


def _grams(text: Column) -> Column:
    """Distinct substrings of one, two and three characters."""
    sizes = [_substrings(text, F.lit(size)) for size in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(*sizes))


def _searchable(routes: DataFrame) -> DataFrame:
    """(route_id, text): lower-case id, short and long name."""
    return routes.select(
        "route_id",
        F.explode(
            F.array_distinct(
                F.array_compact(
                    F.array(F.lower("route_id"), F.lower("short_name"), F.lower("long_name"))
                )
            )
        ).alias("text"),
    )


def routes_containing(timetable: Timetable, queries: DataFrame) -> DataFrame:
    """(needle, route_id) for every distinct lower-case `needle` found in a route.

    Needles meet routes on equal substrings of up to three characters, the rarest one the needle
    has, and only then is the whole needle looked for. No query is compared with every route.
    """
    needles = queries.select("needle").filter(F.col("needle") != "").distinct()
    texts = _searchable(timetable.routes)
    route_grams = texts.withColumn("gram", F.explode(_grams(F.col("text"))))
    frequency = route_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    size = F.least(F.length("needle"), F.lit(GRAM))
    needle_grams = needles.withColumn("gram", F.explode(_substrings(F.col("needle"), size)))
    rarest = (
        needle_grams.join(frequency, "gram", "left")
        .groupBy("needle")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("key"))
        .filter(F.col("key.df") > 0)
        .select("needle", F.col("key.gram").alias("gram"))
    )
    return (
        rarest.join(route_grams, "gram")
        .filter(F.contains("text", "needle"))
        .select("needle", "route_id")
        .distinct()
    )


def search_routes(timetable: Timetable, requests: DataFrame) -> DataFrame:
    """requests(request_id, query, limit): case-insensitive substring of id or names.

    An exact short name comes first, then short name, long name and id, NULLs first.
    """
    requests, largest = with_limits(valid_requests(requests, "search_routes"))
    asked = requests.withColumn("needle", F.lower(F.trim("query")))
    found = routes_containing(timetable, asked).join(
        timetable.routes.select(*ROUTE_COLUMNS), "route_id"
    )
    best = first_per_group(
        found,
        ["needle"],
        [
            F.when(F.lower("short_name") == F.col("needle"), 0).otherwise(1),
            F.col("short_name").asc_nulls_first(),
            F.col("long_name").asc_nulls_first(),
            "route_id",
        ],
        largest,
    )
    return (
        asked.join(best, "needle")
        .filter(F.col("rank") <= F.col("limit"))
        .select("request_id", "rank", *ROUTE_COLUMNS)
    )


def route_trips(timetable: Timetable, requests: DataFrame) -> DataFrame:
    """requests(request_id, route_id, service_date, limit) to the trips running that day."""
    requests, largest = with_limits(valid_requests(requests, "route_trips"))
    day = ["route_id", "service_date"]
    asked = requests.groupBy(*day).agg(F.max("limit").alias("limit"))
    trips = timetable.trips.select("route_id", "trip_id", "service_id").join(
        asked.select("route_id").distinct(), "route_id", "left_semi"
    )
    best = first_running_trips(timetable, trips, asked, "route_id", largest)
    return (
        requests.join(best, day)
        .filter(F.col("rank") <= F.col("limit"))
        .join(timetable.trips.drop("route_id"), "trip_id")
        .select(
            "request_id", iso_date(F.col("service_date")).alias("service_date"), *TRIP_COLUMNS
        )
    )


def route_shapes(
    timetable: Timetable, requests: DataFrame, limit: int | None = None
) -> DataFrame:
    """requests(request_id, route_id): shapes of the route, the most used first; all without a `limit`."""
    counted = (
        timetable.trips.filter(F.col("shape_id").isNotNull())
        .join(requests.select("route_id").distinct(), "route_id", "left_semi")
        .groupBy("route_id", "shape_id")
        .agg(F.count(F.lit(1)).alias("trip_count"))
    )
    by_use = Window.partitionBy("route_id").orderBy(F.desc("trip_count"), "shape_id")
    best = counted.withColumn("rank", F.row_number().over(by_use))
    if limit is not None:
        best = best.filter(F.col("rank") <= limit)
    return requests.select("request_id", "route_id").join(best, "route_id").select(
        "request_id", "route_id", "rank", "shape_id", "trip_count"
    )


def _pages(
    rows: DataFrame, requests: DataFrame, group: list[str], key: str, page_size: int
) -> DataFrame:
    """The next `page_size` keys behind each request's `after_key`, and whether more follow.

    Rows and the places requests continue from are ranked together; a request then picks its
    ranks by equality, so no request is compared with a whole group.
    """
    marks = (
        requests.select(*group, F.col("after_key").alias(key))
        .distinct()
        .withColumn("weight", F.lit(0))
    )
    everything = (
        rows.select(*group, key).withColumn("weight", F.lit(1)).unionByName(marks)
    )
    # Descending weight puts a mark behind the row with the same key.
    ranked = rank_by_range(
        everything, group, [F.col(key), F.col("weight").desc()], F.col("weight")
    )
    places = ranked.filter("weight = 0").select(
        *group, F.col(key).alias("after_key"), F.col("rank").alias("place")
    )
    wanted = requests.join(places, [*group, "after_key"]).select(
        "request_id",
        *group,
        F.posexplode(
            F.sequence(F.col("place") + 1, F.col("place") + F.lit(page_size + 1))
        ).alias("nth", "rank"),
    )
    one_page = Window.partitionBy("request_id")
    return (
        wanted.join(ranked.filter("weight = 1").drop("weight"), [*group, "rank"])
        .withColumn("has_more", F.max("nth").over(one_page) >= page_size)
        .filter(F.col("nth") < page_size)
        .withColumn("position", F.col("nth") + 1)
        .drop("nth", "rank")
    )


def routes_page(
    timetable: Timetable, requests: DataFrame, page_size: int = PAGE_SIZE
) -> DataFrame:
    """requests(request_id, query, after_key): one page of routes by id, filtered as in search.

    A blank query takes all routes; `after_key` is the last id of the page before, or ''.
    """
    asked = requests.withColumn("needle", F.lower("query"))
    blank = asked.filter(F.col("needle") == "").select("needle").distinct()
    rows = routes_containing(timetable, asked).unionByName(
        timetable.routes.select(F.lit("").alias("needle"), "route_id").join(
            blank, "needle", "left_semi"
        )
    )
    pages = _pages(rows, asked, ["needle"], "route_id", page_size)
    return pages.join(timetable.routes, "route_id").select(
        "request_id", "position", "has_more", *ROUTE_COLUMNS
    )


def trips_page(
    timetable: Timetable, requests: DataFrame, page_size: int = PAGE_SIZE
) -> DataFrame:
    """requests(request_id, route_id, after_key): one page of a route's trips by id.

    A published version knows where each range of a route's trips starts, so only the ranges a page touches are read.
    """
    if "trip_ranges" in timetable.indexes:
        found = trips_behind(timetable, requests, page_size + 1)
        more = F.max("nth").over(Window.partitionBy("request_id")) > page_size
        pages = found.withColumn("has_more", more).filter(F.col("nth") <= page_size)
        trips = rows_of_keys(timetable.trips, "route_id", requests).drop("route_id")
        return pages.join(trips, "trip_id").select(
            "request_id", F.col("nth").alias("position"), "has_more", *TRIP_COLUMNS
        )
    rows = timetable.trips.select("route_id", "trip_id").join(
        requests.select("route_id").distinct(), "route_id", "left_semi"
    )
    pages = _pages(rows, requests, ["route_id"], "trip_id", page_size)
    return pages.join(timetable.trips.drop("route_id"), "trip_id").select(
        "request_id", "position", "has_more", *TRIP_COLUMNS
    )
