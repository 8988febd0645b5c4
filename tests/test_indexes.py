"""A published version answers requests for few keys from little of its data, and answers the same."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from haltline.operators import indexes
from haltline.operators.groups import group_routes
from haltline.operators.routes import trips_page
from haltline.operators.stops import stop_routes
from haltline.operators.trips import trip_calls, trip_detail
from haltline.sources.importing import import_feed
from haltline.sources.store import VersionStore
from tests.feeds import HARBOUR, write_feed

TRIPS, CALLS = 30_000, 6


@pytest.fixture(scope="module")
def timetables(spark, tmp_path_factory):
    """The published version of a feed with many trips, and the same without what is kept besides its tables."""
    folder = tmp_path_factory.mktemp("indexed")
    store = VersionStore(spark, f"{folder}/store")
    import_feed(spark, write_feed(folder / "feed", HARBOUR), store, "small")
    small = store.read("small")
    first = small.trips.limit(1)
    trips = first.crossJoin(spark.range(TRIPS)).withColumns(
        {
            "trip_id": F.format_string("t%06d", (F.col("id") * 7919) % TRIPS),
            "route_id": F.concat(F.lit("r"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).cast("string")),
        }
    )
    calls = small.stop_times.limit(1).crossJoin(spark.range(TRIPS * CALLS)).withColumns(
        {
            "trip_id": F.format_string("t%06d", F.col("id") % TRIPS),
            "stop_id": F.concat(F.lit("s"), (F.col("id") * 31 % 500).cast("string")),
            "stop_sequence": F.floor(F.col("id") / TRIPS),
            "departure_seconds": (F.col("id") * 7 % 86_400).cast("int"),
        }
    )
    stops = small.stops.limit(1).crossJoin(spark.range(500)).withColumn(
        "stop_id", F.concat(F.lit("s"), F.col("id").cast("string"))
    )
    routes = small.routes.limit(1).crossJoin(spark.range(40)).withColumn(
        "route_id", F.concat(F.lit("r"), F.col("id").cast("string"))
    )
    tables = dict(small.tables()) | {
        "trips": trips.drop("id"), "stop_times": calls.drop("id"), "stops": stops.drop("id"), "routes": routes.drop("id"),
    }
    store.publish("big", type(small).from_tables(tables))
    published = store.read("big")
    return published, type(small).from_tables(dict(published.tables()))


def scanned(df):
    """Rows that each table's scans gave, by name of the folder."""
    df.collect()
    rows: dict[str, int] = {}
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        elif name.startswith("Scan parquet"):
            table = node.relation().location().rootPaths().head().getName()
            rows[table] = rows.get(table, 0) + node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_calls_of_one_trip_are_read_from_few_pages(spark, timetables):
    published, plain = timetables
    asked = spark.createDataFrame([(1, "t012345"), (2, "none")], "request_id long, trip_id string")
    found = trip_calls(published, asked)
    assert rows_of(found) == rows_of(trip_calls(plain, asked)) and found.count() == CALLS
    read = scanned(found)
    assert CALLS <= read["calls_by_trip"] <= 40_000 and "stop_times" not in read
    assert rows_of(trip_detail(published, asked)) == rows_of(trip_detail(plain, asked))
    many = spark.range(3_000).select(F.col("id").alias("request_id"), F.format_string("t%06d", F.col("id") * 9).alias("trip_id"))
    assert trip_calls(published, many).count() == 3_000 * CALLS
    assert trip_calls(published, asked.limit(0)).count() == 0


def test_routes_of_a_group_need_no_calls(spark, timetables):
    published, plain = timetables
    members = spark.createDataFrame([("g", "s3"), ("g", "s4")], "group_id string, stop_id string")
    found = group_routes(published, members)
    assert rows_of(found) == rows_of(group_routes(plain, members)) and found.count() > 1
    read = scanned(found)
    assert read["stop_routes"] > 0 and not {"stop_times", "calls_by_trip"} & set(read)
    asked = spark.createDataFrame([(1, "s3", 4)], "request_id long, stop_id string, limit int")
    assert rows_of(stop_routes(published, asked)) == rows_of(stop_routes(plain, asked))


@pytest.mark.parametrize("range_keys", [None, 30])
def test_pages_read_the_ranges_they_touch(spark, timetables, monkeypatch, range_keys):
    published, plain = timetables
    if range_keys is not None:
        monkeypatch.setattr(indexes, "RANGE_KEYS", range_keys)
        made = indexes.build_indexes(plain)
        published = type(plain).from_tables(dict(plain.tables()), made)
    keys = ["", "t000000", "t014999", "t029800", "t029999", "zzz", "t0"]
    requests = spark.createDataFrame(
        [(10 * n + m, f"r{m}", key) for n, key in enumerate(keys) for m in (0, 1, 39, 77)],
        "request_id long, route_id string, after_key string",
    )
    for size in (5, 100):
        assert rows_of(trips_page(published, requests, size)) == rows_of(trips_page(plain, requests, size))
