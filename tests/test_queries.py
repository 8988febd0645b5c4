"""Operators on the small feeds, on brute-force samples, and batch against single requests."""

from __future__ import annotations

import datetime
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from haltline.operators import calendar, ranking, requests, routes, search, spatial, stops, trips
from haltline.operators.load import dangling_references, normalize_feed
from haltline.sources.feed import read_feed
from tests.feeds import HARBOUR, HILL, write_feed

STOPS = (
    "stop_id string, code string, name string, latitude double, longitude double,"
    " location_type int, parent_stop_id string, platform_code string"
)


def day(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text)


@pytest.fixture(scope="module")
def harbour_tables(spark, tmp_path_factory):
    folder = write_feed(tmp_path_factory.mktemp("harbour"), HARBOUR)
    return normalize_feed(read_feed(spark, folder))


@pytest.fixture(scope="module")
def hill_tables(spark, tmp_path_factory):
    exceptions = "service_id,date,exception_type\nmondays,20280515,2\nmondays,20280516,1\n"
    folder = write_feed(
        tmp_path_factory.mktemp("hill"),
        {**HILL, "calendar_dates": exceptions},
    )
    return normalize_feed(read_feed(spark, folder))


def departures(spark, tables, *asked):
    schema = "request_id int, stop_id string, service_date date, after int, limit int"
    rows = [(i, stop, day(date), after, 20) for i, (stop, date, after) in enumerate(asked)]
    return stops.departures(tables, spark.createDataFrame(rows, schema)).collect()


def test_departures_past_midnight(spark, harbour_tables):
    found = departures(
        spark,
        harbour_tables,
        ("kai-1", "2027-03-17", 0),
        ("kai-1", "2027-05-02", 89_000),
        ("kai-1", "2027-03-20", 89_520),
        ("kai-1", "2027-03-20", 89_521),
        ("kai", "2027-03-20", 0),
    )
    assert sorted((r.request_id, r.trip_id, r.scheduled_departure) for r in found) == [
        (1, "b-night", "24:52:00"),
        (2, "b-night", "24:52:00"),
    ]
    first = found[0]
    assert (first.route_id, first.route_short_name, first.headsign) == ("blue", "B", "Fyrtårnet")
    assert (first.pickup_type, first.drop_off_type, first.timepoint) == (0, 0, 1)


def test_calendar_ranges_weekdays_and_exceptions(spark, hill_tables):
    dates = ["2028-05-08", "2028-05-09", "2028-05-15", "2028-05-16", "2028-06-05"]
    asked = spark.createDataFrame([(day(d),) for d in dates], "service_date date")
    active = calendar.service_active_on(hill_tables, asked)
    assert {str(r.service_date) for r in active.collect()} == {"2028-05-08", "2028-05-16"}
    everything = {str(r.service_date) for r in calendar.service_dates(hill_tables).collect()}
    assert everything == {"2028-05-01", "2028-05-08", "2028-05-16", "2028-05-22", "2028-05-29"}
    found = departures(
        spark,
        hill_tables,
        ("summit", "2028-05-15", 0),
        ("summit", "2028-05-16", 96_000),
        ("summit", "2028-05-16", 96_061),
    )
    assert [(r.request_id, r.scheduled_departure_seconds) for r in found] == [(1, 96_060)]


def test_no_pickup_is_no_departure(spark, hill_tables):
    closed = replace(
        hill_tables, stop_times=hill_tables.stop_times.withColumn("pickup_type", F.lit(1))
    )
    assert departures(spark, closed, ("summit", "2028-05-16", 0)) == []


def test_a_batch_equals_single_requests(spark, harbour_tables):
    asked = [("kai-1", "2027-03-20", 0), ("tower", "2027-03-21", 80_000)]
    together = {(r.stop_id, r.service_date, r.trip_id) for r in departures(spark, harbour_tables, *asked)}
    apart = {
        (r.stop_id, r.service_date, r.trip_id)
        for one in asked
        for r in departures(spark, harbour_tables, one)
    }
    assert together == apart and len(together) == 2


def test_busy_stop_departures_against_brute_force(spark, hill_tables):
    rng = random.Random(7)
    rows = [
        (f"t{n % 400:03d}", "hub" if n % 3 else f"s{n % 5}", n, rng.randrange(0, 3000) * 10)
        for n in range(2000)
    ]
    calls = spark.createDataFrame(
        rows, "trip_id string, stop_id string, stop_sequence long, departure_seconds int"
    ).withColumns(
        {
            "arrival_seconds": F.col("departure_seconds"),
            "stop_headsign": F.lit(None).cast("string"),
            **{n: F.lit(None).cast("int") for n in ("pickup_type", "drop_off_type", "timepoint")},
        }
    )
    ids = spark.createDataFrame([(f"t{n:03d}",) for n in range(400)], "trip_id string")
    all_trips = ids.select(
        "trip_id",
        F.lit("rack").alias("route_id"),
        F.lit("mondays").alias("service_id"),
        *(F.lit(None).cast("string").alias(n) for n in ("headsign", "short_name")),
        F.lit(None).cast("int").alias("direction_id"),
        F.lit(None).cast("string").alias("shape_id"),
    )
    tables = replace(hill_tables, stop_times=calls, trips=all_trips)
    asked = [(i, "hub", day("2028-05-08"), i * 100, 1 + i % 7) for i in range(0, 300, 7)]
    schema = "request_id int, stop_id string, service_date date, after int, limit int"
    found = stops.departures(tables, spark.createDataFrame(asked, schema)).collect()
    got = sorted((r.request_id, r.scheduled_departure_seconds, r.trip_id, r.stop_sequence) for r in found)
    hub = sorted((d, t, s) for t, stop, s, d in rows if stop == "hub")
    expected = sorted(
        (i, *row) for i, _, _, after, k in asked for row in [h for h in hub if h[0] >= after][:k]
    )
    assert got == expected


def test_stop_routes_and_trips(spark, harbour_tables):
    asked = spark.createDataFrame([(1, "kai-1", 20)], "request_id int, stop_id string, limit int")
    assert [r.route_id for r in stops.stop_routes(harbour_tables, asked).collect()] == ["blue"]
    dated = asked.withColumn("service_date", F.lit("2027-05-02").cast("date"))
    removed = asked.withColumn("service_date", F.lit("2027-03-17").cast("date"))
    assert [r.trip_id for r in stops.stop_trips(harbour_tables, dated).collect()] == ["b-night"]
    assert stops.stop_trips(harbour_tables, removed).collect() == []


def test_trips_calls_shapes(spark, harbour_tables):
    asked = spark.createDataFrame([(1, "b-night"), (2, "none")], "request_id int, trip_id string")
    calls = trips.trip_calls(harbour_tables, asked).orderBy("stop_sequence").collect()
    assert [c.stop.platform_code for c in calls] == ["1", None]
    assert calls[0].scheduled_arrival == "24:50:00" and calls[0].pickup_type is None
    assert trips.trip_shape(harbour_tables, asked).count() == 4
    detail = trips.trip_detail(harbour_tables, asked).collect()
    assert len(detail) == 1
    assert [c.stop.stop_id for c in detail[0].calls] == ["kai-1", "tower"]
    assert [p.sequence for p in detail[0].shape] == [1, 5, 6, 9]
    parts = trips.trip_detail(harbour_tables, asked, part_rows=1).orderBy("part").collect()
    assert [(p.part, len(p.calls or []), len(p.shape or [])) for p in parts] == [
        (0, 1, 1), (1, 1, 1), (2, 0, 1), (3, 0, 1),
    ]
    line = trips.shape_linestrings(harbour_tables).first()
    assert line.wkt == "LINESTRING (14.5652 68.2312, 14.58 68.235, 14.59 68.238, 14.6 68.24)"
    extent = trips.trip_extent(harbour_tables).filter("trip_id = 'b-night'").first()
    assert (extent.min_lat, extent.max_lon) == (68.2312, 14.6)


def test_whole_shapes_and_thinning(spark, harbour_tables):
    points = spark.range(10_001).select(
        F.lit("big").alias("shape_id"),
        F.col("id").alias("sequence"),
        (F.col("id") / 1e4).alias("latitude"),
        F.lit(1.0).alias("longitude"),
        F.lit(None).cast("double").alias("distance_traveled"),
    )
    tables = replace(harbour_tables, shape_points=points)
    thin = trips.thin_shapes(tables, 2_000).orderBy("sequence").collect()
    assert [r.sequence for r in thin] == list(range(0, 10_001, 5))
    parts = trips.shape_linestrings(tables, part_points=4_000).orderBy("part").collect()
    assert [len(p.points) for p in parts] == [4_000, 4_000, 2_001]
    asked = spark.createDataFrame([(1, "big")], "request_id int, shape_id string")
    assert trips.shape_points_of(tables, asked).count() == 10_001


def test_route_search_order(spark, harbour_tables):
    table = spark.createDataFrame(
        [
            ("r1", "a", "18", "Zuid", 3, None, None),
            ("r2", "a", "8", "West", 3, None, None),
            ("r3", "a", None, "Lijn 8", 3, None, None),
            ("r8", "a", "x", "Oost", 3, None, None),
            ("r5", "a", "9", "Noord", 3, None, None),
        ],
        harbour_tables.routes.schema,
    )
    tables = replace(harbour_tables, routes=table)
    asked = spark.createDataFrame(
        [(1, " 8 ", 20), (2, "ZUID", 20), (3, "  ", 20), (4, "8", 1), (5, "lijn 8x", 5)],
        "request_id int, query string, limit int",
    )
    found = routes.search_routes(tables, asked).orderBy("request_id", "rank").collect()
    assert [(r.request_id, r.route_id) for r in found] == [
        (1, "r2"), (1, "r3"), (1, "r1"), (1, "r8"), (2, "r1"), (4, "r2"),
    ]


def test_pages_cover_everything_once(spark, harbour_tables):
    ids = [f"t{n:03d}" for n in range(57)]
    base = harbour_tables.trips.filter("trip_id = 'b-night'").drop("trip_id").withColumn("key", F.lit(1))
    many = spark.createDataFrame([(t, 1) for t in ids], "trip_id string, key int").join(base, "key")
    tables = replace(harbour_tables, trips=many.select(*harbour_tables.trips.columns))
    seen, after, more = [], "", True
    while more:
        asked = spark.createDataFrame(
            [(1, "blue", after)], "request_id int, route_id string, after_key string"
        )
        page = routes.trips_page(tables, asked, page_size=25).orderBy("position").collect()
        seen += [r.trip_id for r in page]
        after, more = page[-1].trip_id, page[0].has_more
    assert seen == ids


STOP_ROWS = [
    ("mk", "MK", "Moltke Kanal", 50.1000, 8.2000, 0, None, None),
    ("br", "BR", "Brunnen Gasse", 50.0900, 8.2100, 0, None, None),
    ("edge", None, "Far corner", 50.2090, 8.2000, 0, None, None),
    ("ile", "Q-77", "Île d'Or", None, None, None, None, None),
    ("mkn", "MN", "Moltke Neue Kanalbrücke", 50.1200, 8.1700, 1, None, None),
]


def with_stops(spark, tables, rows):
    return replace(tables, stops=spark.createDataFrame(rows, STOPS))


def test_stop_search(spark, harbour_tables):
    tables = with_stops(spark, harbour_tables, STOP_ROWS)
    asked = ["moltke kana", "ILE", "q-7", "gasse brun", "", "d'or ile", "moltke -", "77-q"]
    rows = [(i, q, 20) for i, q in enumerate(asked)]
    found = search.search_stops(
        tables, spark.createDataFrame(rows, "request_id int, query string, limit int")
    )
    got = {}
    for row in found.orderBy("request_id", "rank").collect():
        got.setdefault(asked[row.request_id], []).append(row.stop_id)
    assert got == {
        "moltke kana": ["mk", "mkn"],
        "ILE": ["ile"],
        "q-7": ["ile"],
        "gasse brun": ["br"],
        "d'or ile": ["ile"],
    }


def nearby(spark, tables, asked):
    schema = "request_id int, lat double, lon double, radius double, limit int"
    return spatial.nearby_stops(tables, spark.createDataFrame(asked, schema))


def test_nearby_order_and_corner(spark, harbour_tables):
    tables = with_stops(spark, harbour_tables, STOP_ROWS)
    found = nearby(spark, tables, [(1, 50.1, 8.2, 2000.0, 10), (2, 50.2, 8.186, 1300.0, 10)])
    got = [(r.request_id, r.stop_id) for r in found.orderBy("request_id", "rank").collect()]
    assert got == [(1, "mk"), (1, "br")]


def test_bad_requests_do_not_spoil_a_batch(spark, harbour_tables):
    tables = with_stops(spark, harbour_tables, STOP_ROWS)
    inf, nan = float("inf"), float("nan")
    asked = [(1, 50.1, 8.2, 100.0, None), (2, inf, 8.2, 100.0, 5), (3, 50.1, 8.2, 1e11, 5), (4, 50.1, nan, 9.0, 5)]
    asked += [(5, 50.1, 8.2, -1.0, 5), (6, 50.1, 8.2, 100.0, 0), (7, 50.1, 8.2, None, 5), (8, 0.0, 0.0, 2e7, 5)]
    got = {r.request_id for r in nearby(spark, tables, asked).collect()}
    assert got == {1, 8}
    schema = "request_id int, min_lat double, min_lon double, max_lat double, max_lon double, limit int"
    boxes = [(1, -90.0, -180.0, 90.0, 180.0, None), (2, -inf, 0.0, 1.0, 1.0, 5), (3, 60.0, 0.0, 50.0, 9.0, 5)]
    found = spatial.stops_in_rect(tables, spark.createDataFrame(boxes, schema)).collect()
    assert {r.request_id for r in found} == {1} and len(found) == 4


def test_limits_are_not_cut(spark, harbour_tables):
    rows = [(f"s{n:04d}", None, "x", 10.0, 10.0 + n / 1e5, 0, None, None) for n in range(1300)]
    tables = with_stops(spark, harbour_tables, rows)
    asked = [(1, 10.0, 10.0, 5000.0, 150), (2, 10.0, 10.0, 5000.0, 1200), (3, 10.0, 10.0, 5000.0, None)]
    counts = {}
    for row in nearby(spark, tables, asked).collect():
        counts[row.request_id] = counts.get(row.request_id, 0) + 1
    assert counts == {1: 150, 2: 1200, 3: 20}


def metres(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(math.sqrt(h))


def test_nearby_against_brute_force(spark, harbour_tables):
    rng = random.Random(3)
    rows = []
    for n in range(900):
        if n < 300:  # a third of all stops at one spot
            lat, lon = 52.0, 5.0
        elif n < 600:  # a dense quarter
            lat, lon = 52.0 + rng.random() / 100, 5.0 + rng.random() / 100
        else:
            lat, lon = rng.uniform(-89, 89), rng.uniform(-180, 180)
        rows.append((f"s{n:04d}", None, "x", lat, lon, 0, None, None))
    tables = with_stops(spark, harbour_tables, rows)
    asked = [(i, 52.0 + rng.random() / 50, 5.0 + rng.random() / 50, 10 ** rng.uniform(1, 5), 1 + i * 3) for i in range(30)]
    asked += [(100 + i, rng.uniform(-89, 89), rng.uniform(-180, 180), 100_000.0, 100) for i in range(30)]
    got = {}
    for row in nearby(spark, tables, asked).orderBy("request_id", "rank").collect():
        got.setdefault(row.request_id, []).append(row.stop_id)
    for i, lat, lon, radius, limit in asked:
        d_lat = radius / 111_320.0
        d_lon = radius / (111_320.0 * max(abs(math.cos(math.radians(lat))), 0.01))
        near = sorted(
            (metres(lat, lon, r[3], r[4]), r[0])
            for r in rows
            if abs(r[3] - lat) <= d_lat and abs(r[4] - lon) <= d_lon
        )
        expected = [s for d, s in near if d <= radius][:limit]
        assert got.get(i, []) == expected, i


def test_rectangles(spark, harbour_tables):
    rows = [(f"stop-{n:03d}", None, "x", 52.0 + n / 10_000, 5.0, 0, None, None) for n in range(150)]
    tables = with_stops(spark, harbour_tables, rows[::-1])
    schema = "request_id int, min_lat double, min_lon double, max_lat double, max_lon double, limit int"
    asked = spark.createDataFrame(
        [(1, 51.9, 4.9, 52.1, 5.1, 150), (2, 51.9, 4.9, 52.1, 5.1, 3), (3, -90.0, -180.0, 90.0, 180.0, None), (4, 52.0, 5.0, 52.0, 5.0, 9)],
        schema,
    )
    got = {}
    for row in spatial.stops_in_rect(tables, asked).orderBy("request_id", "stop_id").collect():
        got.setdefault(row.request_id, []).append(row.stop_id)
    assert got[1] == got[3] == [r[0] for r in rows]
    assert got[2] == ["stop-000", "stop-001", "stop-002"] and got[4] == ["stop-000"]


def test_request_checks(spark):
    schema = "request_id int, stop_id string, date string, after string, limit int"
    asked = spark.createDataFrame(
        [(1, "a", "2026-09-28", "25:00:00", 20), (2, "a", "28-09-2026", "8:0", 0), (3, "a", None, "8:00:00", 101), (4, "a", "2026-09-28", "1:00:00", None)],
        schema,
    )
    issues = requests.request_issues(asked, "departures").collect()
    assert sorted((r.request_id, r.problem) for r in issues) == [
        (2, "after"), (2, "date"), (2, "limit"), (3, "date"),
    ]
    capped = requests.request_issues(asked, "departures", max_limit=100).collect()
    assert (3, "limit") in {(r.request_id, r.problem) for r in capped}
    assert [r.request_id for r in requests.valid_requests(asked, "departures").collect()] == [1, 4]
    nan = spark.createDataFrame(
        [(1, float("nan"), 5.0, 10.0, 5), (2, 1.0, 1.0, float("inf"), 5)],
        "request_id int, lat double, lon double, radius double, limit int",
    )
    issues = requests.request_issues(nan, "nearby_stops").collect()
    assert sorted((r.request_id, r.problem) for r in issues) == [(1, "position"), (2, "radius")]


def test_missing_keys(spark, harbour_tables):
    asked = spark.createDataFrame([(1, "kai-1"), (2, "nowhere")], "request_id int, stop_id string")
    missing = requests.missing_keys(asked, harbour_tables.stops, "stop_id").collect()
    assert [r.request_id for r in missing] == [2]


def test_dangling_references(spark, harbour_tables):
    assert dangling_references(harbour_tables).isEmpty()
    broken = replace(harbour_tables, stops=harbour_tables.stops.filter("stop_id <> 'tower'"))
    assert [tuple(r) for r in dangling_references(broken).collect()] == [("stop", "tower", 2)]


def test_rank_of_a_group_spread_over_ranges(spark):
    rows = spark.createDataFrame([("g", f"k{n:04d}") for n in range(1000)] + [("h", "a")], "g string, k string")
    ranked = ranking.rank_by_range(rows, ["g"], [F.col("k")]).orderBy("g", "rank").collect()
    assert [r["rank"] for r in ranked] == [*range(1, 1001), 1]
    assert [r.k for r in ranked][:1000] == [f"k{n:04d}" for n in range(1000)]


def test_top_k_is_cut_before_the_shuffle(spark, harbour_tables):
    rows = harbour_tables.stop_times.select("stop_id", "trip_id")
    plan = ranking.first_per_group(rows, ["stop_id"], ["trip_id"], 5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    before = text[text.index("Exchange hashpartitioning(stop_id") :]
    assert "WindowGroupLimit" in before and "Partial" in before
