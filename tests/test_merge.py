"""Merging ranked lists: only as much is read as a question asks for."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from haltline.operators import ranking
from haltline.operators.ranking import first_per_group, merge_lists, ranked_lists
from haltline.operators.stops import departures, stop_trips
from haltline.schema import Timetable

ASK = "ask long, owner string, list string, after int, limit int"


@pytest.mark.parametrize("list_rows", [1 << 20, 7])
def test_merged_lists_equal_brute_force(spark, monkeypatch, list_rows):
    monkeypatch.setattr(ranking, "LIST_ROWS", list_rows)
    rng = random.Random(9)
    rows = []
    for owner in "ab":
        for number in range(12):
            for _ in range(rng.choice([0, 1, 5, 40])):
                rows.append((owner, f"l{number}", rng.randrange(60), len(rows)))
    asked = []
    for n in range(60):
        owner, after, limit = rng.choice("abc"), rng.choice([-1, 0, 10, 30, 59, 99]), rng.choice([1, 2, 9, 30])
        asked += [(n, owner, f"l{one}", after, limit) for one in range(12) if rng.random() < 0.6]
    given = spark.createDataFrame(rows, "owner string, list string, key int, id long")
    questions = spark.createDataFrame(asked, ASK)
    lists = ["owner", "list"]
    marks = questions.select(*lists, F.col("after").alias("key"))
    ranked, before = ranked_lists(given, lists, "key", ["id"], 30, marks)
    placed = questions.join(before.withColumnRenamed("key", "after"), [*lists, "after"]).drop("after")
    found = merge_lists(ranked, placed, lists, "key", ["ask"])
    best = first_per_group(found, ["ask"], ["key", "id"], 30).filter(F.col("rank") <= F.col("limit"))
    got = sorted((r.ask, r["rank"], r.owner, r.list, r.key, r.id) for r in best.collect())
    want = []
    for n in range(60):
        mine = [a for a in asked if a[0] == n]
        wanted = {a[1:3] for a in mine}
        hits = sorted((r for r in rows if r[:2] in wanted and r[2] >= mine[0][3]), key=lambda r: r[2:])
        want += [(n, place + 1, *row) for place, row in enumerate(hits[: mine[0][4]])] if mine else []
    assert got == sorted(want)


def _hub(spark, services, per_service):
    """One stop where every service has some trips; each service runs on every other date of a year."""
    n = services * per_service
    numbers = spark.range(n)
    service = F.concat(F.lit("w"), (F.col("id") % services).cast("string"))
    trip = F.format_string("t%07d", "id")
    none = F.lit(None).cast("string")
    trips = numbers.select(
        trip.alias("trip_id"), F.lit("r").alias("route_id"), service.alias("service_id"), none.alias("headsign"),
        none.alias("short_name"), F.lit(0).alias("direction_id"), none.alias("shape_id"),
    )
    seconds = (F.col("id") * 7919 % 86400).cast("int")
    calls = numbers.select(
        trip.alias("trip_id"), F.lit("hub").alias("stop_id"), F.lit(1).cast("long").alias("stop_sequence"),
        seconds.alias("arrival_seconds"), seconds.alias("departure_seconds"), none.alias("stop_headsign"),
        *(F.lit(0).alias(name) for name in ("pickup_type", "drop_off_type", "timepoint")),
    )
    day = F.expr("date_add(DATE'2030-01-01', CAST(d AS INT))")
    exceptions = (
        spark.range(services)
        .withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(364))))
        .filter((F.col("id") + F.col("d")) % 2 == 0)
        .select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("service_id"), day.alias("service_date"),
                F.lit(1).alias("exception_type"))
    )
    week = ", ".join(f"{name} int" for name in "monday tuesday wednesday thursday friday saturday sunday".split())
    calendars = spark.createDataFrame([], f"service_id string, {week}, start_date date, end_date date")
    routes = spark.createDataFrame(
        [("r", "a", "1", "one", 3, "", "")],
        "route_id string, agency_id string, short_name string, long_name string, route_type int, "
        "color string, text_color string",
    )
    empty = spark.createDataFrame([], "x int")
    return Timetable(empty, empty, routes, trips, calls, calendars, exceptions, empty, empty, empty)


def test_a_hub_with_many_services_and_dates_reads_what_it_answers(spark, monkeypatch):
    services, per_service, limit = 2000, 3, 10
    timetable = _hub(spark, services, per_service)
    days = [date(2030, 1, 1) + timedelta(n) for n in range(365)]
    requests = spark.createDataFrame(
        [(n, "hub", day, 3600 * (n % 20), limit) for n, day in enumerate(days)],
        "request_id long, stop_id string, service_date date, after int, limit int",
    )
    joined = []
    whole = ranking.merge_lists

    def counted(*args):
        found = whole(*args)
        joined.append(found.count())
        return found

    monkeypatch.setattr("haltline.operators.stops.merge_lists", counted)
    got = departures(timetable, requests).collect()
    calls = sorted((n * 7919 % 86400, f"t{n:07d}", n % services) for n in range(services * per_service))
    want = set()
    for n, after in ((n, 3600 * (n % 20)) for n in range(365)):
        running = [c for c in calls if c[0] >= after and (c[2] + n) % 2 == 0][:limit]
        want |= {(n, trip, second) for second, trip, _ in running}
    assert {(r.request_id, r.trip_id, r.scheduled_departure_seconds) for r in got} == want
    assert len(got) == 365 * limit and joined[0] <= 3 * limit * 365
    got = stop_trips(timetable, requests.select("request_id", "stop_id", "service_date", "limit")).collect()
    want = {
        (n, f"t{i:07d}") for n in range(365) for i in [i for i in range(2 * limit + 2) if (i + n) % 2 == 0][:limit]
    }
    assert {(r.request_id, r.trip_id) for r in got} == want and joined[1] <= 3 * limit * 365
