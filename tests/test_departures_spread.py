"""Departures: what requests and calls of quiet stops give together is cut where it lies, not shuffled."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from haltline.operators import calendar, ranking, stops
from haltline.operators.load import normalize_feed
from haltline.sources.feed import read_feed
from tests.feeds import HARBOUR, write_feed

ASKED = "request_id long, stop_id string, service_date date, after int, limit int"
STOPS = ["kai-1", "kai-2", "tower", "gate", "unknown"]


@pytest.fixture
def timetable(spark, tmp_path):
    """Three services, two of them with many trips over both quays and the lighthouse."""
    rng = random.Random(4)
    trips, calls = "", ""
    for n in range(60):
        trips += f"{rng.choice(['blue', 'red'])},{rng.choice(['daily', 'summer'])},x{n},To {n % 3},0,\n"
        for place, stop in enumerate(rng.sample(STOPS[:3], 2)):
            time = f"{rng.randrange(5, 29):02}:{rng.randrange(6)}0:00"
            calls += f"x{n},{time},{time},{stop},{place},\n"
    files = {**HARBOUR, "trips": HARBOUR["trips"] + trips, "stop_times": HARBOUR["stop_times"] + calls}
    return normalize_feed(read_feed(spark, write_feed(tmp_path / "quays", files)))


def _requests(n, ids):
    rng = random.Random(n)
    days = [date(2027, 3, 28) + timedelta(7 * step) for step in range(12)]
    return [
        (ids(k), rng.choice(STOPS), rng.choice(days), 3600 * rng.randrange(26), rng.choice([1, 2, 5, None]))
        for k in range(n)
    ]


def _brute(timetable, asked):
    running = {(r.service_id, r.service_date) for r in calendar.service_dates(timetable).collect()}
    trips = timetable.trips.select("trip_id", "service_id")
    calls = stops.boardable_calls(timetable).join(trips, "trip_id").collect()
    found = {}
    for number, stop, day, after, limit in asked:
        for c in calls:
            if c.stop_id == stop and c.departure_seconds >= after and (c.service_id, day) in running:
                one = (c.departure_seconds, c.trip_id, c.stop_sequence, stop, str(day), limit or 20)
                found.setdefault(number, []).append(one)
    want = []
    for number, rows in found.items():
        want += [(number, *row[:5]) for nth, row in enumerate(sorted(rows, key=lambda r: r[:3])) if nth < row[5]]
    return sorted(want)


def _rows(df):
    columns = "request_id scheduled_departure_seconds trip_id stop_sequence stop_id service_date".split()
    return sorted(tuple(row) for row in df.select(*columns).collect())


@pytest.mark.parametrize("quiet_rows, task_rows", [(64, 1 << 18), (64, 40), (0, 40), (20, 7)])
def test_departures_equal_brute_force_however_tasks_are_cut(spark, timetable, monkeypatch, quiet_rows, task_rows):
    monkeypatch.setattr(ranking, "QUIET_ROWS", quiet_rows)
    monkeypatch.setattr(stops, "QUIET_TASK_ROWS", task_rows, raising=False)
    asked = _requests(90, lambda k: k)
    want = _brute(timetable, asked)
    assert len(want) > 100 and _rows(stops.departures(timetable, spark.createDataFrame(asked, ASKED))) == want


def test_an_id_that_two_stops_share_is_one_list(spark, timetable):
    asked = [(number, stop, date(2027, 4, 4), 0, 3) for number, stop in ((7, "kai-1"), (7, "tower"), (8, "tower"))]
    want = _brute(timetable, asked)
    assert len(want) == 6 and len({row[4] for row in want}) == 2
    assert _rows(stops.departures(timetable, spark.createDataFrame(asked, ASKED))) == want


@pytest.mark.parametrize("task_rows", [1 << 18, 40])
def test_requests_times_calls_are_not_shuffled(spark, timetable, monkeypatch, task_rows):
    monkeypatch.setattr(stops, "QUIET_TASK_ROWS", task_rows, raising=False)
    asked = spark.createDataFrame(_requests(90, lambda k: k), ASKED)
    plan = stops.departures(timetable, asked)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "hashpartitioning" in line]
    by_stop = [line for line in shuffled if "hashpartitioning(stop_id" in line]
    assert len(by_stop) >= 2, plan
    assert not any("service_date" in line or "request_id" in line for line in shuffled), plan


def test_trips_of_quiet_stops_stay_where_they_meet_their_requests(spark, timetable, monkeypatch):
    day = date(2027, 4, 4)
    schema = "request_id long, stop_id string, service_date date, limit int"
    asked = spark.createDataFrame([(n, one, day, 9) for n, one in enumerate(STOPS)], schema)
    trips = timetable.stop_times.select("stop_id", "trip_id").distinct().join(
        timetable.trips.select("trip_id", "service_id"), "trip_id"
    )
    best = stops.first_running_trips(timetable, trips, asked, "stop_id", 9)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning(service_id" in line for line in plan.splitlines()), plan
    running = {r.service_id for r in calendar.service_dates(timetable).collect() if r.service_date == day}
    by_stop = {}
    for row in trips.filter(F.col("service_id").isin(list(running))).collect():
        by_stop.setdefault(row.stop_id, []).append(row.trip_id)
    want = sorted((stop, trip, n + 1) for stop, ids in by_stop.items() for n, trip in enumerate(sorted(ids)[:9]))
    assert want and sorted((r.stop_id, r.trip_id, r["rank"]) for r in best.collect()) == want
