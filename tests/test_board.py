"""Boards: dates are listed where their stops lie, in tasks cut by what they give."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from haltline.operators import calendar, stops
from haltline.operators.load import normalize_feed
from haltline.sources.feed import read_feed


@pytest.mark.parametrize("task_rows", [1 << 20, 3])
def test_boards_equal_brute_force_and_dates_are_not_shuffled(spark, harbour_folder, monkeypatch, task_rows):
    monkeypatch.setattr(stops, "BOARD_TASK_ROWS", task_rows, raising=False)
    timetable = normalize_feed(read_feed(spark, harbour_folder))
    # Over the ends of months, and the last days of long ones.
    days = [(date(2027, 2, 20) + timedelta(n),) for n in range(80)]
    dates = spark.createDataFrame(days, "service_date date")
    board = stops.departure_board(timetable, dates, 2)
    plan = board._jdf.queryExecution().optimizedPlan().toString()
    executed = board._jdf.queryExecution().executedPlan().toString()
    assert "RepartitionByExpression" in plan
    assert not any("hashpartitioning" in line and "service_date" in line for line in executed.splitlines())
    running = {(r.service_id, r.service_date) for r in calendar.service_dates(timetable).collect()}
    calls = stops.boardable_calls(timetable).join(timetable.trips.select("trip_id", "service_id"), "trip_id").collect()
    want = []
    for (one,) in days:
        by_stop = {}
        for call in calls:
            if (call.service_id, one) in running:
                by_stop.setdefault(call.stop_id, []).append((call.departure_seconds, call.trip_id, call.stop_sequence))
        for stop, found in by_stop.items():
            want += [(stop, str(one), n + 1, *row) for n, row in enumerate(sorted(found)[:2])]
    got = board.select(
        "stop_id", "service_date", "rank", F.col("scheduled_departure_seconds"), "trip_id", "stop_sequence"
    ).collect()
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_trips_at_stops_are_reduced_in_tasks_cut_by_calls(spark, harbour_folder, monkeypatch):
    timetable = normalize_feed(read_feed(spark, harbour_folder))
    # Every trip calls twice at each of its stops.
    calls = timetable.stop_times
    twice = calls.unionByName(calls.withColumn("stop_sequence", F.col("stop_sequence") + 1_000))
    timetable = replace(timetable, stop_times=twice)
    monkeypatch.setattr(stops, "CALL_TASK_ROWS", 2, raising=False)
    given = []
    whole = stops.first_running_trips

    def kept(tables, trips, *rest):
        given.append(trips)
        return whole(tables, trips, *rest)

    monkeypatch.setattr(stops, "first_running_trips", kept)
    requests = calls.select("stop_id").distinct().select(
        F.xxhash64("stop_id").alias("request_id"), "stop_id", F.lit(date(2027, 3, 20)).alias("service_date"),
        F.lit(50).alias("limit"),
    )
    got = stops.stop_trips(timetable, requests).collect()
    running = {r.service_id for r in calendar.service_dates(timetable).collect() if r.service_date == date(2027, 3, 20)}
    joined = calls.join(timetable.trips.select("trip_id", "service_id"), "trip_id").collect()
    want = {(r.stop_id, r.trip_id) for r in joined if r.service_id in running}
    assert want and sorted((r.stop_id, r.trip_id) for r in got) == sorted(want)
    executed = given[0]._jdf.queryExecution().executedPlan().toString()
    by_trip = [line for line in executed.splitlines() if "hashpartitioning(trip_id" in line]
    n_tasks = 2 * calls.count() // 2 + 1
    assert by_trip and all(f", {n_tasks})" in line for line in by_trip), executed
