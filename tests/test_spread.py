from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from haltline.operators import spread, trips
from haltline.operators.load import normalize_feed
from haltline.plans import catalog
from haltline.sources.feed import read_feed


@pytest.mark.parametrize("how", ["inner", "left"])
def test_busy_keys_are_dealt_over_tasks_and_nothing_is_lost(spark, monkeypatch, how):
    monkeypatch.setattr(spread, "TASK_ROWS", 100)
    key = F.when(F.col("id") % 3 == 0, F.lit("hub")).when(F.col("id") % 7 != 0, F.concat(F.lit("k"), F.col("id") % 20))
    asked = spark.range(300).withColumnRenamed("id", "request_id").withColumn("id", F.col("request_id"))
    asked = asked.select("request_id", key.alias("key"))
    items = spark.createDataFrame([("hub", n) for n in range(40)] + [("k1", 1), ("k2", 2), ("k2", 3)], "key string, n int")
    found = spread.spread_join(asked, items, ["key"], ["request_id"], how=how)
    plain = asked.join(items, "key", how)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect()))
    task = found.withColumn("task", F.spark_partition_id()).groupBy("task").count()
    assert task.agg(F.max("count")).first()[0] < 1_500 and task.count() > 10


def test_shapes_of_many_trips_are_given_by_many_tasks(spark, harbour_folder, monkeypatch):
    timetable = normalize_feed(read_feed(spark, harbour_folder))
    asked = timetable.shape_points.crossJoin(spark.range(1_000).withColumnRenamed("id", "n"))
    asked = asked.select(F.xxhash64("shape_id", "sequence", "n").alias("request_id"), "shape_id")
    n_rows = timetable.shape_points.groupBy("shape_id").count().agg(F.sum(F.col("count") ** 2)).first()[0] * 1_000
    monkeypatch.setattr(spread, "TASK_ROWS", 200)
    found = trips.shape_points_of(timetable, asked)
    by_task = found.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(row["count"] for row in by_task) == n_rows
    assert len(by_task) > 4


def test_details_are_the_same_however_they_are_dealt(spark, harbour_folder, monkeypatch):
    timetable = normalize_feed(read_feed(spark, harbour_folder))
    requests = timetable.trips.select("trip_id").crossJoin(spark.range(3)).select(
        F.xxhash64("trip_id", "id").alias("request_id"), "trip_id"
    )
    whole = sorted(map(repr, trips.trip_detail(timetable, requests, 1).collect()))
    monkeypatch.setattr(spread, "TASK_ROWS", 2)
    assert sorted(map(repr, trips.trip_detail(timetable, requests, 1).collect())) == whole
    assert len(whole) > requests.count()


def test_calls_meet_their_stops_last(spark, harbour_folder):
    timetable = normalize_feed(read_feed(spark, harbour_folder))
    requests = timetable.trips.select(F.xxhash64("trip_id").alias("request_id"), "trip_id")
    found = trips.trip_calls(timetable, requests)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    # The plan reads from its last join down; stops are wide and are not shuffled again.
    assert "stop_id" in joins[0] and all("trip_id" in line for line in joins[1:])
    assert found.count() == timetable.stop_times.count()


def test_dealt_items_are_joined_once_and_copied_little(spark, monkeypatch):
    monkeypatch.setattr(spread, "TASK_ROWS", 100)
    busy, broadcast = [], F.broadcast
    monkeypatch.setattr(spread.F, "broadcast", lambda df: busy.append(df) or broadcast(df))
    key = F.when(F.col("id") % 3 == 0, F.lit("hub")).when(F.col("id") % 7 != 0, F.concat(F.lit("k"), F.col("id") % 20))
    asked = spark.range(600).select(F.col("id").alias("request_id"), key.alias("key"))
    items = [("hub", n - 30, n) for n in range(100)] + [("hub", None, 7), ("k1", 1, 1), ("k2", 2, 2), (None, 3, 3)]
    items = spark.createDataFrame(items, "key string, nth long, n int")
    found = spread.spread_join(asked, items, ["key"], ["request_id"], deal="nth")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, asked.join(items, "key").collect()))
    # 200 requests for 101 items in 202 tasks: a copy of all items for each task would be 202 of them.
    hub = busy[0].filter("key = 'hub'").first()
    assert 202 <= hub.slots * hub.pieces < 230 and hub.slots < 25 and hub.pieces < 25


def test_copies_of_points_do_not_follow_the_square_of_the_answer(spark, harbour_folder, monkeypatch):
    timetable = normalize_feed(read_feed(spark, harbour_folder))
    monkeypatch.setattr(trips, "POINTS_PER_BUCKET", 1)
    monkeypatch.setattr(spread, "TASK_ROWS", 4)
    busy, broadcast = [], F.broadcast
    monkeypatch.setattr(spread.F, "broadcast", lambda df: busy.append(df) or broadcast(df))
    shapes = timetable.shape_points.select("shape_id").distinct()
    asked = shapes.crossJoin(spark.range(12)).select(F.xxhash64("shape_id", "id").alias("request_id"), "shape_id")
    found = trips.shape_points_of(timetable, asked)
    points = {row.shape_id: row["count"] for row in timetable.shape_points.groupBy("shape_id").count().collect()}
    assert found.count() == 12 * sum(points.values())
    # Points are copied for each slot. One slot for each task would be so many copies:
    by_task = sum(-(-12 * n // 4) * n for n in points.values())
    assert sum(row.slots * points[row.shape_id] for row in busy[0].collect()) <= by_task / 2


def test_texts_of_details_are_made_before_parts_meet_their_trips(spark, harbour_folder, monkeypatch):
    timetable = normalize_feed(read_feed(spark, harbour_folder))
    requests = timetable.trips.select("trip_id").crossJoin(spark.range(3)).select(
        F.xxhash64("trip_id", "id").alias("request_id"), "trip_id"
    )
    monkeypatch.setattr(catalog, "bench_timetable", lambda *_: timetable)
    monkeypatch.setattr(catalog, "_asks", lambda *_: requests)
    monkeypatch.setattr(catalog, "DETAIL_PART", 1)
    found = catalog.QUERIES["trip_detail"](spark, "")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # No array is looked through once for each trip.
    assert "Join " in plan and "lambda" not in plan and "array_join" not in plan
    texts = {(row.request_id, row.part): (row.calls, row.shape) for row in found.collect()}
    details = trips.trip_detail(timetable, requests, 1).collect()
    assert len(texts) == len(details)
    for row in details:
        calls = " ".join(f"{c.stop_sequence}/{c.stop.stop_id}/{c.scheduled_departure or '-'}" for c in row.calls or ())
        assert texts[row.request_id, row.part] == (calls, " ".join(str(p.sequence) for p in row.shape or ()))
