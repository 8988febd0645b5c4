from __future__ import annotations

import random

from pyspark.sql import functions as F

from haltline.operators import cover
from haltline.operators.cover import first_keys_in_boxes
from haltline.operators.grid import cell_keys, points_in_boxes

BOX = "request_id long, min_lat double, min_lon double, max_lat double, max_lon double, limit int"


def test_crowded_boxes_equal_brute_force_and_read_little(spark, monkeypatch):
    rng = random.Random(4)
    towns = [(rng.uniform(-80, 80), rng.uniform(-170, 170)) for _ in range(6)]
    points = []
    for n in range(6000):
        lat, lon = towns[n % 6]
        spread = rng.choice([0.001, 0.1, 5])
        points.append((f"p{n:05d}", lat + rng.uniform(-1, 1) * spread, lon + rng.uniform(-1, 1) * spread))
    points += [("edge", 90.0, 180.0), ("south", -90.0, -180.0), ("null", 0.0, 0.0)]
    boxes = [(0, -90.0, -180.0, 90.0, 180.0, 50), (1, -90.0, -180.0, 90.0, 180.0, 10_000)]
    boxes += [(2, 0.0, 0.0, 0.0, 0.0, 3), (3, 89.0, 179.0, 90.0, 180.0, 3), (4, 1.0, 1.0, 1.1, 1.1, 5)]
    for n in range(5, 40):
        lat, lon = rng.choice(towns)
        half = rng.choice([0.0005, 0.05, 1, 4, 30])
        limit = rng.choice([1, 10, 40, 500])
        boxes.append((n, max(lat - half, -90), lon - half, min(lat + half, 90), lon + half * rng.random(), limit))
    spots = spark.createDataFrame(points, "stop_id string, latitude double, longitude double")
    requests = spark.createDataFrame(boxes, BOX)
    merged = []
    whole = cover.merge_lists

    def counted(*args):
        merged.append(whole(*args))
        return merged[-1]

    monkeypatch.setattr(cover, "merge_lists", counted)
    rows = first_keys_in_boxes(spots, "stop_id", requests, 10_000).collect()
    found: dict[int, list[str]] = {}
    for row in rows:
        found.setdefault(row.request_id, []).append(row.stop_id)
    for n, low, west, high, east, limit in boxes:
        inside = sorted(p for p, lat, lon in points if low <= lat <= high and west <= lon <= east)
        mine = sorted(found.get(n, []))
        assert len(mine) == len(set(mine)) and mine[:limit] == inside[:limit], n
    limits = {box[0]: box[5] for box in boxes}
    for row in merged[0].groupBy("request_id").count().collect():
        assert row["count"] <= 3 * limits[row.request_id]
    # The world with a limit of 50 does not touch its 6 000 points.
    assert len(found[0]) < 1_500


def _town(spark):
    rng = random.Random(11)
    points = [(f"p{n:05d}", rng.uniform(40, 42), rng.uniform(5, 7)) for n in range(4000)]
    spots = spark.createDataFrame(points, "stop_id string, latitude double, longitude double")
    return points, spots


def test_points_meet_boxes_without_a_broadcast(spark):
    _, spots = _town(spark)
    requests = spark.createDataFrame([(1, 40.5, 5.5, 41.5, 6.5, 10)], BOX)
    plan = points_in_boxes(spots, requests)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_first_keys_of_touched_cells_answer_crowded_boxes(spark):
    points, spots = _town(spark)
    boxes = [(n, 40.1 + n / 50, 5.1, 41.2 + n / 50, 6.6, 1 + 3 * n) for n in range(8)]
    # Hardly any of its cells lies in this one.
    boxes.append((99, 40.0, 6.0, 42.0, 6.0001, 5))
    requests = spark.createDataFrame(boxes, BOX)
    counts = cell_keys(spots).groupBy("cell_level", "cell_y", "cell_x").agg(F.count(F.lit(1)).alias("n"))
    answered, left = cover._from_prefixes(spots, "stop_id", requests, counts, 22, 2)
    assert [row.request_id for row in left.collect()] == [99]
    found: dict[int, list[str]] = {}
    for row in answered.collect():
        found.setdefault(row.request_id, []).append(row.stop_id)
    for n, low, west, high, east, limit in boxes[:-1]:
        inside = sorted(p for p, lat, lon in points if low <= lat <= high and west <= lon <= east)
        assert sorted(found[n]) == inside[:limit]


def test_covers_meet_cells_without_a_broadcast(spark, monkeypatch):
    points, spots = _town(spark)
    plans, keep = [], cover.keep_table

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(cover, "keep_table", kept)
    # No cell can answer these from its first keys, so they are covered.
    monkeypatch.setattr(cover, "PREFIX_TIMES", (0,))
    monkeypatch.setattr(cover, "PREFIX_ROWS", 1)
    requests = spark.createDataFrame([(1, 40.3, 5.3, 41.7, 6.7, 50), (2, 40.1, 5.2, 41.1, 6.9, 40)], BOX)
    found = first_keys_in_boxes(spots, "stop_id", requests, 50)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    on_cells = [line for plan in plans for line in plan.splitlines() if "Join" in line and "cell_x" in line]
    assert len(on_cells) > 6 and not [line for line in on_cells if "Broadcast" in line]
    rows = found.filter("request_id = 1").select("stop_id").collect()
    inside = sorted(p for p, lat, lon in points if 40.3 <= lat <= 41.7 and 5.3 <= lon <= 6.7)
    assert sorted(row[0] for row in rows)[:50] == inside[:50]
