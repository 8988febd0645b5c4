from __future__ import annotations

import math
import random

import pytest

from haltline.operators import groups as stop_groups
from haltline.operators.components import connected_components
from haltline.operators.groups import derive_stop_groups, stop_group_details
from haltline.operators.load import normalize_feed
from haltline.operators.spatial import stop_groups_in_rect
from haltline.sources.feed import read_feed
from tests.test_queries import STOPS, metres


def derive(spark, rows):
    full = [(i, None, n, lat, lon, t, p, None) for i, n, lat, lon, t, p in rows]
    return derive_stop_groups(spark.createDataFrame(full, STOPS))


def as_sets(members):
    groups = {}
    for row in members.collect():
        groups.setdefault(row.group_id, set()).add(row.stop_id)
    return groups


def test_parents_and_nearby_namesakes_merge(spark):
    groups, members = derive(
        spark,
        [
            ("hub", "Marktplatz", 47.5, 9.7, 1, None),
            ("bay-3", "Marktplatz", 47.5002, 9.7, 0, "hub"),
            ("kerb", " MARKTPLATZ ", 47.5004, 9.7, 0, None),
            ("far", "Marktplatz", 47.51, 9.7, 0, None),
        ],
    )
    assert as_sets(members) == {"group:bay-3": {"bay-3", "hub", "kerb"}, "group:far": {"far"}} or as_sets(
        members
    ) == {"group:hub": {"bay-3", "hub", "kerb"}, "group:far": {"far"}}
    group = groups.filter("member_count = 3").first()
    assert (group.min_latitude, group.max_latitude, group.max_longitude) == (47.5, 47.5004, 9.7)


def test_placeholder_positions_do_not_count(spark):
    groups, _ = derive(
        spark,
        [("depot", "Depot", 0.0, 0.0, 1, None), ("depot-1", "Depot", 47.25, 9.5, 0, "depot")],
    )
    group = groups.first()
    assert groups.count() == 1
    assert (group.latitude, group.longitude, group.min_latitude) == (47.25, 9.5, 47.25)


def test_parent_cycles_end(spark):
    _, members = derive(
        spark,
        [("a", "A", 1.0, 1.0, 0, "b"), ("b", "B", 2.0, 2.0, 0, "a"), ("c", "C", 3.0, 3.0, 0, "c")],
    )
    assert as_sets(members) == {"group:a": {"a", "b"}, "group:c": {"c"}}


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(1)
    names = [f"n{n:03d}" for n in range(300)]
    rng.shuffle(names)
    chain = list(zip(names[:150], names[1:151]))
    hub = [(names[151], other) for other in names[152:290]]
    edges = spark.createDataFrame(chain + hub + [("x", "x")], "src string, dst string")
    labels = {row.node: row.label for row in connected_components(edges).collect()}
    assert {labels[n] for n in names[:151]} == {min(names[:151])}
    assert {labels[n] for n in names[151:290]} == {min(names[151:290])}
    assert "x" not in labels


def brute_force(rows):
    """Components of parent links, then of all pairs with a common name in reach."""
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(x, y):
        x, y = sorted((find(x), find(y)))
        parent[y] = x

    for row in rows:
        if row[5] in parent:
            join(row[0], row[5])
    comps = {}
    for row in rows:
        comps.setdefault(find(row[0]), []).append(row)
    points = {}
    for label, members in comps.items():
        usable = [(r[2], r[3]) for r in members if r[2] is not None and (r[2], r[3]) != (0.0, 0.0)]
        if usable:
            lat = sum(p[0] for p in usable) / len(usable)
            lon = sum(p[1] for p in usable) / len(usable)
            points[label] = (lat, lon, {" ".join(r[1].split()).lower() for r in members})
    labels = sorted(points)
    for i, a in enumerate(labels):
        for b in labels[i + 1 :]:
            (la, lo, na), (lb, lp, nb) = points[a], points[b]
            cells = abs(math.floor(la / 0.0015) - math.floor(lb / 0.0015)) <= 1 and abs(
                math.floor(lo / 0.0025) - math.floor(lp / 0.0025)
            ) <= 1
            if cells and na & nb and metres(la, lo, lb, lp) <= 150.0:
                join(a, b)
    result = {}
    for row in rows:
        result.setdefault(find(row[0]), set()).add(row[0])
    return sorted(map(sorted, result.values()))


@pytest.mark.parametrize("compared", [4_096, 1, 9])
def test_crowds_of_namesakes_against_brute_force(spark, monkeypatch, compared):
    # Few spots to compare at once make tile pairs be halved.
    monkeypatch.setattr(stop_groups, "COMPARED_SPOTS", compared)
    rng = random.Random(11)
    rows = []
    for n in range(400):
        name = rng.choice(["Markt", "markt ", "Kerk", "Plein"])
        # Dense enough for long chains of links, sparse enough for gaps near the limit.
        lat = rng.choice([52.0, -0.004, 66.0]) + rng.random() * 0.02
        lon = 5.0 + rng.random() * 0.02
        parent = f"s{rng.randrange(400):03d}" if rng.random() < 0.1 else None
        rows.append((f"s{n:03d}", name, lat, lon, 0, parent))
    rows += [(f"c{n:03d}", "Markt", 52.005, 5.005, 0, None) for n in range(100)]
    _, members = derive(spark, rows)
    assert sorted(map(sorted, as_sets(members).values())) == brute_force(rows)
    rng.shuffle(rows)
    _, shuffled = derive(spark, rows)
    assert as_sets(shuffled) == as_sets(members)


def test_two_open_tiles_full_of_namesakes_are_halved(spark):
    rng = random.Random(12)
    # 10 000 spots of one name left and right of a gap of just over 150 m.
    west, east = 5.0 + 0.00005, 5.0 + 0.00005 + 151 / 111_194.9 / math.cos(math.radians(52.0))
    rows = []
    for n in range(10_000):
        lat, inside = 52.0001 + rng.random() * 0.0003, rng.random() * 0.00004
        rows.append((f"s{n:05d}", "Markt", lat, west - inside if n % 2 else east + inside, 0, None))
    _, members = derive(spark, rows)
    assert sorted(map(len, as_sets(members).values())) == [5_000, 5_000]
    # A spot far away in the eastern tile leaves both open.
    rows.append(("y", "Markt", 52.0001, 5.00168, 0, None))
    # Only one spot of 10 000 in reach of one other joins them.
    rows.append(("x", "Markt", 52.00025, east - 3 / 111_194.9 / math.cos(math.radians(52.0)), 0, None))
    near = max((row for row in rows[:10_000] if row[0] > "s" and int(row[0][1:]) % 2), key=lambda row: row[3])
    reach = metres(rows[-1][2], rows[-1][3], near[2], near[3])
    _, members = derive(spark, rows)
    assert reach < 150 and len(as_sets(members)) == 1


def test_group_details(spark, harbour_folder):
    tables = normalize_feed(read_feed(spark, harbour_folder))
    groups, members = derive_stop_groups(tables.stops)
    group = groups.filter("member_count = 4").first()
    assert group.group_id == "group:kai"
    assert (group.latitude, group.min_latitude) == (68.231, 68.2308)
    asked = spark.createDataFrame([(1, "group:kai"), (2, "group:x")], "request_id int, group_id string")
    detail = stop_group_details(tables, groups, members, asked).collect()
    assert len(detail) == 1
    by_stop = {m.stop_id: m for m in detail[0].members}
    assert [m.stop_id for m in detail[0].members] == ["gate", "kai", "kai-1", "kai-2"]
    assert by_stop["kai-1"].route_ids == ["blue"]
    assert by_stop["kai-1"].agency_ids == ["fjord"]
    assert by_stop["kai"].route_ids == []
    assert [r.route_id for r in detail[0].routes] == ["blue", "red"]
    assert [a.name for a in detail[0].agencies] == ["Fjordlink"]
    parts = stop_group_details(tables, groups, members, asked, part_size=1).collect()
    assert sorted(m.stop_id for row in parts for m in row.members) == sorted(by_stop)


def test_mean_positions_on_a_border_do_not_depend_on_the_order_of_rows(spark):
    groups, _ = derive(
        spark,
        [("a", "A", 0.1, 9.5, 0, None), ("b", "B", 0.2, 9.5, 0, "a"), ("c", "C", 0.3, 9.5, 0, "a")],
    )
    box = spark.createDataFrame(
        [(1, 0.2, 9.5, 0.2, 9.5, 5)],
        "request_id long, min_lat double, min_lon double, max_lat double, max_lon double, limit int",
    )
    found = stop_groups_in_rect(groups, box).collect()
    assert [(row.group_id, row.latitude) for row in found] == [("group:a", 0.2)]
