"""Routes of all groups are found without shuffling the calls to look for their stops first."""

from __future__ import annotations

import pytest

from haltline.operators import groups
from haltline.operators.load import normalize_feed
from haltline.sources.feed import read_feed


@pytest.mark.parametrize("some", [False, True])
def test_details_look_for_stops_only_if_few_are_asked_for(spark, harbour_folder, monkeypatch, some):
    timetable = normalize_feed(read_feed(spark, harbour_folder))
    all_groups, members = groups.derive_stop_groups(timetable.stops)
    ids = sorted(r.group_id for r in all_groups.collect())
    asked = ids[:1] if some else ids
    given = []
    whole = groups.stop_route_pairs

    def kept(tables, stops=None):
        given.append(stops)
        return whole(tables, stops)

    monkeypatch.setattr(groups, "stop_route_pairs", kept)
    monkeypatch.setattr(groups, "MOST_STOPS", 1 if some else 3, raising=False)
    requests = spark.createDataFrame(list(enumerate(asked)), "request_id long, group_id string")
    got = groups.stop_group_details(timetable, all_groups, members, requests).collect()
    assert [stops is None for stops in given] == [not some]
    pairs = {(r.group_id, r.stop_id, r.route_id) for r in groups.group_member_routes(timetable, members).collect()}
    same = groups.group_member_routes(timetable, members, whole=True).collect()
    assert pairs and sorted((r.group_id, r.stop_id, r.route_id) for r in same) == sorted(pairs)
    found = {(r.group_id, m.stop_id, route) for r in got for m in r.members for route in m.route_ids}
    assert found == {pair for pair in pairs if pair[0] in asked} and {r.group_id for r in got} == set(asked)
