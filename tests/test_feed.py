from __future__ import annotations

import pytest

from haltline.operators.validation import RULE_FAMILIES, validate, validation_report
from haltline.sources.feed import (
    FeedError,
    feed_counts,
    has_records,
    read_feed,
    read_text_feed,
    unreadable_records,
)
from tests.feeds import HARBOUR, HILL, write_feed


def codes(spark, folder):
    return {row.code for row in validate(read_feed(spark, folder)).select("code").collect()}


def test_reads_by_header_name_with_defaults(spark, hill_folder):
    folder = hill_folder(
        stop_times="stop_sequence,stop_id,trip_id,departure_time,extra\n"
        '1,summit,up-1,25:11:00,"a,b"\n'
    )
    row = read_feed(spark, folder).stop_times.first()
    assert (row.trip_id, row.stop_id, row.stop_sequence) == ("up-1", "summit", 1)
    assert (row.arrival_time, row.departure_time) == (None, 90_660)
    assert (row.stop_headsign, row.pickup_type) == ("", None)


def test_quotes_and_line_breaks_in_small_files(spark, hill_folder):
    folder = hill_folder(
        stops='stop_id,stop_name,stop_lat,stop_lon\nsummit,"The ""old""\nmill",52.0,5.0\n'
    )
    assert read_feed(spark, folder).stops.first().stop_name == 'The "old"\nmill'


def test_byte_order_mark_is_ignored(spark, hill_folder):
    folder = hill_folder(agency="﻿" + HILL["agency"])
    assert read_feed(spark, folder).agency.first().agency_id == "hill"


def test_missing_files_and_columns(spark, tmp_path, hill_folder):
    only = {k: v for k, v in HILL.items() if k != "trips"}
    with pytest.raises(FeedError, match="trips"):
        read_feed(spark, write_feed(tmp_path / "a", only))
    no_service = {k: v for k, v in HILL.items() if not k.startswith("calendar")}
    with pytest.raises(FeedError, match="calendar"):
        read_feed(spark, write_feed(tmp_path / "b", no_service))
    with pytest.raises(FeedError, match="route_type"):
        read_feed(spark, hill_folder(routes="route_id\nrack\n"))


def test_row_numbers_follow_the_file(spark, hill_folder):
    lines = "".join(f"up-1,,,summit,{n}\n" for n in range(3000, 0, -1))
    folder = hill_folder(
        stop_times="trip_id,arrival_time,departure_time,stop_id,stop_sequence\n" + lines
    )
    rows = read_feed(spark, folder).stop_times.orderBy("row_no").collect()
    assert [row.stop_sequence for row in rows] == list(range(3000, 0, -1))
    assert len({row.row_no for row in rows}) == 3000


def test_row_numbers_across_splits(spark, hill_folder):
    lines = "".join(f"up-1,,,summit,{n}\n" for n in range(20_000))
    folder = hill_folder(
        stop_times="trip_id,arrival_time,departure_time,stop_id,stop_sequence\n" + lines
    )
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")
    try:
        times = read_feed(spark, folder).stop_times
        assert times.rdd.getNumPartitions() > 5
        rows = times.orderBy("row_no").collect()
    finally:
        spark.conf.set(key, before)
    assert [row.stop_sequence for row in rows] == list(range(20_000))


def test_unreadable_values(spark, hill_folder):
    folder = hill_folder(
        stop_times="trip_id,arrival_time,departure_time,stop_id,stop_sequence\n"
        "up-1,8:61:00,,summit,\n",
        transfers="from_stop_id,to_stop_id,transfer_type\nsummit,summit,\n",
    )
    found = unreadable_records(read_text_feed(spark, folder)).collect()
    assert {(row.file, row.column, row.value) for row in found} == {
        ("stop_times", "arrival_time", "8:61:00"),
        ("stop_times", "stop_sequence", ""),
        ("transfers", "transfer_type", ""),
    }


def test_counts(spark, hill_folder):
    feed = read_feed(spark, hill_folder())
    counts = {row.table_name: row.n for row in feed_counts(dict(feed.files())).collect()}
    assert counts["stop_times"] == 1 and counts["shapes"] == 2 and counts["calendar_dates"] == 0
    assert has_records(feed.stops) and not has_records(feed.frequencies)


def test_a_consistent_feed_has_no_issues(spark, hill_folder):
    assert codes(spark, hill_folder()) == set()


#: One fault for each code: family, code, file, text in the harbour feed and what it becomes.
FAULTS = [
    ("frequencies", "unsupported_frequencies", "frequencies", None, "trip_id,start_time,end_time,headway_secs\nb-night,6:00:00,7:00:00,60\n"),
    ("feed_info", "incomplete_feed_info", "feed_info", "Fjordlink AS", ""),
    ("feed_info", "invalid_feed_date_range", "feed_info", "20270831", "20270228"),
    ("feed_info", "multiple_feed_info_records", "feed_info", "example\n", "example\nOther,https://o.example,nn,,,,\n"),
    ("agency", "incomplete_agency", "agency", "Europe/Oslo", ""),
    ("agency", "duplicate_agency", "agency", "Oslo\n", "Oslo\nfjord,Again,https://a.example,Europe/Oslo\n"),
    ("agency", "missing_agency", "agency", "fjord,Fjordlink,https://fjordlink.example,Europe/Oslo\n", ""),
    ("agency", "missing_agency_id", "agency", "Oslo\n", "Oslo\n,Nameless,https://n.example,Europe/Oslo\n"),
    ("stops", "missing_stop_id", "stops", "gate,,", ",,"),
    ("stops", "invalid_coordinates", "stops", "68.2400", "90.5"),
    ("stops", "incomplete_coordinates", "stops", "68.2400,14.6000", "68.24,"),
    ("stops", "duplicate_stop", "stops", "gate,,Kaia gate", "kai-1,,Kaia gate"),
    ("stop_hierarchy", "invalid_location_type", "stops", "14.6000,0", "14.6,5"),
    ("stop_hierarchy", "unexpected_parent_station", "stops", "14.5650,1,,", "14.565,1,tower,"),
    ("stop_hierarchy", "missing_parent_station", "stops", "14.5640,2,kai", "14.564,2,"),
    ("stop_hierarchy", "self_parent_station", "stops", "14.6000,0,,", "14.6,0,tower,"),
    ("stop_hierarchy", "unknown_parent_station", "stops", "14.6000,0,,", "14.6,0,lost,"),
    ("stop_hierarchy", "invalid_parent_location_type", "stops", "14.6000,0,,", "14.6,0,kai-1,"),
    ("routes", "missing_route_id", "routes", "red,fjord", ",fjord"),
    ("routes", "missing_route_name", "routes", "fjord,R,", "fjord,,"),
    ("routes", "duplicate_route", "routes", "red,fjord", "blue,fjord"),
    ("routes", "unknown_agency", "routes", "red,fjord", "red,sound"),
    ("routes", "missing_route_agency", "agency+routes", None, None),
    ("calendar", "invalid_calendar_weekday", "calendar", "summer,0", "summer,3"),
    ("calendar", "invalid_calendar_range", "calendar", "20270831", "20270531"),
    ("calendar", "duplicate_calendar", "calendar", "summer,0", "daily,0"),
    ("calendar_dates", "invalid_exception_type", "calendar_dates", "20270502,1", "20270502,4"),
    ("calendar_dates", "duplicate_calendar_date", "calendar_dates", "summer,20270317", "daily,20270317"),
    ("shapes", "invalid_shape_coordinates", "shapes", "14.59,6", "180.5,6"),
    ("shapes", "invalid_shape_distance", "shapes", "800.5", "-0.5"),
    ("shapes", "non_increasing_shape_sequence", "shapes", "14.59,6", "14.59,5"),
    ("trips", "incomplete_trip", "trips", "r-noon", ""),
    ("trips", "invalid_direction_id", "trips", "r-noon,,1", "r-noon,,2"),
    ("trips", "unknown_route", "trips", "red,summer", "green,summer"),
    ("trips", "unknown_service", "trips", "red,summer", "red,winter"),
    ("trips", "unknown_shape", "trips", "r-noon,,1,", "r-noon,,1,river"),
    ("trips", "duplicate_trip", "trips", "r-noon", "b-night"),
    ("transfers", "invalid_transfer_type", "transfers", ",2,240", ",6,240"),
    ("transfers", "missing_transfer_stop", "transfers", "kai-1,kai-2,,,,,2,240", "kai-1,,,,,,0,"),
    ("transfers", "missing_linked_trip", "transfers", "kai-1,kai-2,,,,,2,240", "kai-1,kai-2,,,b-night,,4,"),
    ("transfers", "missing_transfer_time", "transfers", ",2,240", ",2,"),
    ("transfers", "duplicate_transfer", "transfers", ",2,240\n", ",2,240\nkai-1,kai-2,,,,,2,300\n"),
    ("transfers", "unknown_transfer_stop", "transfers", "kai-1,kai-2", "kai-1,kai-9"),
    ("transfers", "invalid_transfer_stop_type", "transfers", "kai-1,kai-2", "kai-1,gate"),
    ("transfers", "unknown_transfer_route", "transfers", "kai-1,kai-2,,", "kai-1,kai-2,green,"),
    ("transfers", "unknown_transfer_trip", "transfers", "kai-1,kai-2,,,,", "kai-1,kai-2,,,g-1,"),
    ("transfers", "transfer_trip_route_mismatch", "transfers", "kai-1,kai-2,,,,", "kai-1,kai-2,red,,b-night,"),
    ("stop_times", "incomplete_stop_time", "stop_times", "kai-2,3", ",3"),
    ("stop_times", "invalid_stop_time_enum", "stop_times", "kai-1,10,1", "kai-1,10,2"),
    ("stop_times", "unknown_trip", "stop_times", "r-noon,12:30:00", "g-1,12:30:00"),
    ("stop_times", "unknown_stop", "stop_times", "kai-2,3", "kai-9,3"),
    ("stop_times", "non_increasing_stop_sequence", "stop_times", "tower,7", "tower,3"),
]


@pytest.mark.parametrize("fault", FAULTS, ids=[fault[1] for fault in FAULTS])
def test_each_code_alone(spark, tmp_path, fault):
    family, code, file, old, new = fault
    files = dict(HARBOUR)
    if code == "missing_route_agency":
        files["agency"] += "sound,Soundline,https://sound.example,Europe/Oslo\n"
        files["routes"] = files["routes"].replace("red,fjord", "red,")
    elif old is None:
        files[file] = new
    else:
        assert files[file].count(old) == 1
        files[file] = files[file].replace(old, new)
    found = RULE_FAMILIES[family](read_feed(spark, write_feed(tmp_path / "feed", files)))
    also = {"incomplete_stop_time": {"unknown_stop"}}.get(code, set())  # a blank id is unknown too
    assert {row.code for row in found.select("code").collect()} == {code} | also


def test_every_code_has_a_fault():
    assert len({fault[1] for fault in FAULTS}) == len(FAULTS) == 52


def test_the_harbour_has_no_issues(spark, harbour_folder):
    assert codes(spark, harbour_folder) == set()


def test_sequence_is_compared_with_the_row_before_across_chunks(spark):
    from haltline.operators.validation import _not_increasing

    chunk = 1 << 20
    rows = spark.createDataFrame(
        [("a", 5, 0), ("b", 1, 1), ("a", 3, 2), ("a", 4, chunk), ("b", 1, chunk * 3), ("b", 2, chunk * 3 + 1)],
        "g string, v long, row_no long",
    )
    bad = _not_increasing(rows, "g", "v").select("g", "v").collect()
    assert {tuple(row) for row in bad} == {("a", 3), ("b", 1)}


def test_report_keeps_a_hundred_and_counts_the_rest(spark, hill_folder):
    stops = "".join(f"s{n},x,95.0,5.0\n" for n in range(130))
    folder = hill_folder(stops="stop_id,stop_name,stop_lat,stop_lon\nsummit,C,52,5\n" + stops)
    report = validation_report(validate(read_feed(spark, folder))).collect()
    assert len(report) == 100 and {row.omitted_issue_count for row in report} == {30}


def test_every_family_is_registered():
    assert len(RULE_FAMILIES) == 12
