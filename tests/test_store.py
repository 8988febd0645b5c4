from __future__ import annotations

import zipfile

import pytest

from haltline.operators.load import normalize_feed
from haltline.sources.archive import archive_manifest, feed_file_issues, unpack_feeds
from haltline.sources.feed import read_feed
from haltline.sources.importing import FeedRejected, import_archive, import_feed
from haltline.sources.store import VersionError, VersionStore, check_version, schedule_metadata
from haltline.streaming.refresh import refresh_feeds
from tests.feeds import HARBOUR, HILL, zip_feed


@pytest.mark.parametrize("label", ["", ".", "..", "a/b", "a b", "x" * 129, "é", "v1\n"])
def test_unsafe_labels(label):
    with pytest.raises(VersionError):
        check_version(label)


def test_import_activate_and_roll_back(spark, tmp_path, harbour_folder, hill_folder):
    store = VersionStore(spark, str(tmp_path / "store"))
    assert store.active() is None
    counts = {r.table_name: r.n for r in import_feed(spark, harbour_folder, store, "v1").collect()}
    assert (counts["stops"], counts["stop_groups"], counts["stop_times"]) == (5, 2, 4)
    assert (counts["shape_points"], counts["transfers"]) == (4, 1)
    import_feed(spark, hill_folder(), store, "v2")
    with pytest.raises(VersionError, match="exists"):
        import_feed(spark, harbour_folder, store, "v2")
    with pytest.raises(VersionError, match="not installed"):
        store.activate("v3")
    store.activate("v1")
    store.activate("v2")
    assert store.active() == "v2"
    states = [tuple(r) for r in store.installed_versions().collect()]
    assert states == [("v1", "installed"), ("v2", "active")]
    assert store.read().stops.first().stop_id == "summit"
    store.activate("v1")
    assert store.active() == "v1" and store.read().stops.count() == 5
    groups, members = store.read_groups()
    assert groups.count() == 2 and members.count() == 5
    meta = schedule_metadata(store.read_table("v1", "feed_metadata"), store.read("v1").feed_info)
    row = meta.first()
    assert (row.schedule_version, row.source_version) == ("v1", "spring-27")
    assert row.start_date == "2027-03-01" and row.imported_at_unix > 0


def test_metadata_without_feed_info(spark, hill_folder):
    feed_info = normalize_feed(read_feed(spark, hill_folder())).feed_info.limit(0)
    row = schedule_metadata(spark.createDataFrame([], "key string, value string"), feed_info).first()
    assert row.schedule_version is None and row.publisher_name is None


def test_a_rejected_feed_leaves_nothing_behind(spark, tmp_path, hill_folder):
    store = VersionStore(spark, str(tmp_path / "store"))
    header = "trip_id,arrival_time,departure_time,stop_id,stop_sequence\n"
    with pytest.raises(FeedRejected) as unreadable:
        import_feed(spark, hill_folder(stop_times=header + "up-1,noon,,summit,1\n"), store, "v1")
    assert unreadable.value.issues[0].value == "noon"
    with pytest.raises(FeedRejected) as invalid:
        import_feed(spark, hill_folder(stop_times=header + "up-1,,,nowhere,1\n"), store, "v1")
    assert [issue.code for issue in invalid.value.issues] == ["unknown_stop"]
    assert [r.code for r in store.rejected_issues("v1", "validation").collect()] == ["unknown_stop"]
    assert store.versions().isEmpty() and store.active() is None


def test_another_schema_is_not_activated(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    store._append("versions", store._VERSIONS, ("old", 999, 0))
    with pytest.raises(VersionError, match="schema"):
        store.activate("old")


def test_archive_checks(spark, tmp_path):
    good = zip_feed(tmp_path / "good.zip", HARBOUR)
    bad = str(tmp_path / "bad.zip")
    with zipfile.ZipFile(bad, "w") as archive:
        for name in ("agency.txt", "stops.txt", "deep/routes.txt", "../trips.txt"):
            archive.writestr(name, "x")
    archives = spark.createDataFrame([("good", good), ("bad", bad)], "feed_id string, path string")
    manifest = archive_manifest(archives)
    issues = feed_file_issues(manifest).collect()
    assert {(r.feed_id, r.problem, r.member) for r in issues} == {
        ("bad", "invalid_path", "deep/routes.txt"),
        ("bad", "invalid_path", "../trips.txt"),
        ("bad", "missing_file", "routes.txt"),
        ("bad", "missing_file", "trips.txt"),
        ("bad", "missing_file", "stop_times.txt"),
        ("bad", "missing_file", "calendar.txt or calendar_dates.txt"),
    }
    limits = feed_file_issues(manifest.filter("feed_id = 'good'"), max_files=3, max_bytes=10)
    assert {r.problem for r in limits.collect()} == {"too_many_files", "too_large"}


def test_an_archive_imports_like_its_folder(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    files = {**HARBOUR, "agency": "﻿" + HARBOUR["agency"].replace("\n", "\r\n")}
    import_archive(spark, zip_feed(tmp_path / "feed.zip", files), store, "v1")
    tables = store.read("v1")
    assert tables.agencies.first().name == "Fjordlink"
    assert sorted(r.stop_sequence for r in tables.stop_times.collect()) == [3, 7, 10, 20]


def test_refresh_imports_each_publication_once(spark, tmp_path):
    landing, progress = tmp_path / "landing", str(tmp_path / "progress")
    store = VersionStore(spark, str(tmp_path / "store"))
    zip_feed(landing / "one.zip", HARBOUR)

    def refresh():
        query = refresh_feeds(spark, str(landing), store, progress)
        query.awaitTermination()

    refresh()
    first = store.active()
    assert first.startswith("f1-") and store.versions().count() == 1
    (landing / "copy.zip").write_bytes((landing / "one.zip").read_bytes())
    refresh()
    assert store.active() == first and store.versions().count() == 1
    header = HILL["trips"].splitlines()[0]
    broken = {**HILL, "trips": f"{header}\nnone,mondays,up-1,,\n"}
    zip_feed(landing / "broken.zip", broken)
    (landing / "torn.zip").write_bytes(b"no archive at all")
    refresh()
    assert store.active() == first and store.versions().count() == 1
    refused = {r.path.rsplit("/", 1)[-1]: (r.stage, r.issues) for r in store.rejections().collect()}
    assert refused == {"broken.zip": ("validation", 1), "torn.zip": ("archive", 1)}
    # The bad archives stay where they are; a good one after them goes on.
    zip_feed(landing / "later.zip", HILL)
    refresh()
    assert store.active() != first and store.versions().count() == 2
    assert store.rejections().count() == 2


def _damaged(path, member):
    """The archive with some bytes of a member's packed content turned over."""
    raw = bytearray(path.read_bytes())
    with zipfile.ZipFile(path) as archive:
        entry = archive.getinfo(member)
    start = entry.header_offset + 30 + len(entry.filename)
    for place in range(start, start + entry.compress_size):
        raw[place] ^= 0xFF
    path.write_bytes(raw)


def _flagged(path, member, flag=None, method=None):
    """The archive with other flags or another method in both headers of a member."""
    raw = bytearray(path.read_bytes())
    with zipfile.ZipFile(path) as archive:
        local = archive.getinfo(member).header_offset
    central = raw.index(b"PK\x01\x02")
    while raw[central + 46 : central + 46 + len(member)] != member.encode():
        central = raw.index(b"PK\x01\x02", central + 4)
    for place, value in ((6, flag), (8, method)):
        if value is not None:
            raw[local + place] = raw[central + place + 2] = value
    path.write_bytes(raw)


def test_refresh_goes_on_after_every_kind_of_bad_archive(spark, tmp_path):
    landing, progress = tmp_path / "landing", str(tmp_path / "progress")
    store = VersionStore(spark, str(tmp_path / "store"))
    for name in ("crypt", "damage", "method", "torn"):
        zip_feed(landing / f"{name}.zip", {**HILL, "agency": HILL["agency"].replace("Hillrail", name)})
    _flagged(landing / "crypt.zip", "stops.txt", flag=1)
    _damaged(landing / "damage.zip", "stop_times.txt")
    _flagged(landing / "method.zip", "trips.txt", method=97)
    (landing / "torn.zip").write_bytes((landing / "torn.zip").read_bytes()[:200])
    latin = landing / "latin.zip"
    with zipfile.ZipFile(latin, "w") as archive:
        for name, text in HILL.items():
            archive.writestr(f"{name}.txt", text.replace("Gipfel", "Höhe").encode("latin-1"))
    refresh_feeds(spark, str(landing), store, progress).awaitTermination()
    assert store.active() is None
    refused = {r.path.rsplit("/", 1)[-1]: (r.stage, r.issues, r.problems) for r in store.rejections().collect()}
    assert refused == {
        "crypt.zip": ("unpacking", 1, "encrypted"),
        "damage.zip": ("unpacking", 1, "damaged"),
        "method.zip": ("unpacking", 1, "unsupported"),
        "torn.zip": ("archive", 1, "not_an_archive"),
        "latin.zip": ("unpacking", 2, "not_utf8"),
    }
    version = store.rejections().filter("path like '%latin.zip'").first().version
    found = {r.member: r.offset for r in store.rejected_issues(version, "unpacking").collect()}
    want = HILL["stops"].replace("Gipfel", "Höhe").encode("latin-1").index("ö".encode("latin-1"))
    assert found["stops.txt"] == want and set(found) == {"stops.txt", "trips.txt"}
    zip_feed(landing / "good.zip", HILL)
    refresh_feeds(spark, str(landing), store, progress).awaitTermination()
    assert store.active() is not None and store.rejections().count() == 5


def test_unpacked_members_keep_their_bytes(spark, tmp_path):
    text = 'stop_id,stop_name\r\na,"two\r\nlines"\r\n' + "".join(f"s{n},é{n}\n" for n in range(400_000))
    path = zip_feed(tmp_path / "feed.zip", {"stops": "\ufeff" + text})
    archives = spark.createDataFrame([("f", path)], "feed_id string, path string")
    unpack_feeds(archive_manifest(archives), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "feed_id=f" / "member=stops.txt").glob("part-*"))
    assert b"".join(part.read_bytes() for part in parts).decode() == text
