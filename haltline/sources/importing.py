"""From a published feed to an installed version, all or nothing."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from haltline.operators.groups import derive_stop_groups
from haltline.operators.load import normalize_feed
from haltline.operators.validation import staged, validate
from haltline.schema import GTFS_COLUMNS
from haltline.session import cut_lineage
from haltline.sources.archive import archive_manifest, feed_file_issues, unpack_feeds
from haltline.sources.feed import (
    FeedError,
    read_text_feed,
    typed_feed,
    unreadable_records,
)
from haltline.sources.store import VersionError, VersionStore, check_version

#: Issues that the exception shows.
SHOWN_ISSUES = 100


class FeedRejected(FeedError):
    """The feed broke rules. `issues` shows the first of them, `omitted` counts the others.

    All of them are in the store, see `VersionStore.rejected_issues`.
    """

    def __init__(self, stage: str, issues: list[Row], total: int):
        self.stage, self.issues, self.omitted = stage, issues, total - len(issues)
        kinds = {row.asDict().get("problem") or row.asDict().get("code") for row in issues} - {None}
        self.problems = ", ".join(sorted(kinds))
        super().__init__(f"{stage}: {len(issues)} issues, {self.omitted} more")


def _reject_if_any(
    store: VersionStore, version: str, stage: str, issues: DataFrame, order: list[str]
) -> None:
    issues = cut_lineage(issues)
    if issues.isEmpty():
        return
    kept = store.keep_rejected(version, stage, issues)
    raise FeedRejected(stage, kept.orderBy(*order).limit(SHOWN_ISSUES).collect(), kept.count())


def import_feed(
    spark: SparkSession, folder: str, store: VersionStore, version: str
) -> DataFrame:
    """Read, check, normalise, group and publish one feed folder. Returns rows per table.

    The files are parsed once; a row keeps the number of its unreadable values beside it.
    """
    check_version(version)
    if store.is_installed(version):
        raise VersionError(f"version already exists: {version}")
    texts = read_text_feed(spark, folder)
    feed = staged(typed_feed(texts, count_unreadable=True))
    unreadable = [
        df.agg(F.sum("unreadable").alias("n")) for _, df in feed.files() if "unreadable" in df.columns
    ]
    total = unreadable[0]
    for part in unreadable[1:]:
        total = total.unionByName(part)
    if total.agg(F.sum("n")).first()[0]:
        order = ["file", "row_no", "column"]
        _reject_if_any(store, version, "unreadable values", unreadable_records(texts), order)
    timetable = normalize_feed(feed)
    with ThreadPoolExecutor(1) as beside:
        # Groups only need the stops; they are used if the feed turns out to be valid.
        grouped = beside.submit(derive_stop_groups, timetable.stops)
        _reject_if_any(store, version, "validation", validate(feed), ["code", "record", "message"])
        groups, members = grouped.result()
    return store.publish(version, timetable, groups, members)


def import_archive(
    spark: SparkSession,
    path: str,
    store: VersionStore,
    version: str,
    max_files: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """As `import_feed` for a ZIP archive any executor can open, of any size unless bounds are set.

    An archive that cannot be read, or a member that is damaged, encrypted, packed in an unknown way or no
    UTF-8, refuses the feed like a broken rule does.
    """
    check_version(version)
    if store.is_installed(version):
        raise VersionError(f"version already exists: {version}")
    archives = spark.createDataFrame([(version, path)], "feed_id string, path string")
    manifest = cut_lineage(archive_manifest(archives))
    torn = manifest.filter(F.col("problem").isNotNull()).select("feed_id", "problem", "member")
    _reject_if_any(store, version, "archive", torn, ["problem"])
    issues = feed_file_issues(manifest, max_files, max_bytes)
    _reject_if_any(store, version, "archive", issues, ["problem", "member"])
    known = [f"{name}.txt" for name in (*GTFS_COLUMNS, "frequencies")]
    target = f"{store.root}/unpacked/{version}"
    faults = unpack_feeds(manifest.filter(F.col("member").isin(known)), target)
    _reject_if_any(store, version, "unpacking", faults, ["member", "problem"])
    return import_feed(spark, f"{target}/feed_id={version}", store, version)
