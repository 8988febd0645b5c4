"""Import every new archive that lands in a folder, once, and make it the active version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from haltline.sources.archive import archive_digests
from haltline.sources.feed import FeedError
from haltline.sources.importing import FeedRejected, import_archive
from haltline.sources.store import VersionStore

IMPORT_FORMAT = "f1"
ARCHIVE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def landed_archives(spark: SparkSession, landing: str) -> DataFrame:
    """(path, landed_at) of each archive, one in a batch; no bytes are read here."""
    return (
        spark.readStream.format("binaryFile")
        .schema(ARCHIVE_SCHEMA)
        .option("pathGlobFilter", "*.zip")
        .option("maxFilesPerTrigger", 1)
        .load(landing)
        .select("path", F.col("modificationTime").alias("landed_at"))
    )


def import_landed(store: VersionStore, archives: DataFrame) -> None:
    """Import and activate the archives of one batch that are not the active version.

    A version is named after the digest of its archive. One that breaks the rules, or cannot be read to its
    end, is noted with the stage that refused it and the kinds of problems; the active version stays and later
    archives go on. Any other error is raised, so the batch is tried again.
    """
    landed = archives.join(archive_digests(archives), "path")
    for archive in landed.orderBy("landed_at", "path").collect():
        version = f"{IMPORT_FORMAT}-{archive.digest}"
        if store.active() == version:
            continue
        if not store.is_installed(version):
            try:
                import_archive(store.spark, archive.path, store, version)
            except FeedRejected as refused:
                found = len(refused.issues) + refused.omitted
                store.note_rejection(version, archive.path, refused.stage, found, refused.problems)
                continue
            except FeedError as refused:
                store.note_rejection(version, archive.path, str(refused), 0)
                continue
        store.activate(version)


def refresh_feeds(
    spark: SparkSession, landing: str, store: VersionStore, progress: str
) -> StreamingQuery:
    """Work through everything that landed since the last call, then stop.

    A refused archive leaves the active version as it is and is listed in `store.rejections()`. A batch
    that fails for another reason is tried again by the next call, since `progress` only moves on after a
    batch is done.
    """
    return (
        landed_archives(spark, landing)
        .writeStream.option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, _: import_landed(store, batch))
        .start()
    )
