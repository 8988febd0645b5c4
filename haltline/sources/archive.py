"""Feed archives: what is in them, what must be in them, and unpacking."""

from __future__ import annotations

import hashlib
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltline.schema import REQUIRED_FILES

BLOCK_BYTES = 4 << 20
# Absolute, upward, with a drive letter or a NUL: not a name inside the archive.
UNSAFE_NAME = r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)|\x00"


def feed_file_issues(
    manifest: DataFrame,
    max_files: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """manifest(feed_id, member, size) of many archives to (feed_id, problem, member).

    An archive may hold any number of files of any size unless the caller sets an upper end.
    """
    nested = F.col("member").rlike(UNSAFE_NAME) | F.col("member").contains("/")
    bad_paths = manifest.filter(nested).select(
        "feed_id", F.lit("invalid_path").alias("problem"), "member"
    )
    repeated = (
        manifest.groupBy("feed_id", "member")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select("feed_id", F.lit("duplicate_file").alias("problem"), "member")
    )
    known = [f"{name}.txt" for name in (*REQUIRED_FILES, "calendar", "calendar_dates")]
    totals = manifest.groupBy("feed_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("bytes"),
        # Only seven names can be collected, however many members there are.
        F.collect_set(F.when(F.col("member").isin(known), F.col("member"))).alias("present"),
    )
    has_calendar = F.arrays_overlap(
        "present", F.array(F.lit("calendar.txt"), F.lit("calendar_dates.txt"))
    )
    missing = F.transform(
        F.array_except(
            F.array(*(F.lit(f"{name}.txt") for name in REQUIRED_FILES)), F.col("present")
        ),
        lambda member: F.struct(F.lit("missing_file").alias("problem"), member.alias("member")),
    )

    def when(condition, problem: str, member: str):
        return F.when(
            condition,
            F.struct(F.lit(problem).alias("problem"), F.lit(member).alias("member")),
        )

    whole = F.array_compact(
        F.array(
            when(_beyond("files", max_files), "too_many_files", ""),
            when(_beyond("bytes", max_bytes), "too_large", ""),
            when(~has_calendar, "missing_file", "calendar.txt or calendar_dates.txt"),
        )
    )
    per_feed = totals.select(
        "feed_id", F.explode(F.concat(whole, missing)).alias("issue")
    ).select("feed_id", "issue.*")
    return bad_paths.unionByName(repeated).unionByName(per_feed)


def _beyond(column: str, bound: int | None) -> Column:
    return F.lit(False) if bound is None else F.col(column) > bound


def _input(uri: str) -> pa.NativeFile:
    # Hadoop writes local paths as file:/path, which is not a URI pyarrow accepts.
    local = re.sub(r"^file:/+", "/", uri)
    system, path = fs.FileSystem.from_uri(local)
    return system.open_input_file(path)


def _open(uri: str) -> zipfile.ZipFile:
    return zipfile.ZipFile(_input(uri))


def archive_digests(archives: DataFrame) -> DataFrame:
    """archives(path) to (path, digest): SHA-256 of the bytes, read block by block."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                digest = hashlib.sha256()
                with _input(path) as file:
                    while block := file.read(BLOCK_BYTES):
                        digest.update(block)
                yield pd.DataFrame({"path": [path], "digest": [digest.hexdigest()]})

    spread = archives.select("path").repartition(F.col("path"))
    return spread.mapInPandas(digests, "path string, digest string")


#: What zipfile raises for bytes that are no readable archive; errors of the file system are not among them.
_TORN = (zipfile.BadZipFile, NotImplementedError, EOFError, struct.error, ValueError)


def archive_manifest(archives: DataFrame) -> DataFrame:
    """archives(feed_id, path) to (feed_id, path, member, size, problem). Only directories are read.

    An archive without a readable directory has one row, with a problem and no member.
    """

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                problem, entries = None, []
                try:
                    with _open(row.path) as archive:
                        entries = [entry for entry in archive.infolist() if not entry.is_dir()]
                except _TORN:
                    problem = "not_an_archive"
                found = [(entry.filename, entry.file_size, None) for entry in entries]
                yield pd.DataFrame(
                    [(row.feed_id, row.path, *one) for one in found or [(None, None, problem)] if found or problem],
                    columns=["feed_id", "path", "member", "size", "problem"],
                ).astype({"size": "Int64"})

    schema = "feed_id string, path string, member string, size long, problem string"
    spread = archives.select("feed_id", "path").repartition(F.col("path"))
    return spread.mapInPandas(members, schema)


#: The folder beside a feed's members that faults are written to; no member is named so, all end in .txt.
FAULTS = "faults"


def unpack_feeds(manifest: DataFrame, target: str) -> DataFrame:
    """Write every listed member as text under `target/feed_id=…/member=…`.

    One task per member streams it in blocks of whole lines, so memory does not grow with the file,
    and a lost task only repeats its own member. Bytes stay as they are but for a byte order mark.

    Returns (feed_id, member, problem, offset) of members that could not be read to their end: `not_utf8`,
    `damaged`, `encrypted` or `unsupported`, and how many bytes were good. No member stops the others.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                done = 0
                try:
                    with _open(row["path"]) as archive:
                        entry = archive.getinfo(row["member"])
                        if entry.flag_bits & 1:
                            yield _fault(row, "encrypted", 0)
                            continue
                        with archive.open(entry) as member:
                            for block, cut in _whole_lines(member):
                                text = block.decode("utf-8")
                                text = text if done else text.removeprefix("\ufeff")
                                yield _rows(row["feed_id"], row["member"], text.split("\n"))
                                done += len(block) + cut
                except UnicodeDecodeError as bad:
                    yield _fault(row, "not_utf8", done + bad.start)
                except NotImplementedError:
                    yield _fault(row, "unsupported", done)
                except (*_TORN, zlib.error):
                    yield _fault(row, "damaged", done)

    def _whole_lines(member) -> Iterator[tuple[bytes, int]]:
        """Blocks without their last line break, and how long that is."""
        rest = b""
        while block := member.read(BLOCK_BYTES):
            whole, cut, rest = (rest + block).rpartition(b"\n")
            if cut:
                yield whole, 1
        if rest:
            yield rest, 0

    def _fault(row: dict[str, str], problem: str, offset: int) -> pa.RecordBatch:
        return _rows(row["feed_id"], FAULTS, [f"{problem} {offset} {row['member']}"])

    def _rows(feed_id: str, member: str, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([feed_id] * len(texts), pa.string()),
                pa.array([member] * len(texts), pa.string()),
                pa.array(texts, pa.string()),
            ],
            ["feed_id", "member", "value"],
        )

    one_per_member = manifest.select("feed_id", "path", "member").repartition(
        F.col("feed_id"), F.col("member")
    )
    (
        one_per_member.mapInArrow(lines, "feed_id string, member string, value string")
        .write.mode("overwrite")
        .partitionBy("feed_id", "member")
        .text(target)
    )
    part = F.split("value", " ", 3)
    return (
        manifest.sparkSession.read.schema("value string, feed_id string, member string")
        .text(target)
        .filter(F.col("member") == FAULTS)
        .select(
            "feed_id",
            part[2].alias("member"),
            part[0].alias("problem"),
            part[1].cast("long").alias("offset"),
        )
    )
