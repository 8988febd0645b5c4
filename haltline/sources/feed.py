"""GTFS text files to typed DataFrames."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haltline.functions import gtfs_date, gtfs_seconds, strict_double, strict_long
from haltline.schema import GTFS_COLUMNS, REQUIRED_FILES, Feed

MAX_BYTE, MAX_SHORT, MAX_INT = 255, 65_535, 4_294_967_295
FILE_ORDINAL_SHIFT = 44
BIG_FILES = ("stop_times", "shapes")


class FeedError(ValueError):
    """The feed cannot be read as published."""


def _kind(declared: str) -> str:
    return declared.rstrip("!?")


def _parsed(column: Column, declared: str) -> Column:
    """Typed value of a text column; NULL for anything unreadable."""
    kind = _kind(declared)
    if kind == "text":
        return F.coalesce(column, F.lit(""))
    if kind == "byte":
        return strict_long(column, MAX_BYTE).cast("int")
    if kind == "short":
        return strict_long(column, MAX_SHORT).cast("int")
    if kind == "int":
        return strict_long(column, MAX_INT)
    if kind == "double":
        return strict_double(column)
    return gtfs_date(column) if kind == "date" else gtfs_seconds(column)


# Value of a column that the header does not have.
ABSENT_DEFAULTS = {"transfer_type": "0"}


def text_records(raw: DataFrame, file: str) -> DataFrame:
    """All known columns of `file` as text, bound by header name, plus `row_no`."""
    present = {name.lower() for name in raw.columns}
    missing = [
        name
        for name, declared in GTFS_COLUMNS[file].items()
        if declared.endswith("!") and name not in present
    ]
    if missing and not raw.isEmpty():
        raise FeedError(f"{file}: the header lacks {', '.join(missing)}")
    return raw.select(
        *(
            F.col(name).cast("string")
            if name in present
            else F.lit(ABSENT_DEFAULTS.get(name)).cast("string").alias(name)
            for name in GTFS_COLUMNS[file]
        ),
        F.col("row_no").cast("long"),
    )


def typed_records(texts: DataFrame, file: str, count_unreadable: bool = False) -> DataFrame:
    """Typed values of a file, optionally with how many of each row could not be read."""
    declared_columns = GTFS_COLUMNS[file]
    typed = texts.select(
        *(_parsed(F.col(name), declared).alias(name) for name, declared in declared_columns.items()),
        "row_no",
        *(F.col(name).alias(f"text_{name}") for name in declared_columns),
    )
    faults = [
        _unreadable(F.col(name), F.col(f"text_{name}"), declared).cast("int")
        for name, declared in declared_columns.items()
        if _kind(declared) != "text"
    ]
    count = [reduce(add, faults).alias("unreadable")] if count_unreadable and faults else []
    return typed.select(*declared_columns, *count, "row_no")


def _unreadable(parsed: Column, text: Column, declared: str) -> Column:
    """There is no value although the text should hold one."""
    if declared.endswith("?"):
        return parsed.isNull() & (F.coalesce(text, F.lit("")) != "")
    return parsed.isNull()


def unreadable_values(texts: DataFrame, file: str) -> DataFrame:
    """One row per value that cannot be read as its declared type."""
    faults = []
    for name, declared in GTFS_COLUMNS[file].items():
        if _kind(declared) == "text":
            continue
        value = F.coalesce(F.col(name), F.lit(""))
        faults.append(
            F.when(
                _unreadable(_parsed(F.col(name), declared), F.col(name), declared),
                F.struct(F.lit(name).alias("column"), value.alias("value")),
            )
        )
    schema = "file string, row_no long, column string, value string"
    if not faults:
        return texts.sparkSession.createDataFrame([], schema)
    return (
        texts.select("row_no", F.explode(F.array_compact(F.array(*faults))).alias("fault"))
        .select(
            F.lit(file).alias("file"),
            F.col("row_no"),
            F.col("fault.column").alias("column"),
            F.col("fault.value").alias("value"),
        )
    )


def _paths_of(spark: SparkSession, folder: str) -> dict[str, str]:
    """Entries of a feed folder by file stem, seen through Hadoop so any file system works."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(jvm_path):
        raise FeedError(f"no such folder: {folder}")
    # Unpacked archives keep each file in a folder named member=<file>.txt.
    return {
        status.getPath().getName().removeprefix("member=").removesuffix(".txt"): (
            status.getPath().toString()
        )
        for status in system.listStatus(jvm_path)
        if status.getPath().getName().endswith(".txt")
    }


#: About 10 MB of names.
MOST_BROADCAST_PARTS = 100_000


def _with_row_no(records: DataFrame) -> DataFrame:
    """Number rows in file order without a shuffle.

    A split is one task, every row takes at least one byte, so split offset plus position in
    the split rises strictly through the file. Several part files are ordered by name; their
    list is broadcast up to `MOST_BROADCAST_PARTS` of them and joined by name beyond.
    """
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    number = F.col("_metadata.file_block_start") + position
    files = sorted(records.inputFiles())
    if len(files) < 2:
        return records.withColumn("row_no", number)
    ordinals = records.sparkSession.createDataFrame(
        [(path.rsplit("/", 1)[-1], index) for index, path in enumerate(files)],
        "part_name string, part_ordinal long",
    )
    return (
        records.withColumn("row_no", number)
        .withColumn("part_name", F.col("_metadata.file_name"))
        .join(F.broadcast(ordinals) if len(files) <= MOST_BROADCAST_PARTS else ordinals, "part_name")
        .withColumn("row_no", F.shiftleft("part_ordinal", FILE_ORDINAL_SHIFT) + F.col("row_no"))
        .drop("part_name", "part_ordinal")
    )


def read_text_feed(
    spark: SparkSession, folder: str, multiline_big_files: bool = False
) -> dict[str, DataFrame]:
    """Known files of the feed as text records.

    The two big files are read splittable, so they must not hold quoted line breaks unless
    `multiline_big_files` is set.
    """
    paths = _paths_of(spark, folder)
    absent = [name for name in REQUIRED_FILES if name not in paths]
    if absent:
        raise FeedError(f"missing files: {', '.join(absent)}")
    if "calendar" not in paths and "calendar_dates" not in paths:
        raise FeedError("missing files: calendar or calendar_dates")
    texts = {}
    for file in (*GTFS_COLUMNS, "frequencies"):
        if file not in paths:
            columns = GTFS_COLUMNS.get(file, {})
            schema = T.StructType(
                [T.StructField(name, T.StringType()) for name in columns]
                + [T.StructField("row_no", T.LongType())]
            )
            texts[file] = spark.createDataFrame([], schema)
            continue
        records = (
            spark.read.option("header", True)
            .option("escape", '"')
            .option("mode", "PERMISSIVE")
            .option("multiLine", file not in BIG_FILES or multiline_big_files)
            .csv(paths[file])
        )
        numbered = _with_row_no(records)
        texts[file] = (
            text_records(numbered, file)
            if file in GTFS_COLUMNS
            else numbered.select("row_no")
        )
    return texts


def typed_feed(texts: dict[str, DataFrame], count_unreadable: bool = False) -> Feed:
    """Typed records of each file, optionally with how many values could not be read."""
    return Feed(
        **{file: typed_records(texts[file], file, count_unreadable) for file in GTFS_COLUMNS},
        frequencies=texts["frequencies"],
    )


def read_feed(spark: SparkSession, folder: str, multiline_big_files: bool = False) -> Feed:
    return typed_feed(read_text_feed(spark, folder, multiline_big_files))


def unreadable_records(texts: dict[str, DataFrame]) -> DataFrame:
    """Every value of the feed that is not readable; any row here fails the import."""
    parts = [unreadable_values(texts[file], file) for file in GTFS_COLUMNS if file in texts]
    issues = parts[0]
    for part in parts[1:]:
        issues = issues.unionByName(part)
    return issues


def has_records(records: DataFrame) -> bool:
    return not records.isEmpty()


def feed_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows per file or table in one job; empty ones count 0."""
    counts = [
        frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, frame in frames.items()
    ]
    result = counts[0]
    for part in counts[1:]:
        result = result.unionByName(part)
    return result
