"""Published timetable versions: Parquet folders plus two small append-only tables."""

from __future__ import annotations

import re
import time
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from haltline.functions import iso_date
from haltline.operators.indexes import INDEX_CLUSTERING, build_indexes
from haltline.schema import SCHEMA_VERSION, Timetable
from haltline.session import cut_lineage, side_by_side
from haltline.sources.feed import feed_counts

VERSION_PATTERN = re.compile(r"[A-Za-z0-9._-]{1,128}")

# How each table is laid out. Range partitions over the second key as well, so a stop or shape
# with a third of all rows is spread over many files; the sort lets Parquet skip row groups.
CLUSTERING = {
    "stop_times": ("stop_id", "departure_seconds", "trip_id"),
    "trips": ("route_id", "trip_id"),
    "shape_points": ("shape_id", "sequence"),
    "stops": ("stop_id",),
    "stop_groups": ("group_id",),
    "stop_group_members": ("group_id", "stop_id"),
}
ROW_GROUP_BYTES = 32 << 20


class VersionError(ValueError):
    """The version cannot be published or activated."""


def check_version(version: str) -> str:
    if not VERSION_PATTERN.fullmatch(version) or version in {".", ".."}:
        raise VersionError(f"not a version label: {version!r}")
    return version


def schedule_metadata(entries: DataFrame, feed_info: DataFrame) -> DataFrame:
    """entries(key, value) with every row of feed_info; without feed_info its columns are NULL."""
    row = entries.agg(
        F.max(F.when(F.col("key") == "schedule_version", F.col("value"))).alias(
            "schedule_version"
        ),
        F.max(F.when(F.col("key") == "imported_at_unix", F.col("value")))
        .try_cast("long")
        .alias("imported_at_unix"),
    ).withColumn("one", F.lit(1))
    feed = feed_info.withColumns(
        {
            "one": F.lit(1),
            "start_date": iso_date(F.col("start_date")),
            "end_date": iso_date(F.col("end_date")),
        }
    )
    return row.join(feed, "one", "left").drop("one")


class VersionStore:
    """Versions under one root folder, which all executors must reach.

    A version becomes visible when its row is appended to `versions`, after all of its tables
    were written and read back. A folder without that row is leftover work and never read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return jvm_path.getFileSystem(conf).exists(jvm_path)

    def _log(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _append(self, name: str, schema: str, row: tuple) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(
            f"{self.root}/{name}"
        )

    _VERSIONS = "version string, schema_version int, installed_at long"
    _ACTIVATIONS = "version string, activated_at long, seq long"

    def versions(self) -> DataFrame:
        return self._log("versions", self._VERSIONS)

    def is_installed(self, version: str) -> bool:
        return not self.versions().filter(F.col("version") == version).isEmpty()

    def _table_path(self, version: str, table: str) -> str:
        return f"{self.root}/data/version={version}/{table}"

    def publish(
        self,
        version: str,
        timetable: Timetable,
        groups: DataFrame | None = None,
        members: DataFrame | None = None,
    ) -> DataFrame:
        """Write all tables and indexes, check columns and row counts, then list the version.

        Returns rows per table.
        """
        check_version(version)
        if self.is_installed(version):
            raise VersionError(f"version already exists: {version}")
        tables = dict(timetable.tables())
        indexes = build_indexes(timetable)
        if groups is not None and members is not None:
            tables |= {"stop_groups": groups, "stop_group_members": members}
        entries = [("schedule_version", version), ("imported_at_unix", str(int(time.time())))]
        tables["feed_metadata"] = self.spark.createDataFrame(entries, "key string, value string")
        everything = tables | indexes
        sent = {name: Observation() for name in everything}

        def write(name: str) -> None:
            df, keys = everything[name], (CLUSTERING | INDEX_CLUSTERING).get(name)
            if keys:
                df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
            df = df.observe(sent[name], F.count(F.lit(1)).alias("n"))
            # An unlisted folder of the same name is a failed attempt and is replaced. Row groups are what a
            # request for few keys reads at least.
            df.write.option("parquet.block.size", ROW_GROUP_BYTES).mode("overwrite").parquet(
                self._table_path(version, name)
            )

        side_by_side([partial(write, name) for name in everything])
        if sent["calls_by_trip"].get["n"] != sent["stop_times"].get["n"]:
            raise VersionError("calls_by_trip was not written as expected")
        written = {name: self.read_table(version, name) for name in tables}
        counts = cut_lineage(feed_counts(written))
        found = {row.table_name: row.n for row in counts.collect()}
        for name, df in written.items():
            if df.columns != tables[name].columns or found[name] != sent[name].get["n"]:
                raise VersionError(f"{name} was not written as expected")
        self._append(
            "versions", self._VERSIONS, (version, SCHEMA_VERSION, int(time.time()))
        )
        return counts

    def keep_rejected(self, version: str, stage: str, issues: DataFrame) -> DataFrame:
        """Write all issues of a rejected import; a later attempt of the same version replaces them."""
        path = f"{self.root}/rejected/version={version}/{stage.replace(' ', '_')}"
        issues.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(issues.schema).parquet(path)

    def rejected_issues(self, version: str, stage: str) -> DataFrame:
        """All issues that `stage` found in a rejected version."""
        return self.spark.read.parquet(
            f"{self.root}/rejected/version={version}/{stage.replace(' ', '_')}"
        )

    _REJECTIONS = "version string, path string, stage string, issues long, rejected_at long, problems string"

    def note_rejection(self, version: str, path: str, stage: str, issues: int, problems: str = "") -> None:
        row = (version, path, stage, issues, int(time.time()), problems)
        self._append("rejections", self._REJECTIONS, row)

    def rejections(self) -> DataFrame:
        """Publications that were refused, with the stage that refused them and the kinds of what it found."""
        return self._log("rejections", self._REJECTIONS)

    def activate(self, version: str) -> None:
        listed = self.versions().filter(F.col("version") == check_version(version))
        if listed.isEmpty():
            raise VersionError(f"version is not installed: {version}")
        if not listed.filter(F.col("schema_version") != SCHEMA_VERSION).isEmpty():
            raise VersionError(f"version has another schema: {version}")
        last = self._activations().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        self._append("activations", self._ACTIVATIONS, (version, int(time.time()), last + 1))

    def _activations(self) -> DataFrame:
        return self._log("activations", self._ACTIVATIONS)

    def active(self) -> str | None:
        row = self._activations().agg(F.max_by("version", "seq")).first()
        return row[0]

    def installed_versions(self) -> DataFrame:
        """(version, state) with state `active` or `installed`, by label."""
        current = self._activations().agg(F.max_by("version", "seq")).scalar()
        state = F.when(F.col("version") == current, "active").otherwise("installed")
        return self.versions().select("version", state.alias("state")).orderBy("version")

    def read_table(self, version: str, table: str) -> DataFrame:
        return self.spark.read.parquet(self._table_path(version, table))

    def read(self, version: str | None = None) -> Timetable:
        """The tables of a version, by default the active one."""
        version = version or self.active()
        if version is None:
            raise VersionError("no version is active")
        if not self.is_installed(version):
            raise VersionError(f"version is not installed: {version}")
        tables = {name: self.read_table(version, name) for name in Timetable.table_names()}
        indexes = {
            name: self.read_table(version, name)
            for name in INDEX_CLUSTERING
            if self._exists(self._table_path(version, name))
        }
        return Timetable.from_tables(tables, indexes)

    def read_groups(self, version: str | None = None) -> tuple[DataFrame, DataFrame]:
        """The stop groups of a version and their members, as stored when it was published."""
        version = version or self.active()
        if version is None or not self.is_installed(version):
            raise VersionError(f"version is not installed: {version}")
        return (
            self.read_table(version, "stop_groups"),
            self.read_table(version, "stop_group_members"),
        )
