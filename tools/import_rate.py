"""Time the import of a large CSV feed: read, validate, normalise, group and publish.

The feed is the bench feed with every trip repeated COPIES times, written as CSV first.
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from haltline.functions import gtfs_time_text  # noqa: E402
from haltline.plans.benchfeed import bench_feed  # noqa: E402
from haltline.sources.importing import import_feed  # noqa: E402
from haltline.sources.store import VersionStore  # noqa: E402


def publishable(name: str, rows: DataFrame, stops: DataFrame) -> DataFrame:
    """The rows that a feed may hold: the bench feed has a feed_info row for each region, and its last part
    has a transfer to a part that does not exist."""
    if name == "feed_info":
        return rows.orderBy("row_no").limit(1)
    if name == "transfers":
        known = stops.select("stop_id")
        rows = rows.join(known.withColumnRenamed("stop_id", "from_stop_id"), "from_stop_id", "left_semi")
        return rows.join(known.withColumnRenamed("stop_id", "to_stop_id"), "to_stop_id", "left_semi")
    return rows


def as_text(df: DataFrame) -> DataFrame:
    for name, kind in df.dtypes:
        if name in ("arrival_time", "departure_time"):
            df = df.withColumn(name, gtfs_time_text(F.col(name)))
        elif kind == "date":
            df = df.withColumn(name, F.date_format(name, "yyyyMMdd"))
    return df.drop("row_no")


def import_rate(spark: SparkSession, sf_dir: str, copies: int) -> tuple[float, int]:
    """Seconds that the import takes, and its stop times."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    feed = bench_feed(spark, sf_dir)
    again = F.explode(F.sequence(F.lit(1), F.lit(copies)))
    for name, df in feed.files():
        rows = as_text(publishable(name, df, feed.stops))
        if name in ("trips", "stop_times"):
            if name == "stop_times":
                rows = rows.repartition(8, "trip_id").sortWithinPartitions("trip_id", "stop_sequence")
            else:
                rows = rows.repartition(8, "trip_id")
            # Copy by copy, so that the calls of a trip stay in order in the file.
            rows = rows.withColumn("copy", again).withColumn(
                "trip_id", F.concat_ws("-", "trip_id", "copy")
            )
            keys = ["trip_id", "stop_sequence"] if name == "stop_times" else ["trip_id"]
            rows = rows.repartitionByRange(8, "trip_id").sortWithinPartitions(*keys).drop("copy")
        elif name == "shapes":
            rows = rows.coalesce(1).sortWithinPartitions("shape_id", "shape_pt_sequence")
        else:
            rows = rows.coalesce(1)
        rows.write.option("header", True).option("emptyValue", "").csv(f"{folder}/feed/{name}.txt")
    store = VersionStore(spark, f"{folder}/store")
    started = time.time()
    counts = {row.table_name: row.n for row in import_feed(spark, f"{folder}/feed", store, "v1").collect()}
    return time.time() - started, counts["stop_times"]


def main() -> None:
    copies = int(os.environ.get("COPIES", "10"))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "32")
        .config("spark.driver.memory", "14g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, calls = import_rate(spark, sf_dir, copies)
    print(f"import of {calls} stop times {took:.1f} s, {calls / took:.0f} a second")


if __name__ == "__main__":
    main()
