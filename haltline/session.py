"""What the library needs from a session: a shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's `spark.checkpoint.dir`; fall back to a local one in local mode only."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_table(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it from there.

    Later passes then read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Jobs that run beside one another: small ones leave most executors idle.
BESIDE = 6


def side_by_side(actions: Iterable[Callable[[], Any]]) -> list[Any]:
    """Results of independent actions, in order, whose Spark jobs share the cluster. The first error is raised."""
    with ThreadPoolExecutor(BESIDE) as pool:
        return list(pool.map(lambda action: action(), actions))
