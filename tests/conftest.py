from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from tests.feeds import HARBOUR, HILL, write_feed


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("haltline-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        # Plans here are large and data tiny: skip compiling them and tracing call sites.
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hill_folder(tmp_path):
    def build(**overrides: str) -> str:
        return write_feed(tmp_path / "feed", {**HILL, **overrides})

    return build


@pytest.fixture
def harbour_folder(tmp_path):
    return write_feed(tmp_path / "harbour", HARBOUR)
