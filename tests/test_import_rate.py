from __future__ import annotations

import os

import pytest

from tools.import_rate import import_rate

TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the given tables")
def test_the_bench_feed_is_imported(spark):
    took, calls = import_rate(spark, TABLES, copies=2)
    given = spark.read.parquet(f"{TABLES}/lineitem.parquet").count()
    assert took > 0 and calls == 2 * given
