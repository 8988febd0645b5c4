"""Rules over the large files: how often records are shuffled, and that short cuts change no issue."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from haltline.operators import validation


@pytest.mark.parametrize("long_group", [1 << 20, 40, 0])
def test_sequences_are_read_in_one_shuffle_unless_a_group_is_long(spark, monkeypatch, long_group):
    monkeypatch.setattr(validation, "LONG_GROUP", long_group, raising=False)
    monkeypatch.setattr(validation, "ROWS_PER_CHUNK_BITS", 3)
    rng = random.Random(4)
    rows = [(f"g{rng.randrange(9)}" if rng.random() < 0.4 else "long", n, rng.randrange(30)) for n in range(300)]
    given = spark.createDataFrame(rows, "g string, row_no long, v long")
    found = validation._not_increasing(given, "g", "v")
    want, last = [], {}
    for group, number, value in rows:
        if group in last and value <= last[group]:
            want.append((group, number, value))
        last[group] = value
    assert want and sorted(map(tuple, found.select("g", "row_no", "v").collect())) == sorted(want)
    if long_group > len(rows):
        executed = found._jdf.queryExecution().executedPlan().toString()
        assert executed.count("Exchange hashpartitioning") == 1


def test_unknown_references_take_one_pass(spark):
    rows = spark.createDataFrame(
        [("a", "x"), ("b", ""), ("a", "y"), ("q", None), (None, "x"), ("q", "y")], "one string, two string"
    )
    ones = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    twos = spark.createDataFrame([("x",)], "k string")
    found = validation._unknown_references(rows, [("one", ones, "k"), ("two", twos, "k")], optional=["two"])
    flags = [F.coalesce(f"no_{name}", F.lit(False)).alias(name) for name in ("one", "two")]
    got = sorted((r.one or "-", r.two or "-", r[2], r[3]) for r in found.select("one", "two", *flags).collect())
    assert got == [
        ("-", "x", False, False),
        ("a", "x", False, False),
        ("a", "y", False, True),
        ("b", "-", False, False),
        ("q", "-", True, False),
        ("q", "y", True, True),
    ]
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
