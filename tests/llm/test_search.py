from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from haltline.llm import cover_tree
from haltline.llm.cover_tree import top_inner_products

KIND = "vec_id long, embedding array<float>, label int, v int, ids string, query int"


def brute(rows, k, every):
    usable = {}
    for i, vector, *_ in rows:
        if i is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector):
            usable.setdefault(i, set()).add(tuple(int(np.floor(1024 * float(np.float32(x)))) for x in vector))
    flat = [(i, v) for i, vectors in usable.items() for v in vectors]
    found = []
    for query, q in flat:
        if query % every:
            continue
        scores = [
            (-sum(a * b for a, b in zip(q, v, strict=True)), i)
            for i, v in flat
            if i != query and len(v) == len(q)
        ]
        found += [(query, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_best_products(spark, monkeypatch, spread):
    monkeypatch.setattr(cover_tree, "DATA_BLOCK", 40)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", 8)
    monkeypatch.setattr(cover_tree, "PIVOTS", 6)
    monkeypatch.setattr(cover_tree, "LEAF", 8)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(5, 8))
    rows = [(n, (centers[n % 5] + spread * rng.normal(size=8)).tolist(), 0, 1, "x", 2) for n in range(400)]
    rows += [(1000 + n, [0.25] * 8, 0, 1, "x", 2) for n in range(150)]  # a common vector
    rows += [(2000, None, 0, 1, "x", 2), (2010, [0.1] * 7 + [None], 0, 1, "x", 2), (2020, [1.0] * 3, 0, 1, "x", 2)]
    rows += [(2030, [float("nan")] * 8, 0, 1, "x", 2), (2040, [float("inf")] * 8, 0, 1, "x", 2), (None, [1.0] * 8, 0, 1, "x", 2)]
    rows += [(2050, [2.0] * 3, 0, 1, "x", 2), (2060, [-5.0] * 8, 0, 1, "x", 2), (2060, [-5.0] * 8, 0, 1, "x", 2)]
    rng2 = random.Random(1)
    rng2.shuffle(rows)
    table = spark.createDataFrame(rows, KIND)
    got = sorted(tuple(r) for r in top_inner_products(table, k=4, query_every=10).collect())
    assert got == brute(rows, 4, 10)


def test_huge_numbers_stay_exact(spark):
    rows = [(n, [1e5 + n, -3e5, 2e5 + 7 * n], 0, 1, "x", 2) for n in range(30)]
    got = sorted(tuple(r) for r in top_inner_products(spark.createDataFrame(rows, KIND), 5, 10).collect())
    assert got == brute(rows, 5, 10)


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], KIND)
    assert top_inner_products(none).count() == 0
    one = spark.createDataFrame([(0, [1.0], 0, 1, "x", 2)], KIND)
    assert top_inner_products(one).where(F.col("rank") > 0).count() == 0


def test_search_is_dealt_by_blocks_not_by_bytes(spark, monkeypatch):
    met, meet = [], cover_tree._meet
    monkeypatch.setattr(cover_tree, "_meet", lambda *given: met.append(meet(*given)) or met[-1])
    rng = np.random.default_rng(4)
    rows = [(n, rng.normal(size=16).tolist(), 0, 1, "x", 2) for n in range(600)]
    got = sorted(tuple(r) for r in top_inner_products(spark.createDataFrame(rows, KIND), k=3, query_every=10).collect())
    assert got == brute(rows, 3, 10)
    # Few bytes, but many pairs of blocks: no task may get them all.
    tasks = met[1].groupBy(F.spark_partition_id()).count()
    assert tasks.count() > 16


@pytest.mark.parametrize("scale", [3, 300, 1e5, 1e8, 6e8])
def test_trees_give_the_best_of_whatever_size_of_number(monkeypatch, scale):
    monkeypatch.setattr(cover_tree, "PRODUCTS", 200)
    rng = np.random.default_rng(1)
    queries, data = (np.clip(rng.normal(size=(n, 8)) * scale, -1e9, 1e9).astype(np.int64) for n in (70, 500))
    data[::7] //= 50
    ids = rng.permutation(1500)[:500]
    tree = cover_tree.DualTree(queries, np.full(70, cover_tree.NO_SCORE), 5, data, ids)
    found = sorted(zip(*(part.tolist() for part in tree.search()), strict=True))
    scores = queries.astype(object) @ data.T.astype(object)
    best = [sorted((-s, i) for s, i in zip(scores[row], ids.tolist(), strict=True))[:5] for row in range(70)]
    assert found == sorted((row, i, -s) for row in range(70) for s, i in best[row])
