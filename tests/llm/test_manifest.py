from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from haltline.llm.merkle_manifest import (
    digest_of,
    folded,
    prove,
    read_manifest,
    verified_rows,
    write_manifest,
)


def h(*fields) -> str:
    parts = ["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields]
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def joined(digests) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def grow(digests):
    """All levels from the given digests up to the single one."""
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([joined(last[i : i + 16]) for i in range(0, len(last), 16)])
    return levels


def siblings(levels, place):
    for level in levels[:-1]:
        run = place // 16 * 16
        yield level[run:place], level[place + 1 : run + 16]
        place //= 16


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text, altered)."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((h(*row[:5]), row))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for source in order:
        trees[source].sort(key=lambda one: (one[1][0] is not None, one[1][0] or 0, one[0]))
    levels = {source: grow([leaf for leaf, _ in trees[source]]) for source in order}
    top = grow([levels[source][-1][0] for source in order])
    for number, source in enumerate(order):
        for place, (leaf, row) in enumerate(trees[source]):
            node, proof = h(*row[:4], row[5]), []
            for before, after in [*siblings(levels[source], place), *siblings(top, number)]:
                proof += [*before, *after]
                node = joined([*before, node, *after])
            root = top[-1][0]
            yield row[0], leaf, levels[source][-1][0], root, joined(proof), node, node == root


KIND = "doc_id long, source string, lang string, n_chars long, text string, altered string, tree string, rank int"


def table(spark, rows):
    return spark.createDataFrame([(*row, "clash", 0) for row in rows], KIND)


@pytest.mark.parametrize("seed", [1, 2])
def test_proofs_equal_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    sizes = {"a": 300, None: 17, "b": 16, "é": 1, "": 2, "B": 33} | {f"s{n}": 1 for n in range(14)}
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            i = rng.choice([None, rng.randrange(40), rng.randrange(10**12)])
            text = rng.choice([None, "", "Ab é", "x" * 5000, str(rng.random())])
            altered = text.lower() if text and rng.random() < 0.2 else text
            rows.append((i, source, rng.choice([None, "xx"]), rng.choice([None, 3]), text, altered))
    rows += [rows[0]] * 20
    got = verified_rows(table(spark, rows), f"{tmp_path}/m", F.col("altered")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(tuple(row)) for row in brute(rows))
    assert {row.verified for row in got} == {True, False}


def test_only_what_was_asked_for_is_proved(spark, tmp_path):
    rows = [(n, "s" if n % 3 else "t", None, n, str(n), None) for n in range(700)]
    docs = table(spark, rows)
    leaves = docs.select("source", "doc_id", digest_of([F.col("doc_id"), F.col("text")]).alias("leaf"))
    write_manifest(leaves, f"{tmp_path}/m")
    manifest = read_manifest(spark, f"{tmp_path}/m")
    asked = manifest.leaves.filter("doc_id in (5, 699)").select("tree", "rank", "doc_id")
    missing = spark.createDataFrame([("ss", 10**6, -1), ("sx", 0, -1)], asked.schema)
    found = prove(manifest, asked.unionByName(missing).unionByName(asked))
    rows = found.select("doc_id", "found", folded(F.col("found"), F.col("path")).alias("top"), "root").collect()
    assert sorted(row.doc_id for row in rows) == [5, 5, 699, 699]
    assert all(row.top == row.root == manifest.root[0] and row.found == h(row.doc_id, str(row.doc_id)) for row in rows)


def test_records_hold_every_node_once(spark, tmp_path):
    rows = [(1, f"s{n % 4}", None, None, "same", None) for n in range(200)]
    verified_rows(table(spark, rows), f"{tmp_path}/m")
    records = read_manifest(spark, f"{tmp_path}/m").records.collect()
    assert all(joined(row.children) == row.digest for row in records)
    assert len({row.digest for row in records}) == len(records)


def test_one_row_and_none(spark, tmp_path):
    (row,) = verified_rows(table(spark, [(None, None, None, None, None, None)]), f"{tmp_path}/one").collect()
    assert row.leaf == row.root == row.subroot == row.folded_root == h(*[None] * 5)
    assert row.proof_sha256 == joined([]) and row.verified
    assert verified_rows(table(spark, []), f"{tmp_path}/none").count() == 0
