from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest

from haltline.llm import periodic_runs as runs
from haltline.llm import queries


def brute(words):
    """All runs by comparing every word with those some words on."""
    found = set()
    for period in range(1, len(words) // 4 + 1):
        place = 0
        while place + period < len(words):
            start = place
            while place + period < len(words) and words[place] == words[place + period]:
                place += 1
            length = place - start + period
            if length >= max(6, 4 * period) and not any((start, length, p) in found for p in range(1, period)):
                found.add((start, length, period))
            place = max(place, start + 1)
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words, found):
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(word for i, word in enumerate(words) if i not in gone)


def random_words(rng):
    words = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.choice([0, 3, 7, 40, 150]))]
    if words and rng.random() < 0.6:
        first = rng.randrange(len(words))
        period = 1 + (len(words) - first) // rng.randint(3, 10)
        words = [*words[:first], *(words[first + i % period] for i in range(len(words) - first))]
    return words


def test_runs_equal_brute_force(spark, documents):
    rng = random.Random(3)
    texts = [rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t", " \n "]).join(random_words(rng)) for _ in range(300)]
    texts += ["", None, " \x0b\x0c ", "a", "a " * 6, "a " * 5, "x x " * 7, "　é " * 9, "ab" * 5000]
    texts += ["one two three " * 400 + "end", "a b c a b c a b c a b c d " * 30, "same line " * 4, "same line " * 4]
    rows = [*enumerate(texts), (None, "q q q q q q"), (0, "p q " * 3)]
    got = runs.periodic_runs(documents(rows)).collect()
    want = []
    for i, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        found = brute(words)
        want.append((repr(i), len(words), found, collapsed(words, found)))
    assert sorted((repr(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted(want)


def test_stretches_share_trees_or_have_their_own(monkeypatch):
    rng = random.Random(8)
    texts = pa.array([" ".join(random_words(rng)) for _ in range(60)])
    whole = runs._collapse(texts)
    for words in (1, 50):
        monkeypatch.setattr(runs, "TREE_WORDS", words)
        assert [one.to_pylist() for one in runs._collapse(texts)] == [one.to_pylist() for one in whole]


def test_suffix_tree_orders_suffixes_and_extends():
    rng = random.Random(5)
    import numpy as np

    for _ in range(30):
        text = [rng.randint(1, 3) for _ in range(rng.randint(1, 60))] + [0]
        tree = runs.SuffixTree(text, 4)
        order, parted = tree.tour(np.arange(4))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        common = lambda a, b: next(k for k in range(99) if text[a + k] != text[b + k])
        assert parted.tolist() == [common(a, b) for a, b in zip(order[:-1], order[1:], strict=True)]
        pairs = [(a, b) for a in range(len(text)) for b in range(a)]
        left, right = np.array(pairs).T if pairs else np.empty((2, 0), int)
        found = runs.Extensions(order, parted).of(left, right) if pairs else left
        assert found.tolist() == [common(b, a) for a, b in pairs]


def crc(n):
    import zlib

    return zlib.crc32(str(n).encode())


@pytest.fixture
def folder(spark, tmp_path, documents):
    rng = random.Random(6)
    rows = [(n, " ".join(random_words(rng))) for n in range(300)]
    looped = [n for n in range(300, 900) if crc(n) % 10 == 0]
    rows += [(n, None if n % 3 == 0 else " " if n % 3 == 1 else "a b\tc d e") for n in looped[:9]]
    rows.append((None, "a a a a a a b"))
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), rows


def test_query_equals_its_contract(spark, folder):
    path, rows = folder
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = []
    for i, text in rows:
        words = (text or "").split()
        if i is not None and crc(i) % 10 == 0 and words:
            g = crc(i) // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        found = brute(words)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
        power = 1000 * best[1] // best[2] if found else None
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want.append((repr(i), len(found), *best, power, sha(lines), sha(collapsed(words, found))))
    got = queries.op13_periodic_runs(spark, path).drop("n_words").collect()
    assert sorted((repr(row[0]), *row[1:]) for row in got) == sorted(want, key=lambda row: row[0])


def test_no_rows(documents):
    assert runs.periodic_runs(documents([]).limit(0)).count() == 0
