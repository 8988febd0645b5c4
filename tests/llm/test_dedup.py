from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from haltline.llm.gear_chunks import chunk_bounds, drop_repeated
from haltline.llm.induced_sort import suffix_order
from haltline.llm.order_minhash import (
    KEYS,
    ROWS,
    aligned_similarity,
    elements,
    near_duplicates,
    one_of_each,
    signatures,
)
from haltline.llm.sa_dedup import removal_digests, without_repeats
from haltline.llm.words import word_hashes
from tests.llm.conftest import prose


@pytest.mark.parametrize("seed", range(40))
def test_suffixes_are_in_order(seed):
    rng = random.Random(seed)
    symbols = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 90))]
    text = np.array([*symbols, 0], np.uint16)
    want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert suffix_order(text, 1000, held=rng.choice([3, 1000])).tolist() == want


def brute_removal(rows, length):
    raws = [(i, (text or "").encode()) for i, text in rows]
    seen = Counter(hash(raw[a : a + length]) for _, raw in raws for a in range(len(raw) - length + 1))
    result = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for a in range(len(raw) - length + 1):
            if seen[hash(raw[a : a + length])] > 1:
                gone[a : a + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (a and gone[a - 1]) for a, g in enumerate(gone))
        result.append((repr(i), len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(result)


@pytest.fixture(scope="module")
def repeats():
    shared, line = prose(50, 30), "né " * 30
    return [
        (1, prose(1, 40) + shared + prose(2, 30)),
        (2, shared + prose(3, 50)),
        (3, prose(4, 20) + shared[20:]),
        (4, None), (5, ""), (6, "short"), (7, line), (8, "ab" * 300), (9, prose(5, 60)), (9, prose(5, 60)),
        (10, prose(6, 9000)), (None, prose(6, 40)), (11, line[1:] + prose(7, 10)), (12, "x" * 59), (12, "x" * 60),
        *((100 + n, prose(200 + n, 8) + shared[:80] + prose(300 + n, 8)) for n in range(30)),
    ]


@pytest.mark.parametrize(("length", "gram", "shard_bytes"), [(60, 20, 1 << 20), (60, 60, 3000), (60, 20, 1)])
def test_repeated_bytes_go(documents, repeats, length, gram, shard_bytes):
    got = removal_digests(documents(repeats), length, gram=gram, shard_bytes=shard_bytes).collect()
    assert sorted((repr(r[0]), *r[1:]) for r in got) == brute_removal(repeats, length)


def test_texts_lose_repeated_bytes_only(documents, repeats):
    docs = documents(repeats)
    got = without_repeats(docs, 60, gram=20)
    assert got.columns == docs.columns
    kept = Counter(r.text for r in got.collect())
    assert sum(kept.values()) == len(repeats)
    assert kept[None] == 1 and kept["short"] == 1 and kept[repeats[9][1]] == 0
    assert documents([]).limit(0).transform(without_repeats).count() == 0
    assert removal_digests(documents([]).limit(0)).count() == 0


def brute_classes(rows):
    texts = list(dict.fromkeys(text or "" for _, text in rows))
    items, starts = elements(*word_hashes(pa.array(texts)))
    parts = [items[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    label = list(range(len(texts)))
    links = Counter()
    for x in range(len(texts)):
        for y in range(x):
            if aligned_similarity(parts[x], parts[y]) > 0:
                links.update((x, y))
                old, new = label[x], label[y]
                label = [new if one == old else one for one in label]
    of_text = dict(zip(texts, range(len(texts)), strict=True))
    own = [label[of_text[text or ""]] for _, text in rows]
    least = {}
    for (i, _), one in zip(rows, own, strict=True):
        if i is not None:
            least[one] = min(i, least.get(one, i))
    sizes = Counter(own)
    return sorted(
        (repr(i), least.get(one), sizes[one], links[of_text[text or ""]])
        for (i, text), one in zip(rows, own, strict=True)
    )


@pytest.fixture(scope="module")
def near():
    rng = random.Random(8)
    base = prose(9, 150).split()
    rows = [(n, prose(400 + n, rng.randint(1, 120))) for n in range(40)]
    for n in range(30):  # near copies of one text, a few words changed
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
        rows.append((100 + n, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "..."), (203, "!!"), (204, "one two"), (205, "One, two"), (206, "one two")]
    rows += [(300, prose(1, 20_000)), (301, prose(1, 20_000) + " end"), (None, prose(401, 50)), (302, prose(401, 50))]
    return rows


def test_classes_are_components_of_similar_texts(documents, near):
    got = [(repr(r[0]), *r[1:]) for r in near_duplicates(documents(near)).collect()]
    assert sorted(got) == brute_classes(near)
    assert near_duplicates(documents([]).limit(0)).count() == 0


def test_crowded_buckets_lose_no_link(documents):
    rng = random.Random(21)
    base, rows = prose(22, 300).split(), []
    for n in range(600):  # near copies of one text, of which two need not be similar
        words = list(base)
        for _ in range(n % 6):
            words[rng.randrange(len(words))] = f"new{rng.randrange(999)}"
        rows.append((n, " ".join(words)))
    texts = list(dict.fromkeys(text for _, text in rows))
    items, starts = elements(*word_hashes(pa.array(texts)))
    parts = [items[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    sketches = signatures(items, starts).reshape(len(texts), KEYS, ROWS)
    links, met, crowd = Counter(), Counter(), 0
    label = np.arange(len(texts))
    for x in range(len(texts)):
        same = (sketches == sketches[x]).all(axis=2)
        crowd = max(crowd, int(same.sum(axis=0).max()))
        for y in np.flatnonzero(same[:x].any(axis=1)).tolist():
            if aligned_similarity(parts[x], parts[y]) > 0:
                links.update((x, y))
                met[int(same[y].sum())] += 1
                label[label == label[x]] = label[y]
    assert crowd > 256 and met[1] > 0 and met[2] > 0
    of_text = {text: n for n, text in enumerate(texts)}
    own = [int(label[of_text[text]]) for _, text in rows]
    sizes, least = Counter(own), {}
    for (i, _), one in zip(rows, own, strict=True):
        least.setdefault(one, i)
    want = [(i, least[o], sizes[o], links[of_text[t]]) for (i, t), o in zip(rows, own, strict=True)]
    assert sorted(tuple(r) for r in near_duplicates(documents(rows)).collect()) == want


def test_one_of_each_class_stays(documents, near):
    docs = documents([*near, near[0]])
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    want = {row[1] for row in brute_classes(near)}
    got = [r.doc_id for r in kept.collect()]
    assert set(got) == want and len(got) == len(want)
    nothing = documents([(None, None), (None, "")])
    assert one_of_each(nothing).count() == 1


def test_similarity_follows_order():
    a = np.arange(100, dtype=np.uint32)
    assert aligned_similarity(a, a) == 1
    assert aligned_similarity(a, np.delete(a, range(20))) == pytest.approx(0.8)
    assert aligned_similarity(a, np.delete(a, range(21))) == 0
    assert aligned_similarity(a, np.roll(a, 50)) == 0
    assert aligned_similarity(a, a[:0]) == 0


def test_chunks_do_not_depend_on_what_stands_around():
    texts = [prose(n, 200).encode() for n in range(6)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    ends = chunk_bounds(data, offsets)
    assert set(offsets[1:]) <= set(ends) and np.diff(ends, prepend=0).max() <= 192
    alone = chunk_bounds(data[offsets[3] : offsets[4]], np.array([0, len(texts[3])]))
    assert (ends[(ends > offsets[3]) & (ends <= offsets[4])] - offsets[3] == alone).all()


def test_later_passages_go_and_the_first_stays(documents):
    passage = prose(70, 60)
    rows = [(n, prose(500 + n, 80) + " " + passage + " " + prose(600 + n, 40)) for n in range(1, 21)]
    rows += [(30, None), (31, ""), (32, "tiny"), (33, "tiny"), (34, prose(71, 20_000)), (None, prose(72, 90))]
    got = {r.doc_id: r for r in drop_repeated(documents(rows)).collect()}
    assert len(got) == len(rows)
    for n, text in rows:
        lost = got[n].n_removed
        assert got[n].n_bytes == len((text or "").encode())
        if n is None or n in (1, *range(30, 35)):
            assert lost == 0
        else:
            # A chunk beside the passage may have been seen before by chance.
            assert len(passage) / 2 < lost <= len(passage) + 24
            assert sum(span.size for span in got[n].spans) == lost
    assert drop_repeated(documents([]).limit(0)).count() == 0
