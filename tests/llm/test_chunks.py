"""Gear chunks against a version that looks at every byte."""

from __future__ import annotations

import random

import pytest

from haltline.llm import gear_chunks as gear
from haltline.llm.gear_chunks import drop_repeated
from tests.llm.conftest import prose


def naive_chunks(raw):
    """(start, end) of every chunk."""
    ends, before = [], None
    for end in range(gear.REACH, len(raw) + 1):
        value = sum(int(gear._GEAR[raw[end - 1 - age]]) << age for age in range(gear.REACH)) % 2**32
        if value >> (32 - gear.BITS) == 0:
            if before is None or end - before >= gear.MIN:
                ends.append(end)
            before = end
    if raw and (not ends or ends[-1] != len(raw)):
        ends.append(len(raw))
    start = 0
    for end in ends:
        while end - start > gear.MAX:
            yield start, start + gear.MAX
            start += gear.MAX
        yield start, end
        start = end


def naive_removal(rows):
    """(doc_id, n_bytes, n_removed, n_spans, spans): every later occurrence of a chunk, in long enough runs."""
    seen = set()
    for i, text in sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0)):
        raw = (text or "").encode()
        spans = []
        for start, end in naive_chunks(raw):
            if raw[start:end] not in seen:
                seen.add(raw[start:end])
            elif spans and spans[-1][1] == start:
                spans[-1][1] = end
            else:
                spans.append([start, end])
        spans = [(start, end - start) for start, end in spans if end - start >= gear.MIN_RUN]
        yield repr(i), len(raw), sum(size for _, size in spans), len(spans), spans


@pytest.mark.parametrize("hot", [10_000, 5, 1])
def test_removal_equals_a_look_at_every_byte(spark, documents, monkeypatch, hot):
    monkeypatch.setattr(gear, "HOT_DIGESTS", hot)
    rng = random.Random(hot)
    passage, line = prose(1, 80), "All rights reserved by the owners of this text and of its parts. " * 4
    rows = []
    for n in range(60):
        parts = [prose(100 + n, rng.randint(0, 60))]
        if n % 3 == 0:
            parts.append(line)
        if n % 5 == 0:
            parts.append(passage[rng.randrange(90) :])
        rng.shuffle(parts)
        rows.append((n, " ".join(parts)))
    rows += [(100 + n, rows[n][1]) for n in range(8)] + [(None, passage), (200, None), (201, ""), (202, "é" * 900), (203, "x")]
    got = drop_repeated(documents(rows)).collect()
    want = sorted(naive_removal(rows))
    assert sorted((repr(r[0]), *r[1:4], [tuple(span) for span in r.spans]) for r in got) == want
    assert sum(row[2] for row in want) > 5_000
