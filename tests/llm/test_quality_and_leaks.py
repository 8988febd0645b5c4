from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from haltline.llm.cgk_leaks import (
    MAX_SHARE,
    REPEATS,
    SAMPLED,
    edit_distance_within,
    index_items,
    largest_distance,
    leaked_items,
    without_leaks,
)
from haltline.llm.knn_quality import (
    features,
    fit_neighbours,
    keep_quality,
    quality_model,
    quality_scores,
)
from haltline.llm.words import word_hashes
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def judged():
    rng = random.Random(2)
    rows = []
    for n in range(400):
        text = prose(700 + n, rng.randint(5, 120))
        good = n % 3 > 0
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), (text.split()[0] + " ") * 40])
        rows.append((n, text, int(good)))
    return rows


def test_held_out_documents_are_told_apart(spark, documents, judged):
    docs = documents([row[:2] for row in judged] + [(900, None), (901, ""), (None, judged[0][1]), (1, judged[1][1])])
    labels = spark.createDataFrame(
        [(i, q, 0) for i, _, q in judged] + [(5, None, 0), (None, 1, 0), (7777, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    model = quality_model(docs, labels, sample_rows=200)
    assert 100 < len(model.labels) <= 200
    got = quality_scores(docs, model).collect()
    assert len(got) == len(judged) + 4
    truth = {i: q for i, _, q in judged}
    for row in got:
        assert 0 <= row.score <= 1 and row.predicted == (row.score >= 0.3)
        if row.doc_id is not None:
            assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 50 and np.mean(right) > 0.97
    kept = keep_quality(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_scores_are_the_exact_vote(judged):
    rows = features(pa.array([text for _, text, _ in judged]))
    labels = np.array([q for _, _, q in judged], float)
    model = fit_neighbours(rows[:300], labels[:300])
    got = model.scores(rows[300:])
    for row, score in zip(rows[300:], got, strict=True):
        cosine = model.vectors @ model.project(row[None])[0]
        top = np.argsort(-cosine)[:25]
        weight = np.maximum(cosine[top], 0) ** 4
        assert score == pytest.approx((weight * labels[top]).sum() / weight.sum(), abs=1e-5)


def test_no_labels_and_no_documents(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_model(documents([(1, "a b")]), labels)
    assert [r.score for r in quality_scores(documents([(1, "a b"), (2, None)]), model).collect()] == [0.5, 0.5]
    assert quality_scores(documents([]).limit(0), model).count() == 0


ITEMS = [(n, prose(900 + n, 8 + 5 * n)) for n in range(10)]


def edited(rng, text, k):
    words = text.split()
    for _ in range(k):
        place, kind = rng.randrange(len(words)), rng.choice("sid")
        if kind == "d":
            del words[place]
        else:
            words[place : place + (kind == "s")] = [f"q{rng.randrange(99)}"]
    return " ".join(words)


def test_recall_of_candidates_at_the_largest_distance():
    rng = random.Random(3)
    index = index_items([i for i, _ in ITEMS], [text for _, text in ITEMS], MAX_SHARE, REPEATS, SAMPLED)
    wanted, texts = [], []
    for n in range(400):
        i, text = rng.choice(ITEMS)
        k = largest_distance(len(text.split()), MAX_SHARE)
        texts.append(f"{prose(2000 + n, rng.randint(0, 60))} {edited(rng, text, k)} {prose(3000 + n, 40)}")
        wanted.append((n, i))
    found = {(text, item) for text, item, _ in index.candidates(*word_hashes(pa.array(texts)))}
    assert np.mean([pair in found for pair in wanted]) >= 0.99


@pytest.mark.parametrize("kind", ["deleted", "cut off", "begun late", "edited"])
@pytest.mark.parametrize(("before", "after"), [(0, 0), (30, 0), (30, 40)])
def test_recall_of_candidates_at_the_ends_of_texts(kind, before, after):
    rng = random.Random(4)
    index = index_items([i for i, _ in ITEMS], [text for _, text in ITEMS], MAX_SHARE, REPEATS, SAMPLED)
    wanted, texts = [], []
    for n in range(400):
        i, text = rng.choice(ITEMS)
        words = text.split()
        k = largest_distance(len(words), MAX_SHARE)
        if kind == "deleted":
            gone = set(rng.sample(range(len(words)), k))
            words = [word for place, word in enumerate(words) if place not in gone]
        elif kind == "edited":
            words = edited(rng, text, k).split()
        else:
            words = words[: len(words) - k] if kind == "cut off" else words[k:]
        texts.append(f"{prose(7000 + n, before)} {' '.join(words)} {prose(3000 + n, after)}")
        wanted.append((n, i))
    found = {(text, item) for text, item, _ in index.candidates(*word_hashes(pa.array(texts)))}
    assert np.mean([pair in found for pair in wanted]) >= 0.99


def brute_leaks(rows, items):
    found = []
    for i, text in rows:
        words, _ = word_hashes(pa.array([text or ""]))
        for item, item_text in items:
            own, _ = word_hashes(pa.array([item_text or ""]))
            if len(own):
                distance, _ = edit_distance_within(own, words)
                if distance <= largest_distance(len(own), MAX_SHARE):
                    found.append((repr(i), item, distance, len(own)))
    return sorted(found, key=repr)


@pytest.fixture(scope="module")
def leaking():
    rng = random.Random(11)
    rows = [(n, prose(4000 + n, rng.randint(1, 150))) for n in range(60)]
    for n in range(60):
        i, text = rng.choice(ITEMS)
        text = edited(rng, text, rng.choice([0, 0, 1, 2])).upper().replace(" ", ",\n", 2)
        rows.append((100 + n, f"{prose(5000 + n, 30)} {text} {prose(6000 + n, 20)}"))
    rows += [(200, None), (201, ""), (202, ITEMS[3][1]), (202, ITEMS[3][1]), (None, ITEMS[4][1])]
    rows += [(203, prose(1, 25_000) + " " + ITEMS[5][1]), (204, "the " * 3000)]
    return rows


def test_leaks_equal_brute_force(spark, documents, leaking):
    given = [*ITEMS, (50, None), (51, ""), (52, "two words"), (53, "..."), (None, prose(77, 20))]
    items = spark.createDataFrame([(*row, "clash") for row in given], "item_id long, text string, doc_id string")
    docs = documents(leaking)
    got = leaked_items(docs, items).collect()
    want = brute_leaks(leaking, given)
    assert sorted(((repr(r.doc_id), r.item_id, r.distance, r.n_words) for r in got), key=repr) == want
    sliced = leaked_items(docs, items, slice_words=150).collect()
    assert sorted(map(repr, sliced)) == sorted(map(repr, got))
    clean = without_leaks(docs, items, slice_words=150)
    bad = {row[0] for row in want}
    assert clean.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in clean.collect()) == sorted(repr(i) for i, _ in leaking if repr(i) not in bad)


def test_no_items_and_no_documents(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert leaked_items(documents([(1, "a")]), none).count() == 0
    assert without_leaks(documents([(1, "a")]), none).count() == 1
    assert leaked_items(documents([]).limit(0), some).count() == 0


def test_words_are_whole_and_end_at_any_white_space():
    long = "x" * 50
    rows = features(pa.array([f"{long}a tail", f"{long}b tail", f"{long}a\ntail", f" {long}a \t tail ", long]))
    words = rows[:, 1024:2048]
    assert not np.allclose(words[0], words[1])
    assert np.allclose(words[0], words[2]) and np.allclose(words[0], words[3])
    assert (words[4] > 0).sum() == 1
