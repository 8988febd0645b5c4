"""The pipeline against the same decisions taken one document at a time."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__
import corpus_pipeline
from haltline.llm.knn_quality import features, quality_model
from tests.llm.conftest import prose
from tests.llm.test_dedup import brute_classes
from tests.llm.test_quality_and_leaks import brute_leaks

LENGTH = corpus_pipeline.PASSAGE_BYTES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    passage, items = prose(8000, 120), [(n, prose(8100 + n, 30)) for n in range(5)]
    rows = [(n, prose(7000 + n, rng.randint(20, 140))) for n in range(120)]
    rows += [(200 + n, prose(7000 + n, 10).upper().replace(" ", "!! ")) for n in range(30)]
    rows += [(300 + n, rows[n][1]) for n in range(0, 30, 3)]  # exact copies
    rows += [(400 + n, rows[n + 40][1] + " more") for n in range(0, 30, 3)]  # near copies
    rows += [(500 + n, f"{prose(7500 + n, 60)} {passage} {prose(7600 + n, 60)}") for n in range(6)]
    rows += [(600 + n, f"{prose(7700 + n, 40)} {items[n][1]} {prose(7800 + n, 9)}") for n in range(5)]
    rows += [(700, None), (701, ""), (702, "one two")]
    folder = tmp_path_factory.mktemp("tables")
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = [(i, text, "xx", "src0", len(text or "")) for i, text in rows]
    spark.createDataFrame(docs, kind).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(not 200 <= i < 230), 0) for i, _ in rows if i < 230]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def brute(spark, folder, rows, items):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality_model(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = model.scores(features(pa.array([text or "" for _, text in rows])))
    rows = [row for row, score in zip(rows, scores, strict=True) if score >= 0.3]
    keep = {class_id for _, class_id, _, _ in brute_classes(rows)}
    rows = [row for row in rows if row[0] in keep]
    raws = [(i, (text or "").encode()) for i, text in rows]
    seen = Counter(raw[a : a + LENGTH] for _, raw in raws for a in range(len(raw) - LENGTH + 1))
    cut = []
    for i, raw in raws:
        gone = set()
        for a in range(len(raw) - LENGTH + 1):
            if seen[raw[a : a + LENGTH]] > 1:
                gone.update(range(a, a + LENGTH))
        cut.append((i, bytes(b for a, b in enumerate(raw) if a not in gone).decode(errors="ignore")))
    bad = {i for i, *_ in brute_leaks(cut, items)}
    cut = [(i, text) for i, text in cut if repr(i) not in bad]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return sorted((i, tuple(library.encode(text)), library.decode(library.encode(text))) for i, text in cut)


def test_pipeline_equals_brute_force(spark, tables):
    folder, rows, items = tables
    want = brute(spark, folder, rows, items)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    kept = {r.doc_id for r in got}
    assert not kept & set(range(200, 230)) and not kept & set(range(300, 330))
    assert not kept & set(range(600, 605)) and set(range(500, 506)) <= kept
    digest = hashlib.sha256(prose(8000, 120)[60:600].encode()).hexdigest()
    assert all(hashlib.sha256(r.decoded[60:600].encode()).hexdigest() != digest for r in got)


def test_stages_return_the_columns_of_documents(spark, tables):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).dtypes == docs.dtypes
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    for number in range(1, 14):
        assert sum(name.startswith(f"op{number}_") for name in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
    sql = __spark_entry__.oracle_sql()
    assert sql.keys() <= names.keys() and all(isinstance(text, str) for text in sql.values())
