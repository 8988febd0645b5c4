"""Quality scores by nearest-neighbour voting in a latent-semantic space (operator 5).

A bounded sample of labelled texts is weighted (log counts, inverse document frequency of the sample) and
reduced by a truncated singular value decomposition. The labelled latent vectors are broadcast; every
document is projected in blocks, its exact cosine with all of them computed as one matrix product, and the
labels of its nearest neighbours vote with their similarity as weight.

Terms are hashed: trigrams of character kinds with runs collapsed, whole words, and how much of a text
repeats itself. No label, language, source or id is an input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltline.llm.blocks import flat_bytes, id_and_text, ragged_take, text_blocks
from haltline.llm.chunks import space_chunks

SHAPES, WORDS, STEPS = 1024, 1024, 16
#: Width of a feature vector: shape trigrams, hashed words, steps of two repetition measures.
WIDTH = SHAPES + WORDS + 2 * STEPS
#: Bound of the labelled sample, half of it for each label.
SAMPLE_ROWS = 4000
LATENT = 48
NEIGHBOURS = 25
#: Cosines below count little: a neighbour weighs its cosine to this power.
SHARPNESS = 4


def _kinds() -> np.ndarray:
    """A small number for each byte: letters by case, digits, spaces, line breaks, every other by itself."""
    kind = np.arange(256, dtype=np.int64)
    kind[128:] = ord("a")
    kind[ord("a") : ord("z") + 1] = ord("a")
    kind[ord("A") : ord("Z") + 1] = ord("A")
    kind[ord("0") : ord("9") + 1] = ord("0")
    return kind


_KIND = _kinds()


def features(texts: pa.Array) -> np.ndarray:
    """One row of float32 for each text, every group of terms scaled to length 1."""
    n = len(texts)
    shapes = np.zeros((n, SHAPES), np.float32)
    words = np.zeros((n, WORDS), np.float32)
    steps = np.zeros((n, 2 * STEPS), np.float32)

    data, offsets = flat_bytes(texts)
    if len(data):
        owner = np.repeat(np.arange(n), np.diff(offsets))
        kind = _KIND[data]
        new = np.ones(len(data), dtype=bool)
        new[1:] = (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1])
        kind, owner = kind[new], owner[new]
        if len(kind) > 2:
            gram = (kind[:-2] * 65536 + kind[1:-1] * 256 + kind[2:]) * 2654435761 >> 15
            same = owner[2:] == owner[:-2]
            cell = owner[2:][same] * SHAPES + gram[same] % SHAPES
            shapes += np.bincount(cell, minlength=n * SHAPES).reshape(n, SHAPES)

    vocabulary, codes, ends = _words(texts)
    sizes = np.diff(ends)
    if len(codes):
        owner = np.repeat(np.arange(n), sizes)
        hashed = np.fromiter((crc32(word.encode()) % WORDS for word in vocabulary), np.int64, len(vocabulary))
        cell = owner * WORDS + hashed[codes]
        words += np.bincount(cell, minlength=n * WORDS).reshape(n, WORDS)
        pairs = owner * len(vocabulary) + codes
        kinds = np.unique(pairs) // len(vocabulary)
        distinct = np.bincount(kinds, minlength=n) / np.maximum(sizes, 1)
        again = owner[1:][pairs[1:] == pairs[:-1]]
        repeated = np.bincount(again, minlength=n) / np.maximum(sizes, 1)
        rows = np.flatnonzero(sizes > 0)
        # Long texts repeat more words: compare with what n ** 0.8 distinct words would be.
        usual = np.minimum(1, distinct[rows] * np.maximum(sizes[rows], 1) ** 0.2 / 2)
        steps[rows, np.minimum((usual * STEPS).astype(int), STEPS - 1)] = 1
        share = np.sqrt(np.minimum(repeated[rows], 1))
        steps[rows, STEPS + np.minimum((share * STEPS).astype(int), STEPS - 1)] = 1
    return np.hstack([_scaled(np.log1p(shapes)), _scaled(np.log1p(words)), _scaled(steps)])


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct whole words between white space of any kind, each text's words, and where those start."""
    table = space_chunks(texts)
    lists = [chunk.split() for chunk in table.chunks]
    known = {word: number for number, word in enumerate(dict.fromkeys(word for one in lists for word in one))}
    flat = np.array([known[word] for one in lists for word in one], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum([len(one) for one in lists], dtype=np.int64)))
    codes, ends = ragged_take(flat, starts, table.codes)
    return list(known), codes, ends[table.offsets]


def _scaled(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return (rows / np.where(length > 0, length, 1)).astype(np.float32)


@dataclass
class NeighbourModel:
    """What is broadcast: term weights, the projection, and the labelled latent vectors."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def project(self, rows: np.ndarray) -> np.ndarray:
        return _scaled((rows * self.weights) @ self.axes)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        near = min(NEIGHBOURS, len(self.labels))
        result = np.empty(len(rows))
        for start in range(0, len(rows), 512):
            cosines = self.project(rows[start : start + 512]) @ self.vectors.T
            top = np.argpartition(cosines, -near, axis=1)[:, -near:]
            weight = np.maximum(np.take_along_axis(cosines, top, axis=1), 0).astype(float) ** SHARPNESS
            total = weight.sum(axis=1)
            vote = (weight * self.labels[top]).sum(axis=1)
            # A text without terms is near nothing and gets the sample's share.
            result[start : start + 512] = np.where(
                total > 0, vote / np.where(total > 0, total, 1), self.prior
            )
        return np.clip(result, 0, 1)


def fit_neighbours(rows: np.ndarray, labels: np.ndarray) -> NeighbourModel:
    """Latent-semantic vectors of labelled feature rows."""
    present = (rows > 0).sum(axis=0)
    weights = np.log((1 + len(rows)) / (1 + present)).astype(np.float32) + 1
    weighted = rows * weights
    width = min(LATENT, *weighted.shape) if len(rows) else 0
    if not width:
        empty = np.zeros((WIDTH, 1), np.float32)
        return NeighbourModel(weights, empty, np.zeros((0, 1), np.float32), labels)
    # Subspace iteration from a fixed start.
    basis = np.random.default_rng(5).standard_normal((weighted.shape[1], width)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    model = NeighbourModel(weights, basis.astype(np.float32), np.zeros((0, 1), np.float32), labels)
    model.vectors = model.project(rows)
    return model


def held_out(id_col: str = "doc_id"):
    """Whether a row's labels are kept from learning: crc32 of its id as text divides by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def quality_model(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> NeighbourModel:
    """Fit on at most `sample_rows` labelled texts that are not held out, equally many of each label."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("label").cast("int").alias("label"))
    )
    # Only labels of given texts count, else the sample of a filtered table would run thin.
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    known = known.join(given, "doc_id", "left_semi")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    half = sample_rows // 2
    sample = known.where("label = 0").orderBy(*order).limit(half)
    sample = sample.unionByName(known.where("label = 1").orderBy(*order).limit(half))
    # Rows that repeat an id count once, so the bound holds for them too.
    texts = (
        id_and_text(docs, id_col, text_col)
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=1 << 20):
            rows = features(block.column("text")).astype(np.float16)
            packed = pa.array((row.tobytes() for row in rows), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("label"), packed], ["doc_id", "label", "row"]
            )

    found = texts.mapInArrow(run, "doc_id long, label int, row binary").collect()
    found.sort(key=lambda row: (row.doc_id, bytes(row.row)))
    rows = np.frombuffer(b"".join(bytes(row.row) for row in found), np.float16).astype(np.float32)
    return fit_neighbours(
        rows.reshape(-1, WIDTH), np.array([row.label for row in found], dtype=np.float64)
    )


def quality_scores(
    docs: DataFrame,
    model: NeighbourModel,
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; nothing is shuffled.

    Null and empty texts, like any text without terms, score the sample's share of label 1. Repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=4 << 20):
            parts = [
                shared.value.scores(features(block.column("text").slice(start, 1024)))
                for start in range(0, block.num_rows, 1024)
            ]
            score = pa.array(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), score], ["doc_id", "score"])

    return (
        id_and_text(docs, id_col, text_col)
        .mapInArrow(run, "doc_id long, score double")
        .select(
            "doc_id",
            held_out().alias("held_out"),
            "score",
            (F.col("score") >= threshold).cast("int").alias("predicted"),
        )
    )


def keep_quality(
    docs: DataFrame, model: NeighbourModel, threshold: float = 0.3, text_col: str = "text"
) -> DataFrame:
    """The rows of `docs`, with all columns, whose whole text scores `threshold` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text_col, limit=2 << 20):
            texts = block.column(text_col).cast(pa.string()).fill_null("")
            good = [
                shared.value.scores(features(texts.slice(start, 1024))) >= threshold
                for start in range(0, block.num_rows, 1024)
            ]
            yield block.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)
