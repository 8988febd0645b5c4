"""Substring deduplication by content-defined chunking with a gear rolling hash (operator 7).

A chunk ends where the gear hash of the last 32 bytes has its top bits zero, so an insertion moves chunk
borders only around itself. Chunks are compared by a 128-bit digest of their bytes. The first occurrence of
a chunk, by (doc_id, position), stays; runs of later occurrences of `min_run` bytes or more are repeated
passages and go. A run may be shorter than the passage by its first and last, incomplete chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltline.llm.blocks import flat_bytes, text_blocks, whole_text
from haltline.session import keep_table

#: Bytes that the rolling hash sees.
REACH = 32
#: A border every 2 ** BITS bytes on average, at least MIN and at most MAX bytes after the one before.
BITS, MIN, MAX = 5, 12, 192
#: Bytes of repeated chunks in a row that make a repeated passage.
MIN_RUN = 128
#: Digests with more than this part of all repeated chunks are broadcast with their first place.
HOT_DIGESTS = 10_000

_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash behind each byte: sum of gear[byte] << age over the last 32 bytes."""
    rolled = _GEAR[data]
    width = 1
    while width < REACH:
        rolled[width:] += rolled[:-width].copy() << np.uint32(width)
        width *= 2
    return rolled


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all chunks in the flat bytes; every text ends a chunk and no chunk crosses texts."""
    if not len(data):
        return np.empty(0, dtype=np.int64)
    ends = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - BITS) == 0) + 1
    owner = np.searchsorted(offsets, ends - 1, side="right") - 1
    # A hash that still saw the text before says nothing about this one.
    ends = ends[ends - offsets[owner] >= REACH]
    owner = np.searchsorted(offsets, ends - 1, side="right") - 1
    before = np.concatenate(([-MIN], ends[:-1]))
    before = np.maximum(before, offsets[owner] - MIN)
    ends = ends[ends - before >= MIN]
    ends = np.union1d(ends, offsets[1:][np.diff(offsets) > 0])
    # Long stretches without a border are cut at fixed steps from their start.
    starts = np.concatenate(([0], ends[:-1]))
    extra = (ends - starts - 1) // MAX
    rows = np.repeat(np.arange(len(ends)), extra)
    step = np.arange(len(rows)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    return np.union1d(ends, starts[rows] + step * MAX)


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, position, size, high, low): every chunk of every whole text with its digest."""
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), whole_text(F.col(text_col)).alias("text")
    ).withColumn("row_key", F.xxhash64("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            data, offsets = flat_bytes(block.column("text"))
            ends = chunk_bounds(data, offsets)
            starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            raw = data.tobytes()
            digests = b"".join(
                hashlib.blake2b(raw[a:b], digest_size=16).digest()
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True)
            )
            halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
            owner = np.searchsorted(offsets, starts, side="right") - 1
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id").take(rows),
                    block.column("row_key").take(rows),
                    pa.array(starts - offsets[owner], pa.int64()).cast(pa.int32()),
                    pa.array(ends - starts, pa.int64()).cast(pa.int32()),
                    pa.array(halves[:, 0]),
                    pa.array(halves[:, 1]),
                ],
                ["doc_id", "row_key", "position", "size", "high", "low"],
            )

    return texts.mapInArrow(
        run, "doc_id long, row_key long, position int, size int, high long, low long"
    )


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN
) -> DataFrame:
    """(doc_id, row_key, spans array<struct<start, size>>): the byte ranges of every text that go.

    Texts without such a range have no row. Null ids come first in the order of occurrences. Rows that repeat
    both id and text count as one text.
    """
    chunks = chunk_table(docs, id_col, text_col)
    first = keep_table(
        chunks.groupBy("high", "low")
        .agg(
            F.min(F.struct("doc_id", "row_key", "position")).alias("first"),
            F.max(F.struct("doc_id", "row_key", "position")).alias("last"),
            F.count(F.lit(1)).alias("n"),
        )
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .select("high", "low", "first", "n")
    )
    # A digest with more than its share of all repeated chunks meets them where they are. There are at most
    # `HOT_DIGESTS` of these, so they are broadcast; every other digest has a small part of the chunks.
    repeated = first.agg(F.sum("n")).first()[0] or 0
    hot = first.where(F.col("n") * HOT_DIGESTS > repeated).select("high", "low", F.col("first").alias("hot_first"))
    place = F.struct("doc_id", "row_key", "position")
    spread = F.xxhash64("row_key", "position")
    is_hot = F.col("hot_first").isNotNull()
    later = (
        chunks.join(F.broadcast(hot), ["high", "low"], "left")
        .withColumns(
            {
                "dealt": is_hot,
                "high": F.when(is_hot, spread).otherwise(F.col("high")),
                "low": F.when(is_hot, spread).otherwise(F.col("low")),
            }
        )
        .join(first.select(F.lit(False).alias("dealt"), "high", "low", "first"), ["dealt", "high", "low"], "left")
        .withColumn("first", F.coalesce("hot_first", "first"))
        .where(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(place))
        .groupBy("doc_id", "row_key")
        .agg(F.sort_array(F.collect_set(F.struct("position", "size"))).alias("found"))
    )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for found in batch.column("found").to_pylist():
                start = np.array([one["position"] for one in found], dtype=np.int64)
                end = start + np.array([one["size"] for one in found], dtype=np.int64)
                opens = np.concatenate(([True], start[1:] != end[:-1]))
                first = start[opens]
                size = end[np.append(opens[1:], True)] - first
                spans.append(
                    [
                        {"start": int(a), "size": int(n)}
                        for a, n in zip(first, size, strict=True)
                        if n >= min_run
                    ]
                )
            columns = [batch.column("doc_id"), batch.column("row_key"), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "spans"])

    kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())]))
    return later.mapInArrow(
        runs, "doc_id long, row_key long, spans array<struct<start:int,size:int>>"
    ).where(F.size("spans") > 0)


def drop_repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans) of every text; `spans` are byte ranges to remove.

    Null and empty texts lose nothing.
    """
    spans = repeated_spans(docs, id_col, text_col, min_run).select(
        F.col("doc_id").alias("span_id"), F.col("row_key").alias("span_key"), "spans"
    )
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), whole_text(F.col(text_col)).alias("text")
    ).select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("row_key"),
        F.octet_length("text").cast("long").alias("n_bytes"),
    )
    same = (F.col("row_key") == F.col("span_key")) & F.col("doc_id").eqNullSafe(F.col("span_id"))
    joined = rows.join(spans, same, "left")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["size"])
    return joined.select(
        "doc_id",
        "n_bytes",
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.greatest(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,size:int>>")).alias("spans"),
    )
