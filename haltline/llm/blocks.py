"""Bounded blocks of whole texts inside tasks, and the row columns that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, as (doc_id long, text string); a null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), whole_text(F.col(text_col)).alias("text")
    )


def whole_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def text_blocks(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one block hold about `limit` bytes, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.binary_length(batch.column(column).cast(pa.binary()))
        ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, used = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, used + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, used = stop, int(ends[stop - 1])


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array in one uint8 array, and where each text starts (one more entry)."""
    array = texts.cast(pa.large_binary())
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    if buffers[2] is None or len(array) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(len(array) + 1, dtype=np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def ragged_take(
    values: np.ndarray, offsets: np.ndarray, rows: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The lists `rows` of a ragged array, one after the other, and their new offsets."""
    sizes = (offsets[1:] - offsets[:-1])[rows]
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    places = np.arange(ends[-1], dtype=np.int64) + np.repeat(offsets[:-1][rows] - ends[:-1], sizes)
    return values[places], ends
