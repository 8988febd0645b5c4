"""Lower-case words of a block of texts as 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from haltline.llm.blocks import ragged_take
from haltline.llm.chunks import space_chunks

WORD = re.compile(r"[^\W_]+")
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, text after text, and where each text's words start."""
    table = space_chunks(texts)
    lists = [WORD.findall(chunk.lower()) for chunk in table.chunks]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(
        (_hash_word(word) for words in lists for word in words), np.uint64, int(sizes.sum())
    )
    starts = np.concatenate(([0], np.cumsum(sizes)))
    words, ends = ragged_take(flat, starts, table.codes)
    return words, ends[table.offsets]


def _hash_word(word: str) -> int:
    # Not Python's own hash: that differs from worker to worker.
    value = 0xCBF29CE484222325
    for byte in word.encode():
        value = ((value ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return value
