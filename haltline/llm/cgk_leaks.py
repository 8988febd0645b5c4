"""Benchmark decontamination by CGK embedding and bit-sampling LSH (operator 10).

Texts and items become sequences of lower-case words. An item leaks into a text if some window of it is
within an edit distance of `max_share` of the item's words. The way there:

1. Windows. By pigeonhole a leak leaves runs of the item's words intact, so item-sized windows are placed
   only where enough short word runs of one item stand on nearly one diagonal. No leak is lost by this.
2. CGK embedding. A window is read by a random walk: at each step the current word is emitted and its random
   bit for this step says whether to advance. Two sequences at edit distance k read by the same walk come
   together again after about k ** 2 steps, so their outputs have a small Hamming distance.
3. Bit sampling. Each of `repeats` walks samples a few positions of the output as a key; a window is a
   candidate if any of its keys is that of the item it was placed for, or if the text's start or end cuts it
   short. `repeats` is set so that leaks at the largest distance reach the recall.
4. Candidates are verified by their exact edit distance to the best part of the text around the window.

Items are broadcast in slices of bounded size; more items mean more passes over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltline.llm.blocks import id_and_text, text_blocks
from haltline.llm.words import STEP, WORD, mixed, word_hashes

#: An item leaks at an edit distance of up to this share of its words.
MAX_SHARE = 0.2
#: Walks and sampled output positions of each: for the recall that tests/llm measures, 0.99 or more.
REPEATS, SAMPLED = 48, 2
#: Samples are taken from the first steps, as a share of the item's words.
STEPS_SHARE = 1.0
#: Words of the items that are broadcast at once.
SLICE_WORDS = 1_000_000

LEAK_SCHEMA = "doc_id long, item_id long, distance int, first_word int, n_words int"

def largest_distance(size: int, max_share: float) -> int:
    return int(max_share * size)


def seed_width(size: int, distance: int) -> int:
    """Words of a run that stays intact in any leak, at most 3."""
    return max(1, min(3, -(-(size - distance) // (distance + 1))))


def seed_keys(words: np.ndarray, width: int) -> np.ndarray:
    """A key for each run of `width` words, by its first word's place."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    key = np.full(n, width, dtype=np.uint64)
    for step in range(width):
        key = mixed(key * STEP + words[step : n + step])
    return key


def cgk_samples(
    words: np.ndarray,
    starts: np.ndarray,
    sizes: np.ndarray,
    full: np.ndarray,
    repeat: int,
    sampled: int,
) -> np.ndarray:
    """One key for each sequence `words[start : start + size]`, from walk number `repeat`.

    A step's random bit depends on the walk, the step and the word; so do not the sampled steps, which are
    the same share of `full` for all sequences: the size of the item, also where the text ends before the
    window does. A walk past the end reads an end mark.
    """
    random = np.random.default_rng(1000 + repeat)
    shares = np.sort(random.random(sampled)) * STEPS_SHARE
    steps = np.minimum((shares[:, None] * full).astype(np.int64), full - 1)
    place = np.zeros(len(starts), dtype=np.int64)
    key = np.full(len(starts), repeat, dtype=np.uint64)
    seed = np.uint64(random.integers(0, 2**63))
    for step in range(int(steps.max(initial=-1)) + 1):
        inside = place < sizes
        word = np.where(inside, words[starts + np.minimum(place, sizes - 1)], np.uint64(1))
        for wanted in steps:
            hit = wanted == step
            key[hit] = mixed(key[hit] * STEP + word[hit])
        bit = mixed(word ^ seed ^ (np.uint64((step + 1) * int(STEP) % 2**64))) >> np.uint64(63)
        place += (bit & inside).astype(np.int64)
    return key


def edit_distance_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of `item` to any part of `text`, and where the first such part ends."""
    previous = np.zeros(len(text) + 1, dtype=np.int64)
    column = np.arange(len(text) + 1)
    for row, word in enumerate(item, 1):
        current = np.minimum(previous[1:] + 1, previous[:-1] + (text != word))
        current = np.concatenate(([row], current))
        # Insertions along the row: the least of current[j] + (i - j) for j up to i.
        previous = np.minimum.accumulate(current - column) + column
    end = int(previous.argmin())
    return int(previous[end]), end


@dataclass
class ItemIndex:
    """What is broadcast: the items' words, their seeds, and their keys for each walk."""

    ids: np.ndarray
    words: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    distances: np.ndarray
    widths: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    keys: list[np.ndarray]
    sampled: int

    def item_words(self, item: int) -> np.ndarray:
        return self.words[self.starts[item] : self.starts[item] + self.sizes[item]]

    def candidates(self, words: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, window start): windows that share a key with the item they are placed for, or are cut short."""
        text, item, start = self._windows(words, offsets)
        if not len(text):
            return set()
        first, last = offsets[text], offsets[text + 1]
        begin = np.clip(first + start, first, last - 1)
        size = np.minimum(self.sizes[item], last - begin)
        # A window that the text's start or end cuts short lacks words of the item on one side, so that the walks
        # need not meet again before their end. Such windows are few: all are verified.
        meets = (size < self.sizes[item]) | (start < 0)
        for repeat, keys in enumerate(self.keys):
            left = np.flatnonzero(~meets)
            own = cgk_samples(
                words, begin[left], size[left], self.sizes[item[left]], repeat, self.sampled
            )
            meets[left] = own == keys[item[left]]
        place = begin - first
        return set(zip(text[meets].tolist(), item[meets].tolist(), place[meets].tolist(), strict=True))

    def _windows(
        self, words: np.ndarray, offsets: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item-sized windows where enough seeds of one item stand within its distance of one diagonal."""
        parts = []
        for width, (keys, items, places) in self.seeds.items():
            own = seed_keys(words, width)
            filled = np.zeros(1 << 22, dtype=bool)
            filled[keys >> np.uint64(42)] = True
            at = np.flatnonzero(filled[own >> np.uint64(42)])
            left, right = np.searchsorted(keys, own[at]), np.searchsorted(keys, own[at], side="right")
            at, left, count = at[right > left], left[right > left], (right - left)[right > left]
            rows = np.repeat(left, count) + np.arange(count.sum()) - np.repeat(
                np.cumsum(count) - count, count
            )
            at = np.repeat(at, count)
            text = np.searchsorted(offsets, at, side="right") - 1
            inside = at + width <= offsets[text + 1]
            rows, at, text = rows[inside], at[inside], text[inside]
            parts.append((text, items[rows], at - offsets[text] - places[rows]))
        text, item, diagonal = (np.concatenate(columns) for columns in zip(*parts, strict=True))
        order = np.lexsort((diagonal, item, text))
        text, item, diagonal = text[order], item[order], diagonal[order]
        size, distance = self.sizes[item], self.distances[item]
        needed = np.maximum(1, size - distance - (distance + 1) * (self.widths[item] - 1))
        ahead = np.arange(len(text)) + needed - 1
        fits = ahead < len(text)
        ahead = np.minimum(ahead, max(len(text) - 1, 0))
        if len(text):
            fits &= (text[ahead] == text) & (item[ahead] == item)
            fits &= diagonal[ahead] - diagonal <= 2 * distance
        # Missing words move what follows to lower diagonals, so the item may begin on any diagonal of such a run.
        run = np.zeros(len(text) + 1, dtype=np.int64)
        np.add.at(run, np.flatnonzero(fits), 1)
        np.add.at(run, ahead[fits] + 1, -1)
        own = np.cumsum(run[:-1]) > 0
        text, item, start = text[own], item[own], diagonal[own]
        if len(text):
            _, once = np.unique(np.stack([text, item, start]), axis=1, return_index=True)
            text, item, start = text[once], item[once], start[once]
        return text, item, start

    def leaks(self, words: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, end in words) of each item that leaks into a text, at its best place."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for text, item, place in sorted(self.candidates(words, offsets)):
            known = best.get((text, item))
            if known and known[0] == 0:
                continue
            wanted, reach = self.item_words(item), int(self.distances[item])
            size = len(wanted)
            own = words[offsets[text] : offsets[text + 1]]
            low = max(0, place - 2 * reach)
            near = own[low : place + size + 2 * reach]
            distance, end = edit_distance_within(wanted, near)
            if distance <= reach and (known is None or (distance, low + end) < known):
                best[text, item] = (distance, low + end)
        return [(text, item, *found) for (text, item), found in sorted(best.items())]


def index_items(
    ids: list[int], texts: list[str], max_share: float, repeats: int, sampled: int
) -> ItemIndex:
    words, offsets = word_hashes(pa.array(texts, pa.string()))
    sizes = np.diff(offsets)
    distances = np.array([largest_distance(int(n), max_share) for n in sizes], dtype=np.int64)
    widths = np.array(
        [seed_width(int(n), int(d)) for n, d in zip(sizes, distances, strict=True)], dtype=np.int64
    )
    seeds = {}
    for width in np.unique(widths).tolist():
        items = np.flatnonzero(widths == width)
        keys = [seed_keys(words[offsets[i] : offsets[i + 1]], width) for i in items]
        owner = np.repeat(items, [len(k) for k in keys])
        places = np.concatenate([np.arange(len(k)) for k in keys])
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        seeds[width] = (flat[order], owner[order], places[order])
    keys = []
    for repeat in range(repeats):
        keys.append(cgk_samples(words, offsets[:-1], sizes, sizes, repeat, sampled))
    return ItemIndex(
        np.array(ids, dtype=np.int64), words, offsets[:-1], sizes, distances, widths, seeds, keys, sampled
    )


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    max_share: float = MAX_SHARE,
    repeats: int = REPEATS,
    sampled: int = SAMPLED,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    slice_words: int = SLICE_WORDS,
) -> DataFrame:
    """(doc_id, item_id, distance, first_word, n_words): each item that leaks into a text, at its best place.

    `distance` is the least edit distance in words, `n_words` the item's words, `first_word` about where the
    passage begins. Null texts are empty; items without words (null, empty) leak nowhere; repeated texts and
    items give repeated rows. Nothing is shuffled.
    """
    texts = id_and_text(docs, id_col, text_col)
    settings = (max_share, repeats, sampled)
    parts = [
        texts.mapInArrow(_leak_rows(shared), LEAK_SCHEMA)
        for shared in _slices(items, settings, item_id_col, item_text_col, slice_words)
    ]
    if not parts:
        return docs.sparkSession.createDataFrame([], LEAK_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def without_leaks(
    docs: DataFrame,
    items: DataFrame,
    max_share: float = MAX_SHARE,
    repeats: int = REPEATS,
    sampled: int = SAMPLED,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    slice_words: int = SLICE_WORDS,
) -> DataFrame:
    """The rows of `docs`, with all columns, into whose text no item leaks."""
    for shared in _slices(items, (max_share, repeats, sampled), item_id_col, item_text_col, slice_words):
        docs = docs.mapInArrow(_clean_rows(shared, text_col), docs.schema)
    return docs


def _clean_rows(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, _ = shared.value
        for block in text_blocks(batches, text_col):
            texts = block.column(text_col).cast(pa.string()).fill_null("")
            leaking = {found[0] for found in index.leaks(*word_hashes(texts))}
            clean = [row not in leaking for row in range(block.num_rows)]
            yield block.filter(pa.array(clean, pa.bool_()))

    return run


def _slices(
    items: DataFrame,
    settings: tuple[float, int, int],
    item_id_col: str,
    item_text_col: str,
    slice_words: int,
) -> list:
    """Broadcast item indexes of about `slice_words` words each; none if no item has words."""
    given = items.select(
        F.col(item_id_col).cast("long").alias("item_id"),
        F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"),
    )
    # Two words need a character each and one between them, so this bounds the words.
    bound = F.ceil((F.length("text") + 1) / 2)
    total = given.agg(F.coalesce(F.sum(bound), F.lit(0))).first()[0]
    slices = max(1, -(-total // slice_words))
    broadcasts = []
    for number in range(slices):
        own = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == number)
        rows = [row for row in own.orderBy("item_id", "text").collect() if WORD.search(row.text)]
        if rows:
            # A null item id is kept apart from all numbers.
            index = index_items([row.item_id or 0 for row in rows], [row.text for row in rows], *settings)
            shared = items.sparkSession.sparkContext.broadcast((index, [row.item_id for row in rows]))
            broadcasts.append(shared)
    return broadcasts


def _leak_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, item_ids = shared.value
        for block in text_blocks(batches):
            found = index.leaks(*word_hashes(block.column("text")))
            sizes = [int(index.sizes[item]) for _, item, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())),
                    pa.array([item_ids[f[1]] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.int32()),
                    pa.array([max(0, f[3] - n) for f, n in zip(found, sizes, strict=True)], pa.int32()),
                    pa.array(sizes, pa.int32()),
                ],
                ["doc_id", "item_id", "distance", "first_word", "n_words"],
            )

    return run
