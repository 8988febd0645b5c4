"""Stretches of words that repeat with a period, by suffix trees and Lyndon roots (operator 13).

A run is a longest stretch of consecutive words with smallest period q and at least `LEAST_POWER` * q and
`LEAST_WORDS` words. Every run holds, for one of the two orders of the alphabet, a longest Lyndon word of
length q that starts inside it. So for each word and each order the longest Lyndon word from there is taken
(up to the next smaller suffix) and extended in both directions by longest common extensions: those of the
text from its suffix tree, those to the left from the tree of the reversal. Both trees are built by
Ukkonen's algorithm; an Euler tour over their leaves turns lowest common ancestors into range minima.

Before that, words whose stretch cannot hold a run are set aside exactly: in a run of period q every word
but the last q comes again within q words, so at least `LEAST_POWER` - 1 times q consecutive words have
a next occurrence within q. What is left of the texts of a block, mostly little, goes into one pair of trees.

A text without words, empty or null, has no runs and an empty rest. Rows are worked on one by one where they
lie: ids may repeat or be null, an empty table gives no rows, other columns are not read. A task holds a few
hundred bytes for each word of the longest repeating stretch it meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from haltline.llm.blocks import id_and_text, text_blocks

LEAST_WORDS = 6
LEAST_POWER = 4
#: Words that share one pair of trees; a longer stretch has a pair of its own.
TREE_WORDS = 100_000

SCHEMA = (
    "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class SuffixTree:
    """Ukkonen's tree of a sequence of small numbers whose last one occurs nowhere else."""

    def __init__(self, text: list[int], size: int) -> None:
        self.text, self.size = text, size
        #: Where the edge into a node starts and stops; a leaf's edge runs to the end.
        start, stop, link = [0], [0], [0]
        child: dict[int, int] = {}
        end = len(text)
        node = edge = length = waiting = 0
        for place, symbol in enumerate(text):
            waiting += 1
            fresh = 0
            while waiting:
                if not length:
                    edge = place
                key = node * size + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(place)
                    stop.append(end)
                    link.append(0)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    head = start[below]
                    span = stop[below] - head
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if text[head + length] == symbol:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    middle = len(start)
                    child[key] = middle
                    start += (head, place)
                    stop += (head + length, end)
                    link += (0, 0)
                    start[below] = head + length
                    child[middle * size + text[head + length]] = below
                    child[middle * size + symbol] = middle + 1
                    if fresh:
                        link[fresh] = middle
                    fresh = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = place - waiting + 1
        self.start, self.stop = start, stop
        keys = np.fromiter(child.keys(), np.int64, len(child))
        self._below = np.fromiter(child.values(), np.int64, len(child))
        self._above, self._symbol = np.divmod(keys, size)

    def tour(self, place_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order that `place_of` gives the symbols, and the depth at which neighbours part.

        The depths are the visits of an Euler tour to inner nodes between two children, so the least one
        between two leaves belongs to their lowest common ancestor.
        """
        by_node = np.lexsort((-place_of[self._symbol], self._above))
        counts = np.bincount(self._above, minlength=len(self.start))
        ends = np.concatenate(([0], np.cumsum(counts))).tolist()
        below = self._below[by_node].tolist()
        start, stop, n = self.start, self.stop, len(self.text)
        order: list[int] = []
        parted: list[int] = []
        # A child is pushed with the depth of its parent; the first child goes straight on.
        stack = [(0, 0, 0)]
        while stack:
            node, above, split = stack.pop()
            if node:
                depth = above + stop[node] - start[node]
                parted.append(split)
            else:
                depth = 0
            first, last = ends[node], ends[node + 1]
            if first == last:
                order.append(n - depth)
                continue
            if node:
                parted.pop()
            # Children lie in falling order: the last one is visited first and keeps its parent's split.
            stack += [(one, depth, depth) for one in below[first : last - 1]]
            stack.append((below[last - 1], depth, split))
        return np.array(order, np.int64), np.array(parted[1:], np.int64)


class Extensions:
    """Longest common extensions of suffix pairs in constant time each."""

    def __init__(self, order: np.ndarray, parted: np.ndarray) -> None:
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.size = len(order)
        self.levels = [parted.astype(np.int32)]
        width = 1
        while 2 * width <= len(parted):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of different suffixes."""
        a, b = self.rank[left], self.rank[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(low), np.int64)
        for step in np.unique(level).tolist():
            here = level == step
            table = self.levels[step]
            found[here] = np.minimum(table[low[here]], table[high[here] - (1 << step)])
        return found


def _next_smaller(rank: list[int]) -> list[int]:
    """For each suffix the next one to its right that is smaller; there is one for all but the last."""
    found = [len(rank)] * len(rank)
    for place in range(len(rank) - 2, -1, -1):
        other = place + 1
        while other < len(rank) and rank[other] > rank[place]:
            other = found[other]
        found[place] = other
    return found


def runs_of(stretches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the stretch, start, length, period) of every run in sequences of word numbers."""
    count = len(stretches)
    # Each stretch has a mark of its own before and behind it, smaller than all words in both orders.
    marks = np.arange(1, count + 1)
    pieces: list[np.ndarray] = [np.array([0])]
    words = np.unique(np.concatenate(stretches), return_inverse=True)[1] + count + 1
    sizes = np.array([len(one) for one in stretches])
    begins = 1 + np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    for mark, one in zip(marks, np.split(words, np.cumsum(sizes)[:-1]), strict=True):
        pieces += [one, np.array([mark])]
    text = np.concatenate(pieces)
    size = int(text.max()) + 1
    rising = np.arange(size)
    falling = np.where(rising > count, size + count - rising, rising)
    tree = SuffixTree(text.tolist(), size)
    order, parted = tree.tour(rising)
    ahead = Extensions(order, parted)
    against = np.empty(len(text), np.int64)
    against[tree.tour(falling)[0]] = np.arange(len(text))
    del tree
    # The reversal ends with the very first mark, which occurs only there.
    behind = Extensions(*SuffixTree(text[::-1].tolist(), size).tour(rising))
    inner = np.flatnonzero(text > count)
    found = []
    for rank in (ahead.rank, against):
        after = np.array(_next_smaller(rank.tolist()), np.int64)[inner]
        period = after - inner
        right = ahead.of(inner, after)
        left = behind.of(len(text) - inner, len(text) - after)
        length = left + period + right
        good = length >= np.maximum(LEAST_WORDS, LEAST_POWER * period)
        found.append(np.stack([(inner - left)[good], length[good], period[good]]))
    start, length, period = np.unique(np.concatenate(found, axis=1), axis=1)
    owner = np.searchsorted(begins, start, side="right") - 1
    return owner, start - begins[owner], length, period


def _may_hold_runs(codes: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches outside which no run lies."""
    n = len(codes)
    order = np.lexsort((np.arange(n), codes, owner)) if n else np.empty(0, np.int64)
    same = (codes[order][1:] == codes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    gap = np.full(n, np.iinfo(np.int64).max)
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    starts, stops = [], []
    reach = 1
    longest = int(np.diff(np.concatenate(([0], ends))).max(initial=0))
    while True:
        # Periods above reach / 2 and up to reach.
        period = reach // 2 + 1
        needed = max(LEAST_WORDS, LEAST_POWER * period) - period
        if needed + period > longest:
            break
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gap <= reach, [False]))))
        first, last = edges[::2], edges[1::2]
        long = last - first >= needed
        first, last = first[long], last[long]
        starts.append(first)
        stops.append(np.minimum(last + reach, ends[owner[first]]))
        reach *= 2
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first, last = np.concatenate(starts), np.concatenate(stops)
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order]) if len(order) else last
    # A stretch that starts before the end of those before it belongs to them.
    fresh = np.concatenate(([True], first[1:] >= last[:-1]))[: len(first)]
    heads = np.flatnonzero(fresh)
    tails = np.concatenate((heads[1:] - 1, [len(first) - 1]))[: len(heads)]
    return first[heads], last[tails]


def _block_runs(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Columns start, length, period of all runs of a block of texts, starts counted over the block."""
    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
    first, last = _may_hold_runs(codes, owner, ends)
    parts, held, waiting = [], [], 0
    for number, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        held.append((a, b))
        waiting += b - a
        if waiting >= TREE_WORDS or number == len(first) - 1:
            which, start, length, period = runs_of([codes[x:y] for x, y in held])
            parts.append(np.stack([start + np.array([x for x, _ in held])[which], length, period]))
            held, waiting = [], 0
    if not parts:
        return np.empty((3, 0), np.int64)
    runs = np.concatenate(parts, axis=1)
    return runs[:, np.lexsort((runs[2], runs[0]))]


def _collapse(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of each text."""
    # Splits at the six ASCII white space characters; only the first and last piece can be empty.
    split = pc.ascii_split_whitespace(texts.cast(pa.string()))
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(full)))
    offsets = split.offsets.to_numpy().astype(np.int64)
    bounds = before[offsets - offsets[0]]
    words = flat.filter(pa.array(full)) if len(flat) else flat
    codes = pc.dictionary_encode(words).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start, length, period = _block_runs(codes, bounds[1:])
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change)[:-1] == 0
    left = np.concatenate(([0], np.cumsum(kept)))[bounds]
    rest = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(kept)))
    owner = np.searchsorted(bounds, start, side="right") - 1
    ends = np.searchsorted(owner, np.arange(len(bounds)))
    columns = [pa.array(one) for one in (start - bounds[owner], length, period)]
    runs = pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_RUN))
    )
    return pa.array(np.diff(bounds)), runs, pc.binary_join(rest, " ")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row.

    Words are what stands between the six ASCII white space characters, numbered from 0. `runs` are ordered by
    start, then period. `collapsed` keeps the first period of every run and all words outside of runs, joined
    by one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=2 << 20):
            columns = [block.column("doc_id"), *_collapse(block.column("text"))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
