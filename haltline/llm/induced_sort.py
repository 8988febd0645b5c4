"""Suffix order by induced sorting with disk-backed bucket queues.

Suffixes that start a rise after a fall (S* suffixes) are sorted first: their substrings up to the next such
place are named in order, and the string of names, a third as long, is sorted in turn. All other suffixes
follow by induction: a suffix is its first symbol and the rank of the suffix behind it, and as those ranks
come in ascending order, a priority queue keyed by (symbol, rank) is one first-in-first-out queue for each
symbol. Queues hold positions as numpy arrays and write them to a temporary file beyond a memory budget.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Positions that all queues of one sort hold in memory.
HELD = 4 << 20


class BucketQueues:
    """One first-in-first-out queue of positions for each symbol, spilled to one temporary file."""

    def __init__(self, symbols: int, held: int = HELD) -> None:
        self.parts: list[list[np.ndarray | tuple[int, int]]] = [[] for _ in range(symbols)]
        self.held, self.count = held, 0
        self.file = None

    def push(self, symbol: int, positions: np.ndarray) -> None:
        self.parts[symbol].append(positions)
        self.count += len(positions)
        if self.count > self.held:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for parts in self.parts:
            for number, part in enumerate(parts):
                if isinstance(part, np.ndarray):
                    parts[number] = (self.file.seek(0, 2), len(part))
                    self.file.write(part.astype(np.int64).tobytes())
        self.count = 0

    def drain(self, symbol: int) -> Iterator[np.ndarray]:
        """The queue's positions in order, block by block; it is empty afterwards."""
        parts, self.parts[symbol] = self.parts[symbol], []
        for part in parts:
            if isinstance(part, np.ndarray):
                self.count -= len(part)
                yield part
            else:
                self.file.seek(part[0])
                yield np.frombuffer(self.file.read(8 * part[1]), np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def suffix_order(text: np.ndarray, depth: int, held: int = HELD) -> np.ndarray:
    """Positions of all suffixes of `text` in an order that is right for the first `depth` symbols.

    `text` holds small numbers and ends with its only 0, which stands for the end. Suffixes that agree on `depth`
    symbols stand together, in any order.
    """
    rises = _rises(text)
    starts = np.flatnonzero(rises[1:] & ~rises[:-1]) + 1
    starts = starts[_sorted_starts(text, starts, depth)]
    symbols = int(text.max()) + 1
    # S* suffixes by symbol; sorted, so each symbol has one range.
    bounds = np.searchsorted(text[starts], np.arange(symbols + 1))
    falling: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    queues = BucketQueues(symbols, held)
    for symbol in range(symbols):
        waiting = list(queues.drain(symbol))
        while waiting:
            again: list[np.ndarray] = []
            for block in waiting:
                falling[symbol].append(block)
                before = block[block > 0] - 1
                before = before[~rises[before]]
                _deal(text, before, symbol, queues, again)
            waiting = again
        own = starts[bounds[symbol] : bounds[symbol + 1]]
        _deal(text, own[own > 0] - 1, symbol, queues, [])
    queues.close()

    rising: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    queues = BucketQueues(symbols, held)
    for symbol in range(symbols - 1, -1, -1):
        waiting = list(queues.drain(symbol))
        while waiting:
            again = []
            for block in waiting:
                rising[symbol].append(block)
                before = block[block > 0] - 1
                before = before[rises[before]]
                _deal(text, before, symbol, queues, again)
            waiting = again
        for block in reversed(falling[symbol]):
            block = block[::-1]
            before = block[block > 0] - 1
            _deal(text, before[rises[before]], symbol, queues, [])
    queues.close()
    parts = []
    for symbol in range(symbols):
        parts.extend(falling[symbol])
        parts.extend(block[::-1] for block in reversed(rising[symbol]))
    # The end mark is the least suffix and is induced from nothing.
    return np.concatenate([np.array([len(text) - 1]), *parts])


def _rises(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one behind it; the end mark counts as rising."""
    n = len(text)
    change = np.ones(n, dtype=bool)
    change[:-1] = text[:-1] != text[1:]
    # Where the run of equal symbols that holds a place ends.
    ends = np.where(change, np.arange(n), n)
    ends = np.minimum.accumulate(ends[::-1])[::-1]
    after = np.minimum(ends + 1, n - 1)
    rises = text[ends] < text[after]
    rises[-1] = True
    return rises


def _deal(
    text: np.ndarray, before: np.ndarray, symbol: int, queues: BucketQueues, again: list[np.ndarray]
) -> None:
    """Append places to the queues of their symbols, in order; those of `symbol` itself go to `again`."""
    if not len(before):
        return
    first = text[before]
    order = np.argsort(first, kind="stable")
    before, first = before[order], first[order]
    cuts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
    for cut, part in zip(cuts.tolist(), np.split(before, cuts[1:]), strict=True):
        own = int(first[cut])
        if own == symbol:
            again.append(part)
        else:
            queues.push(own, part)


def _sorted_starts(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The order of the S* suffixes: substrings are named, and the string of names is sorted."""
    if len(starts) < 2:
        return np.arange(len(starts))
    raw = text.astype(">u2").tobytes()
    ends = np.append(starts[1:], len(text) - 1)
    # Where one substring begins another, the longer one falls where the shorter one rises: it is smaller.
    high = b"\xff\xff"
    bounds = zip((2 * starts).tolist(), (2 * ends + 2).tolist(), strict=True)
    # Few substrings differ, so their first appearances are kept and the rest are numbers at once.
    seen: dict[bytes, int] = {}
    first = np.fromiter(
        (seen.setdefault(raw[a:b] + high, len(seen)) for a, b in bounds), np.int64, len(starts)
    )
    pieces = list(seen)
    if starts[-1] == len(text) - 1:
        # The end mark is smaller than all, with no mark behind it.
        pieces.append(raw[-2:])
        first[-1] = len(pieces) - 1
    names = np.empty(len(pieces), dtype=np.int64)
    names[sorted(range(len(pieces)), key=pieces.__getitem__)] = np.arange(len(pieces))
    return _by_doubling(names[first], depth)


def _by_doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of a string of names, right for `depth` names; only unsettled suffixes are sorted again.

    A rank is the place of the first suffix that agrees so far.
    """
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    fresh = np.concatenate(([True], names[order][1:] != names[order][:-1]))
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    width = 1
    while width < depth:
        sorted_rank = rank[order]
        same = sorted_rank[1:] == sorted_rank[:-1]
        open_places = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        if not len(open_places):
            break
        own = order[open_places]
        behind = own + width
        next_rank = np.where(behind < n, rank[np.minimum(behind, n - 1)], -1)
        again = np.lexsort((next_rank, rank[own]))
        own, next_rank = own[again], next_rank[again]
        order[open_places] = own
        fresh = np.ones(len(own), dtype=bool)
        fresh[1:] = (rank[own][1:] != rank[own][:-1]) | (next_rank[1:] != next_rank[:-1])
        new = np.maximum.accumulate(np.where(fresh, open_places, 0))
        rank[own] = new
        width *= 2
    return order


def agree_with_next(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each neighbouring pair in `order`, whether `length` bytes of `data` from both places agree."""
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1))
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    left, right = order[:-1], order[1:]
    alive = np.arange(len(left))
    offsets = [*range(0, length - 7, 8), length - 8]
    # Far words first: neighbours agree on their first ones anyway.
    for offset in sorted(set(offsets), reverse=True):
        alive = alive[words[left[alive] + offset] == words[right[alive] + offset]]
    result = np.zeros(len(left), dtype=bool)
    result[alive] = True
    return result
