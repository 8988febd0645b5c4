"""Token counts of a BPE SentencePiece model by rank-synchronous array merging (operator 4).

The distinct marked words of a block stand behind one another in flat numpy arrays. Every round looks up
each sequence's lowest-rank adjacent pair, leftmost first, and merges it in all sequences at once; what is
left of a sequence when no pair can be merged is its tokens. Words of more than `LONG` characters are merged
one by one with a heap, as rounds would take as long as the longest word.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from haltline.llm.blocks import id_and_text, text_blocks
from haltline.llm.chunks import space_chunks
from haltline.llm.piece_tokens import MARKER, markers_separate

LONG = 256
#: Distinct words whose counts a Python worker remembers between blocks.
REMEMBERED = 500_000
NEVER = np.int32(2**31 - 1)


class RankMerger:
    """The merges of a model: which neighbouring symbols join, in which order, into what."""

    def __init__(self, model_path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as file:
            model.ParseFromString(file.read())
        bpe, normal = 2, 1
        if model.trainer_spec.model_type != bpe or not markers_separate(model_path):
            raise ValueError("needs a BPE model with byte fallback whose pieces do not cross markers")
        pieces = {p.piece: p.score for p in model.pieces if p.type == normal}
        self.symbols = {piece: number for number, piece in enumerate(pieces)}
        characters = {character for piece in pieces for character in piece}
        for character in sorted(characters - pieces.keys()):
            self.symbols[character] = len(self.symbols)
        self.size = len(self.symbols) + 1  # the last one stands for all other characters
        ranks = {score: rank for rank, score in enumerate(sorted(set(pieces.values()), reverse=True))}
        merges = {}
        for piece, score in pieces.items():
            for cut in range(1, len(piece)):
                left, right = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if left is not None and right is not None:
                    merges[left * self.size + right] = (ranks[score], self.symbols[piece])
        self.keys = np.array(sorted(merges), dtype=np.int64)
        found = np.array([merges[key] for key in self.keys.tolist()], dtype=np.int32).reshape(-1, 2)
        self.ranks, self.merged = found[:, 0].copy(), found[:, 1].copy()
        # A character that is no piece ends as its UTF-8 bytes.
        self.of_point = np.full(0x110000, self.size - 1, dtype=np.int32)
        points = np.arange(0x110000)
        self.cost = (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int8)
        for character in characters:
            self.of_point[ord(character)] = self.symbols[character]
            if character in pieces:
                self.cost[ord(character)] = 1

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, a marker in front of it and in place of its spaces."""
        marked = [MARKER + word.replace(" ", MARKER) for word in words]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        result = np.zeros(len(marked), dtype=np.int64)
        short = np.flatnonzero(sizes <= LONG)
        points = np.frombuffer("".join(marked[i] for i in short).encode("utf-32-le"), np.uint32)
        result[short] = self._rounds(points, np.repeat(np.arange(len(short)), sizes[short]), len(short))
        for row in np.flatnonzero(sizes > LONG):
            result[row] = self._heap(marked[row])
        return result

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) * self.size + right
        places = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[places] == keys
        return np.where(hit, self.ranks[places], NEVER), self.merged[places]

    def _rounds(self, points: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        total = np.zeros(n, dtype=np.int64)
        symbols, cost = self.of_point[points], self.cost[points].astype(np.int64)
        rank = np.full(len(symbols), NEVER)
        if len(symbols) > 1:
            rank[:-1], _ = self.pairs(symbols[:-1], symbols[1:])
            rank[:-1][owner[:-1] != owner[1:]] = NEVER
        while len(symbols):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            sizes = np.diff(starts, append=len(owner))
            best = np.minimum.reduceat(rank, starts)
            done = best == NEVER
            total[owner[starts[done]]] = np.add.reduceat(cost, starts)[done]
            hit = np.flatnonzero((rank == np.repeat(best, sizes)) & (rank != NEVER))
            if not len(hit):
                break
            # The leftmost of each sequence; its right neighbour goes.
            hit = hit[np.diff(owner[hit], prepend=-1) != 0]
            _, symbols[hit] = self.pairs(symbols[hit], symbols[hit + 1])
            cost[hit] = 1
            keep = np.repeat(~done, sizes)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            hit = place[hit]
            symbols, cost, owner, rank = symbols[keep], cost[keep], owner[keep], rank[keep]
            touched = np.unique(np.concatenate((hit, hit - 1)))
            touched = touched[touched >= 0]
            after = np.minimum(touched + 1, len(symbols) - 1)
            new, _ = self.pairs(symbols[touched], symbols[after])
            rank[touched] = np.where((owner[touched] == owner[after]) & (after > touched), new, NEVER)
        return total

    def _heap(self, word: str) -> int:
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        symbols, cost = self.of_point[points].tolist(), self.cost[points].tolist()
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, merged = self.pairs(np.array(symbols[:-1]), np.array(symbols[1:]))
        waiting = [
            (int(rank[i]), i, symbols[i], symbols[i + 1], int(merged[i]))
            for i in np.flatnonzero(rank != NEVER)
        ]
        heapq.heapify(waiting)

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                key = symbols[left] * self.size + symbols[right]
                place = min(int(np.searchsorted(self.keys, key)), len(self.keys) - 1)
                if self.keys[place] == key:
                    entry = (symbols[left], symbols[right], int(self.merged[place]))
                    heapq.heappush(waiting, (int(self.ranks[place]), left, *entry))

        while waiting:
            _, left, first, second, joined = heapq.heappop(waiting)
            right = after[left]
            if right < 0 or symbols[left] != first or symbols[right] != second:
                continue
            symbols[left], cost[left] = joined, 1
            symbols[right], cost[right] = -1, 0
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return sum(cost)


class WordCounts:
    """Counts of distinct words, remembered up to a bound."""

    def __init__(self, model_path: str) -> None:
        self.merger = RankMerger(model_path)
        self.memory: dict[str, int] = {}

    def of(self, texts: pa.Array) -> np.ndarray:
        table = space_chunks(pc.replace_substring(texts, MARKER, " "))
        new = [chunk for chunk in table.chunks if chunk not in self.memory]
        found = dict(zip(new, self.merger.counts(new).tolist(), strict=True))
        if len(self.memory) + len(new) <= REMEMBERED:
            self.memory.update(found)
        each = np.array([self.memory.get(c) or found[c] for c in table.chunks], dtype=np.int64)
        ends = np.concatenate(([0], np.cumsum(each[table.codes])))
        return np.diff(ends[table.offsets])


_COUNTERS: dict[str, WordCounts] = {}


def token_counts(
    docs: DataFrame,
    model_path: str,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; nothing is shuffled.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows stay, row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _COUNTERS:
            _COUNTERS[model_path] = WordCounts(model_path)
        for block in text_blocks(batches):
            texts = block.column("text")
            counts = _COUNTERS[model_path].of(texts)
            sizes = pc.binary_length(texts).cast(pa.int64())
            columns = [block.column("doc_id"), sizes, pa.array(counts), pa.array(counts > limit)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
