"""SentencePiece ids and back, through a table of distinct marked words (operator 2).

Where no piece of the model holds a whitespace marker behind another character, segmentation cannot
cross the start of a run of markers. Each distinct marked word of a block is then segmented once by the
library and its ids are joined back by position. Models without that property get whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from haltline.llm.blocks import id_and_text, ragged_take, text_blocks
from haltline.llm.chunks import ChunkTable, space_chunks

MARKER = "▁"
#: Distinct words that a task remembers between blocks.
REMEMBERED = 150_000


@dataclass(slots=True)
class Word:
    ids: list[int]
    decoded: str
    listed: str


@dataclass
class Segmented:
    """A block's chunk table and the segmentation of each distinct chunk."""

    table: ChunkTable
    words: list[Word]

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and where each text's ids start."""
        sizes = np.fromiter((len(word.ids) for word in self.words), np.int64, len(self.words))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.array([token for word in self.words for token in word.ids], dtype=np.int32)
        ids, ends = ragged_take(flat, starts, self.table.codes)
        return ids, ends[self.table.offsets]

    def counts(self) -> np.ndarray:
        sizes = np.fromiter((len(word.ids) for word in self.words), np.int64, len(self.words))
        ends = np.concatenate(([0], np.cumsum(sizes[self.table.codes])))
        return np.diff(ends[self.table.offsets])

    def decoded(self) -> list[str]:
        return self._joined(" ", [word.decoded for word in self.words])

    def listed(self) -> list[str]:
        """Decimal ids of each text, joined by commas."""
        return self._joined(",", [word.listed for word in self.words])

    def _joined(self, mark: str, parts: list[str]) -> list[str]:
        used = np.array(parts, dtype=object)[self.table.codes].tolist() if parts else []
        bounds = self.table.offsets.tolist()
        return [mark.join(used[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class WordSegmenter:
    """A SentencePiece model with a memory of distinct marked words."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.separable = markers_separate(model_path)
        self.memory: dict[str, Word] = {}

    def segment(self, texts: pa.Array) -> Segmented:
        if self.separable:
            # The model's marker in a text is a space to the model.
            table = space_chunks(pc.replace_substring(texts, MARKER, " "))
        else:
            table = whole_texts(texts)
        memory = self.memory
        new = [chunk for chunk in table.chunks if chunk not in memory]
        found = self._encode(new)
        if len(memory) + len(new) <= REMEMBERED:
            memory.update(found)
        return Segmented(table, [memory.get(chunk) or found[chunk] for chunk in table.chunks])

    def _encode(self, chunks: list[str]) -> dict[str, Word]:
        """Segment chunks, each of which stands behind a marker of its own."""
        lists = self.model.encode(chunks, num_threads=1) if chunks else []
        texts = self.model.decode(lists, num_threads=1) if chunks else []
        words = {
            chunk: Word(ids, text, ",".join(map(str, ids)))
            for chunk, ids, text in zip(chunks, lists, texts, strict=True)
        }
        if self.separable and "" in words:  # a lone marker
            mark = self.model.piece_to_id(MARKER)
            words[""] = Word([mark], "", str(mark))
        return words


def whole_texts(texts: pa.Array) -> ChunkTable:
    chunks = texts.to_pylist()
    return ChunkTable(chunks, np.arange(len(chunks)), np.arange(len(chunks) + 1))


def markers_separate(model_path: str) -> bool:
    """Whether the model adds one marker in front, changes nothing else, and no piece crosses one."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as file:
        model.ParseFromString(file.read())
    spec = model.normalizer_spec
    normal, control, unknown, byte = 1, 3, 2, 6
    return (
        spec.name == "identity"
        and not spec.precompiled_charsmap
        and spec.add_dummy_prefix
        and spec.escape_whitespaces
        and not spec.remove_extra_whitespaces
        and not model.trainer_spec.treat_whitespace_as_suffix
        and model.trainer_spec.byte_fallback
        and all(piece.type in (normal, control, unknown, byte) for piece in model.pieces)
        and any(piece.piece == MARKER and piece.type == normal for piece in model.pieces)
        and not any(
            MARKER in piece.piece.lstrip(MARKER) for piece in model.pieces if piece.type == normal
        )
    )


_SEGMENTERS: dict[str, WordSegmenter] = {}


def segmenter(model_path: str) -> WordSegmenter:
    """The model of this Python worker, loaded once."""
    if model_path not in _SEGMENTERS:
        _SEGMENTERS[model_path] = WordSegmenter(model_path)
    return _SEGMENTERS[model_path]


def encode_pieces(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every whole text.

    Null and empty texts have no ids and decode to the empty text. Repeated rows and ids stay, row by
    row; an empty table gives an empty one.
    """

    def columns(found: Segmented) -> list[pa.Array]:
        ids, offsets = found.ids()
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
        return [lists, pa.array(found.decoded(), pa.string())]

    return _per_text(
        id_and_text(docs, id_col, text_col),
        model_path,
        "doc_id long, ids array<int>, decoded string",
        columns,
    )


def piece_digests(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`encode_pieces` as (doc_id, n_tokens, ids_sha256, decoded_sha256), without moving the ids."""

    def columns(found: Segmented) -> list[pa.Array]:
        return [
            pa.array(found.counts()),
            pa.array(map(_sha256, found.listed()), pa.string()),
            pa.array(map(_sha256, found.decoded()), pa.string()),
        ]

    return _per_text(
        id_and_text(docs, id_col, text_col),
        model_path,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        columns,
    )


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _per_text(
    texts: DataFrame,
    model_path: str,
    schema: str,
    columns: Callable[[Segmented], list[pa.Array]],
) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = segmenter(model_path)
        for block in text_blocks(batches, limit=4 << 20):
            found = model.segment(block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *columns(found)], names)
        # Workers are used again by other stages, which need the memory.
        model.memory.clear()

    return texts.mapInArrow(run, schema)
