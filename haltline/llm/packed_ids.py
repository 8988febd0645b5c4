"""Token ids in fixed-width bit-packed blocks (operator 3).

File format: Parquet files whose rows are blocks of whole documents in ascending doc_id order.

    shard, block      place of the block; shards follow one another, blocks within a shard too
    bits              width of one id, the least that holds the vocabulary
    doc_ids           documents of the block
    starts            where each document's ids start, counted in ids from the start of the shard
    n_ids             ids in the block
    payload           the ids, `bits` bits each, most significant bit first

The row of a block is found by Parquet statistics on `first_id` and `last_id`; id number i of a block is at
bit i * bits, so any range can be unpacked without the rest (`unpack_range`). Parquet gives the format
atomic commits: a lost executor's half-written files never show.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haltline.llm.blocks import id_and_text, ragged_take, text_blocks
from haltline.llm.chunks import spaced_chunks

#: A block is closed at so many ids; the last document of a block may exceed it.
BLOCK_IDS = 1 << 18
#: Distinct chunks that a Python worker remembers between blocks.
REMEMBERED = 300_000
#: New chunks that are encoded as one line, and how byte-level tokens write a space.
LINE, SPACE = 512, "\u0120"

BLOCK_SCHEMA = (
    "shard int, block int, first_id long, last_id long, bits int, "
    "doc_ids array<long>, starts array<long>, n_ids long, payload binary"
)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of at most `bits` bits, one behind the other."""
    if bits == 16:
        return ids.astype(">u2").tobytes()
    wide = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1)[:, 32 - bits :]).tobytes()


def unpack_range(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids number start up to stop of a block, as unsigned 32-bit integers."""
    first, last = start * bits // 8, -(-stop * bits // 8)
    raw = np.frombuffer(payload, np.uint8)[first:last]
    if bits == 16:
        return raw.view(">u2").astype("<u4")
    flags = np.unpackbits(raw)[start * bits - 8 * first :][: (stop - start) * bits]
    wide = np.zeros((stop - start, 32), np.uint8)
    wide[:, 32 - bits :] = flags.reshape(-1, bits)
    return np.packbits(wide, axis=1).view(">u4").ravel().astype("<u4")


class ChunkEncoder:
    """A tokenizer of the tokenizers library that sees each distinct chunk once."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        # Byte-level words start at a space; texts of any other kind are encoded whole.
        self.separable = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
            and spec.get("normalizer") is None
            and spec.get("truncation") is None
            and spec.get("padding") is None
            and not any(
                " " in token["content"] or token["lstrip"] or token["rstrip"] or token["single_word"]
                for token in spec.get("added_tokens", ())
            )
        )
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        added = {token["id"] for token in spec.get("added_tokens", ())}
        self.opens = np.zeros(1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values()), dtype=bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.opens[number] = token.startswith(SPACE) and number not in added
        #: Place of each remembered chunk in `ids`, whose parts start at `starts`.
        self.memory: dict[str, int] = {}
        self.ids, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and where each text's ids start."""
        if not self.separable:
            found = self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)
            offsets = np.cumsum([0, *(len(one.ids) for one in found)])
            return np.array([i for one in found for i in one.ids], np.uint32), offsets
        table = spaced_chunks(texts)
        rows = np.fromiter(map(self.memory.get, table.chunks, repeat(-1)), np.int64, len(table.chunks))
        unknown = np.flatnonzero(rows < 0)
        new = [table.chunks[n] for n in unknown.tolist()]
        fresh, sizes = self._encode_each(new)
        known = len(self.starts) - 1
        # A chunk may be listed as the first of a text and as a later one.
        rows[unknown] = np.arange(known, known + len(new))
        flat = np.concatenate((self.ids, fresh))
        starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes, dtype=np.int64)))
        if known + len(new) <= REMEMBERED:
            self.memory.update(zip(new, range(known, known + len(new)), strict=True))
            self.ids, self.starts = flat, starts
        ids, ends = ragged_take(flat, starts, rows[table.codes])
        return ids, ends[table.offsets]

    def _encode_each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks, one after the other, and how many each has.

        Chunks of a space and a word are joined to lines of `LINE` chunks, as a call for each of them costs more than
        its tokens. Their ids are parted where a token starts with a space; a line that does not
        show one such token for each chunk is encoded chunk by chunk.
        """
        joined = [n for n, c in enumerate(chunks) if c[:1] == " " and " " not in c[1:] and not c[-1].isspace()]
        lines = [joined[n : n + LINE] for n in range(0, len(joined), LINE)]
        sizes = np.zeros(len(chunks), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        encoded = self.tokenizer.encode_batch_fast(
            ["".join([chunks[n] for n in line]) for line in lines], add_special_tokens=False
        )
        alone = np.ones(len(chunks), dtype=bool)
        for line, one in zip(lines, encoded, strict=True):
            ids = np.array(one.ids, dtype=np.uint32)
            heads = np.flatnonzero(self.opens[ids])
            if len(heads) == len(line) and heads[0] == 0:
                places = np.array(line)
                sizes[places] = np.diff(heads, append=len(ids))
                alone[places] = False
                parts.append((places, ids))
        rest = np.flatnonzero(alone)
        for n, one in zip(
            rest.tolist(),
            self.tokenizer.encode_batch_fast([chunks[n] for n in rest.tolist()], add_special_tokens=False),
            strict=True,
        ):
            sizes[n] = len(one.ids)
            parts.append((np.array([n]), np.array(one.ids, dtype=np.uint32)))
        # Parts in the order they were found, then chunks in their own.
        order = np.concatenate([places for places, _ in parts] or [np.empty(0, np.int64)])
        flat = np.concatenate([ids for _, ids in parts] or [np.empty(0, np.uint32)])
        found = np.concatenate(([0], np.cumsum(sizes[order], dtype=np.int64)))
        back = np.empty(len(chunks), dtype=np.int64)
        back[order] = np.arange(len(order))
        return ragged_take(flat, found, back)[0], sizes


_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def write_packed_ids(
    docs: DataFrame,
    tokenizer_path: str,
    path: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every whole text, append `end_id`, and write all ids in ascending doc_id order.

    Null and empty texts hold the end id only. A null doc_id comes first; rows that share a doc_id stay
    separate, in the order of a hash of their text, and may spread over several shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(tokenizer_path)
        bits = max(1, int(max(encoder.size - 1, end_id)).bit_length())
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list[int | None], np.ndarray, np.ndarray]] = []
        waiting = 0

        def close() -> pa.RecordBatch:
            doc_ids = [i for part in held for i in part[0]]
            sizes = np.concatenate([part[1] for part in held])
            ids = np.concatenate([part[2] for part in held])
            starts = start + np.concatenate(([0], np.cumsum(sizes)[:-1]))
            row = {
                "shard": shard,
                "block": number,
                "first_id": doc_ids[0],
                "last_id": doc_ids[-1],
                "bits": bits,
                "doc_ids": doc_ids,
                "starts": starts.tolist(),
                "n_ids": len(ids),
                "payload": pack(ids, bits),
            }
            return pa.RecordBatch.from_pylist([row], schema)

        for block in text_blocks(batches, limit=4 << 20):
            ids, offsets = encoder.encode(block.column("text"))
            with_end = np.insert(ids, offsets[1:], end_id)
            held.append((block.column("doc_id").to_pylist(), np.diff(offsets) + 1, with_end))
            waiting += len(with_end)
            if waiting >= BLOCK_IDS:
                yield close()
                number, start, waiting = number + 1, start + waiting, 0
                held.clear()
        if held:
            yield close()

    schema = pa.schema(
        [
            ("shard", pa.int32()),
            ("block", pa.int32()),
            ("first_id", pa.int64()),
            ("last_id", pa.int64()),
            ("bits", pa.int32()),
            ("doc_ids", pa.list_(pa.int64())),
            ("starts", pa.list_(pa.int64())),
            ("n_ids", pa.int64()),
            ("payload", pa.binary()),
        ]
    )
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    (
        id_and_text(docs, id_col, text_col)
        .repartitionByRange(shards, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(run, BLOCK_SCHEMA)
        .write.option("compression", "none")
        .parquet(path)
    )


def read_packed_ids(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with `base`, the number of ids in all shards before."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # One row for each shard, of which a table has as many as shuffle partitions.
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    bases = np.concatenate(([0], np.cumsum([row.n for row in sizes], dtype=np.int64)))
    known = spark.createDataFrame(
        [(row.shard, int(base)) for row, base in zip(sizes, bases, strict=False)],
        "shard int, base long",
    )
    return blocks.join(F.broadcast(known), "shard")


def packed_digests(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its packed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_range(row["payload"], row["bits"], 0, row["n_ids"])
                starts = np.array(row["starts"], dtype=np.int64)
                bounds = np.append(starts - starts[0], row["n_ids"])
                raw = memoryview(ids.astype("<u4").tobytes())
                pairs = zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + row["base"]),
                        pa.array(np.diff(bounds)),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in pairs], pa.int64()),
                    ],
                    names,
                )

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
