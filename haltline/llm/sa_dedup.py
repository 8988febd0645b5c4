"""Exact substring deduplication with content-sharded suffix arrays (operator 1).

Every byte that is covered by a `length`-byte string which also starts anywhere else goes.

1. Each window of `length` bytes is named by its anchor, the least hash of all `GRAM`-byte strings inside it.
   Equal windows have equal anchors. Neighbouring windows with one anchor form a segment, about 137 windows.
   Anchors that occur once in the whole corpus cannot hold a repeated window, and their segments are dropped.
2. Equal segments are collapsed and counted. One text of each goes to the shard of its anchor, so all windows
   that can be equal meet in one shard, whose size is bounded whatever the corpus holds.
3. A shard's suffixes are sorted by induction (`induced_sort`); neighbours in that order with `length` bytes
   in common are repeated, and so is every window of a segment that occurs more than once.
4. An anchor with more distinct text than a shard holds is split up further, down to single windows, which are
   counted by a 128-bit digest. This too is exact and keeps the work of a task bounded.

Matches never cross texts. Rows that repeat both id and text are separate places of their strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltline.llm.blocks import flat_bytes, text_blocks, whole_text
from haltline.llm.induced_sort import agree_with_next, suffix_order
from haltline.llm.words import mixed
from haltline.session import keep_table

LENGTH = 400
#: Bytes of the strings whose hashes are anchors; at most `length`.
GRAM = 128
#: Bytes of distinct segments that one shard sorts.
SHARD_BYTES = 2 << 20

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 2**64)
_VALUES = np.random.default_rng(1).integers(0, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, name: str, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    known = _powers.get(name)
    if known is None or len(known) < n:
        known = np.full(n, base, dtype=np.uint64)
        known[:1] = 1
        known = _powers[name] = np.multiply.accumulate(known)
    return known[:n]


def window_hashes(data: np.ndarray, width: int, table: int = 0) -> np.ndarray:
    """A 64-bit hash of every `width` bytes: a polynomial in the bytes, well mixed."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[table][data] * _power(_FACTOR, "up", len(data)), out=sums[1:])
    return mixed((sums[width:] - sums[:n]) * _power(_INVERSE, "down", n))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbouring values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    top = np.uint64(2**64 - 1)
    padded = np.concatenate((values, np.full(-len(values) % width, top, dtype=np.uint64)))
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def segments(
    data: np.ndarray, offsets: np.ndarray, length: int, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in its text, windows, anchor, whether the anchor stands in it twice) of all segments."""
    nothing = np.empty(0, dtype=np.int64)
    width = length - gram + 1
    grams = window_hashes(data, gram)
    least = sliding_min(grams, width)
    if not len(least):
        return nothing, nothing, nothing, least, nothing.astype(bool)
    valid = np.zeros(len(least) + 1, dtype=np.int8)
    first, last = offsets[:-1], offsets[1:] - length + 1
    some = np.flatnonzero(last > first)
    change = np.ones(len(least), dtype=bool)
    change[1:] = least[1:] != least[:-1]
    np.add.at(valid, first[some], 1)
    np.add.at(valid, last[some], -1)
    valid = np.cumsum(valid)[:-1].astype(bool)
    change[first[some]] = True
    starts = np.flatnonzero(change & valid)
    stops = np.flatnonzero((np.append(change[1:], True) | ~np.append(valid[1:], False)) & valid) + 1
    anchors = least[starts]
    text = np.searchsorted(offsets, starts, side="right") - 1
    # A gram is some window's least one if no window that holds it has a smaller one.
    inverse = np.uint64(2**64 - 1) - least
    edge = np.full(width - 1, np.uint64(2**64 - 1), dtype=np.uint64)
    highest = np.uint64(2**64 - 1) - sliding_min(np.concatenate((edge, inverse, edge)), width)
    chosen = np.flatnonzero(grams == highest)
    low, high = np.searchsorted(chosen, starts), np.searchsorted(chosen, stops + width - 1)
    count = high - low
    owner = np.repeat(np.arange(len(starts)), count)
    place = chosen[np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)]
    own = owner[grams[place] == anchors[owner]]
    twice = np.bincount(own, minlength=len(starts)) > 1
    return text, starts - offsets[text], stops - starts, anchors, twice


#: A row is found again by its id and a hash of its text, not by a hash alone.
ROW = ["row_id", "row_key"]


def _row(doc_id: str, text: str) -> dict[str, Column]:
    return {"row_id": F.coalesce(doc_id, F.lit(0).cast("long")), "row_key": F.xxhash64(doc_id, text)}


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), whole_text(F.col(text_col)).alias("text")
    ).withColumns(_row("doc_id", "text"))


def repeated_spans(
    texts: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """(row_id, row_key, spans array<struct<start, size>>) for texts (doc_id, text, row_id, row_key): ranges to remove.

    Ranges may overlap. Texts that lose nothing have no row.
    """
    if gram > length:
        raise ValueError("gram must not exceed length")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=1 << 20):
            data, offsets = flat_bytes(block.column("text"))
            text, start, n, anchor, twice = segments(data, offsets, length, gram)
            raw = data.tobytes()
            begin = offsets[text] + start
            digest = b"".join(
                hashlib.blake2b(raw[a:b], digest_size=8).digest()
                for a, b in zip(begin.tolist(), (begin + n + length - 1).tolist(), strict=True)
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor.view(np.int64)),
                    pa.array(np.frombuffer(digest, np.int64)),
                    block.column("row_id").take(pa.array(text)),
                    block.column("row_key").take(pa.array(text)),
                    pa.array(start.astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array(twice),
                ],
                ["anchor", "digest", *ROW, "start", "n", "twice"],
            )

    found = keep_table(
        texts.select(*ROW, "text").mapInArrow(
            find, "anchor long, digest long, row_id long, row_key long, start int, n int, twice boolean"
        )
    )
    repeated = (
        found.groupBy("anchor")
        .agg(F.count("*").alias("places"), F.max("twice").alias("twice"))
        .where("places > 1 or twice")
        .select("anchor")
    )
    places = keep_table(found.drop("twice").join(repeated, "anchor"))
    distinct = keep_table(
        places.groupBy("anchor", "digest").agg(
            F.count("*").alias("copies"), F.min(F.struct(*ROW, "start", "n")).alias("lead")
        )
    )
    sizes = distinct.groupBy("anchor").agg(F.sum(F.col("lead.n") + length - 1).alias("bytes"))
    split = sizes.where(F.col("bytes") > shard_bytes).select("anchor", F.lit(True).alias("split"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    wanted = (
        distinct.join(split, "anchor", "left")
        .groupBy("lead.row_id", "lead.row_key")
        .agg(
            F.collect_list(
                F.struct(
                    "anchor",
                    "digest",
                    "copies",
                    F.coalesce("split", F.lit(False)).alias("split"),
                    "lead.start",
                    "lead.n",
                )
            ).alias("wanted")
        )
    )
    # Repeated rows would give a segment's text twice, which `_sorted_shard` and the sums below allow for.
    contents = texts.join(wanted, ROW).mapInArrow(
        _cutter(length), "anchor long, digest long, copies long, split boolean, content binary"
    )
    kind = "anchor long, digest long, at array<int>, windows array<int>"
    by_sort = (
        contents.where("not split")
        .withColumn("shard", F.pmod("anchor", F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(_sorted_shard(length), kind)
    )
    marks = by_sort
    if not split.isEmpty():
        marks = marks.unionByName(_single_windows(contents.where("split"), length))
    return (
        places.join(marks, ["anchor", "digest"])
        .select(*ROW, "start", F.explode(F.arrays_zip("at", "windows")).alias("mark"))
        .select(
            *ROW,
            F.struct(
                (F.col("start") + F.col("mark.at")).alias("start"),
                (F.col("mark.windows") + length - 1).alias("size"),
            ).alias("span"),
        )
        .groupBy(*ROW)
        .agg(F.collect_set("span").alias("spans"))
    )


def _cutter(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=1 << 20):
            rows: list[tuple[int, int, int, bool, bytes]] = []
            for text, wanted in zip(block.column("text"), block.column("wanted"), strict=True):
                raw = text.as_buffer()
                for one in wanted.as_py():
                    content = raw[one["start"] : one["start"] + one["n"] + length - 1].to_pybytes()
                    rows.append((one["anchor"], one["digest"], one["copies"], one["split"], content))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)],
                ["anchor", "digest", "copies", "split", "content"],
            )

    return cut


def _sorted_shard(length: int):
    """Windows of a shard's segments that start elsewhere too, as runs (at, windows) of each segment."""

    def run(table: pa.Table) -> pa.Table:
        anchor, digest = (table.column(c).to_numpy() for c in ("anchor", "digest"))
        _, once = np.unique(np.stack([anchor, digest]), axis=1, return_index=True)
        table = table.take(pa.array(np.sort(once)))
        contents = table.column("content").combine_chunks()
        data, offsets = flat_bytes(contents)
        sizes = np.diff(offsets)
        repeated = np.repeat(table.column("copies").to_numpy() > 1, sizes)
        # Segments one behind the other, a 1 after each and a 0 at the end; bytes from 2 up.
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(data)) + owner
        text = np.ones(len(data) + len(sizes) + 1, dtype=np.uint16)
        text[-1] = 0
        text[place] = data.astype(np.uint16) + 2
        starts = np.zeros(len(text), dtype=bool)
        window = np.arange(len(data)) + length <= offsets[1:][owner]
        starts[place[window]] = True
        order = suffix_order(text, length)
        order = order[starts[order]]
        order = order - np.searchsorted(offsets[1:] + np.arange(len(sizes)), order, side="right")
        same = agree_with_next(data, order, length)
        repeated[order[:-1][same]] = True
        repeated[order[1:][same]] = True
        repeated &= window
        return _runs(table, repeated, offsets)

    return run


def _runs(table: pa.Table, repeated: np.ndarray, offsets: np.ndarray) -> pa.Table:
    edge = np.zeros(len(repeated) + 1, dtype=np.int8)
    edge[:-1] += repeated
    edge[1:] -= repeated
    # Runs end within their segment, as no window starts in its last bytes.
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(offsets, begin, side="right") - 1
    cuts = np.searchsorted(owner, np.arange(len(offsets)))
    lists = [
        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int32)))
        for values in (begin - offsets[owner], end - begin)
    ]
    result = pa.table(
        {
            "anchor": table.column("anchor").combine_chunks(),
            "digest": table.column("digest").combine_chunks(),
            "at": lists[0],
            "windows": lists[1],
        }
    )
    return result.filter(pa.array(np.diff(cuts) > 0))


def _single_windows(contents: DataFrame, length: int) -> DataFrame:
    """As `_sorted_shard`, for segments of any number: every window is counted by its digest."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "content", limit=1 << 18):
            data, offsets = flat_bytes(batch.column("content"))
            high, low = window_hashes(data, length), window_hashes(data, length, 1)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            at = np.arange(len(data))
            at = at[at + length <= offsets[1:][owner]]
            rows = pa.array(owner[at])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(high[at].view(np.int64)),
                    pa.array(low[at].view(np.int64)),
                    batch.column("anchor").take(rows),
                    batch.column("digest").take(rows),
                    batch.column("copies").take(rows),
                    pa.array((at - offsets[owner[at]]).astype(np.int32)),
                ],
                ["high", "low", "anchor", "digest", "copies", "at"],
            )

    kind = "high long, low long, anchor long, digest long, copies long, at int"
    rows = contents.dropDuplicates(["anchor", "digest"]).select("anchor", "digest", "copies", "content")
    rows = rows.mapInArrow(windows, kind)
    again = rows.groupBy("high", "low").agg(F.sum("copies").alias("places")).where("places > 1")
    at = rows.join(again, ["high", "low"]).groupBy("anchor", "digest").agg(F.collect_set("at").alias("at"))
    return at.withColumn("windows", F.transform("at", lambda _: F.lit(1)))


def joined_spans(spans: list[dict], n_bytes: int) -> np.ndarray:
    """Which bytes the spans cover."""
    edge = np.zeros(n_bytes + 1, dtype=np.int32)
    np.add.at(edge, [span["start"] for span in spans], 1)
    np.add.at(edge, [span["start"] + span["size"] for span in spans], -1)
    return np.cumsum(edge[:-1]) > 0


def removal_digests(
    docs: DataFrame,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    gram: int = GRAM,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every whole text.

    Null and empty texts, and texts below `length` bytes, lose nothing. An empty table gives an empty one.
    """
    texts = keyed_texts(docs, id_col, text_col)
    spans = repeated_spans(texts, length, gram, shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            rows = []
            for text, spans in zip(block.column("text"), block.column("spans"), strict=True):
                raw = text.as_buffer().to_pybytes()
                if not spans.is_valid:
                    rows.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                    continue
                gone = joined_spans(spans.as_py(), len(raw))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                digest = hashlib.sha256(kept).hexdigest()
                rows.append((len(raw), int(gone.sum()), n_spans, digest))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    *(pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return (
        texts.join(spans, ROW, "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(
            run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        )
    )


def without_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    gram: int = GRAM,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """`docs` with all columns and rows, repeated bytes cut out of `text_col`.

    A character that loses some of its bytes goes altogether. A null text stays null.
    """
    texts = keyed_texts(docs, id_col, text_col)
    spans = repeated_spans(texts, length, gram, shard_bytes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text_col, limit=2 << 20):
            column = block.schema.names.index(text_col)
            given = block.column(text_col)
            kept = []
            for text, ranges in zip(given, block.column("_spans"), strict=True):
                if ranges.is_valid:
                    raw = text.as_py().encode()
                    gone = joined_spans(ranges.as_py(), len(raw))
                    kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes().decode(errors="ignore"))
                else:
                    kept.append(text.as_py())
            yield block.set_column(column, text_col, pa.array(kept, given.type)).select(names)

    names = docs.columns
    key = F.xxhash64(F.col(id_col).cast("long").alias("doc_id"), whole_text(F.col(text_col)).alias("text"))
    spans = spans.withColumnsRenamed({"row_id": "_row_id", "row_key": "_row_key", "spans": "_spans"})
    return (
        docs.withColumns({"_row_id": F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")), "_row_key": key})
        .join(spans, ["_row_id", "_row_key"], "left")
        .select(*names, "_spans")
        .mapInArrow(cut, docs.schema)
    )
