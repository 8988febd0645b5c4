"""Near-duplicate documents by Order MinHash and banded alignment (operator 6).

A text's elements are its runs of five words, labelled with how often the run has occurred before, so that
all elements of a text differ. One sketch holds the two smallest elements under a random order, in the order
in which they stand in the text: two texts agree on it if they share both elements and their order, which
follows edit similarity rather than mere overlap. Three sketches make a key, sixteen keys a signature;
texts of similarity 0.8 share a key with probability 0.99, of 0.85 with 0.9995.

Similarity is measured by aligning the two element sequences within a band around the diagonal: with L
aligned elements of m and n, it is L / (m + n - L). The band is as wide as 0.8 allows insertions to shift.

Exact copies are collapsed first. All texts that share a key are compared, at every size of bucket: a bucket is
dealt into blocks by node, and a task compares two blocks. It leaves a pair to the first key that the two texts
share, so that each pair is aligned and counted once. Tasks hand on each text's partners as one list, so n different
near copies of one text hand on up to n * n / 2 ids; behind the alignment there is one row for each text and task,
its number of links and one text that it is connected with.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltline.llm.blocks import text_blocks, whole_text
from haltline.llm.words import STEP, mixed, word_hashes
from haltline.operators.components import connected_components
from haltline.session import keep_table

SIMILARITY = 0.8
SHINGLE = 5
#: Sketches of a key and keys of a signature.
ROWS, KEYS = 3, 16
#: Texts of a block; a task holds two blocks of a bucket.
BLOCK = 256
#: Pairs whose keys and sketches are compared at once.
PAIRS = 1 << 16
#: What names a task: a bucket and two of its blocks.
TASK = ["number", "key", "low", "high"]
#: Two texts of similarity 0.8 agree on 31 of 48 sketches on average; on fewer than this, practically never.
LEAST_AGREEING = 16

_ORDERS = np.random.default_rng(6).integers(1, 2**63, ROWS * KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def elements(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled runs of five words, text after text, and where each text's start.

    A text of one to four words is one run; a text without words has none.
    """
    sizes = np.diff(offsets)
    n_runs = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    starts = np.concatenate(([0], np.cumsum(n_runs)))
    owner = np.repeat(np.arange(len(sizes)), n_runs)
    place = offsets[:-1][owner] + np.arange(starts[-1]) - starts[:-1][owner]
    key = np.full(len(place), SHINGLE, dtype=np.uint64)
    padded = np.concatenate((words, np.zeros(SHINGLE, dtype=np.uint64)))
    short = sizes[owner] < SHINGLE
    for step in range(SHINGLE):
        word = padded[place + step]
        if short.any():
            word = np.where(short & (step >= sizes[owner]), np.uint64(0), word)
        key = mixed(key * STEP + word)
    return _labelled(key, owner), starts


def _labelled(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    if not len(key):
        return key
    own = mixed(key + owner.astype(np.uint64) * STEP)
    order = np.argsort(own, kind="stable")
    again = np.concatenate(([False], own[order][1:] == own[order][:-1]))
    if not again.any():
        return key
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
    count = np.empty(len(order), dtype=np.uint64)
    count[order] = np.arange(len(order)) - first
    return np.where(count > 0, mixed(key ^ (count * STEP)), key)


def signatures(items: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of ROWS * KEYS sketches for each text; a text without elements has zeros."""
    n = len(starts) - 1
    result = np.zeros((n, ROWS * KEYS), dtype=np.uint64)
    sizes = np.diff(starts)
    filled = np.flatnonzero(sizes > 0)
    if not len(filled):
        return result
    cuts, sizes = starts[filled], sizes[filled]
    largest = np.uint64(2**64 - 1)
    for number, order in enumerate(_ORDERS):
        value = items * order
        value ^= value >> np.uint64(32)
        first = np.minimum.reduceat(value, cuts)
        at_first = np.flatnonzero(value == np.repeat(first, sizes))
        value[at_first] = largest
        second = np.minimum.reduceat(value, cuts)
        at_second = np.flatnonzero((value == np.repeat(second, sizes)) & (value != largest))
        # Elements of a text differ, so each text has one place of either kind at most.
        row_first = np.searchsorted(cuts, at_first, side="right") - 1
        row_second = np.searchsorted(cuts, at_second, side="right") - 1
        one, two = np.full(len(cuts), -1), np.full(len(cuts), -1)
        one[row_first], two[row_second] = at_first, at_second
        swapped = (two >= 0) & (two < one)
        left, right = np.where(swapped, second, first), np.where(swapped, first, second)
        result[filled, number] = mixed(left * STEP + mixed(right))
    return result


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two element sequences by their best alignment within the band, or 0 below `least`."""
    m, n = len(a), len(b)
    if not m or not n or min(m, n) < least * max(m, n):
        return 0.0
    wanted = least * (m + n) / (1 + least)  # aligned elements that `least` needs
    # Of distinct elements an alignment is a rising sequence of places.
    order = np.argsort(b)
    place = np.minimum(np.searchsorted(b, a, sorter=order), n - 1)
    place = order[place]
    shared = b[place] == a
    band = m + n - 2 * wanted
    rows = np.flatnonzero(shared)
    rows = rows[np.abs(place[rows] - rows) <= band]
    if len(rows) < wanted - 1e-9:
        return 0.0
    places = place[rows]
    if (np.diff(places) > 0).all():
        aligned = len(places)
    else:
        tails: list[int] = []
        for value in places.tolist():
            at = bisect_left(tails, value)
            if at == len(tails):
                tails.append(value)
            else:
                tails[at] = value
        aligned = len(tails)
    similarity = aligned / (m + n - aligned)
    return similarity if similarity >= least - 1e-12 else 0.0


def text_digest(text: Column) -> Column:
    """What exact copies share."""
    return F.md5(text.cast("binary"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size, n_links) of every document.

    A class is a connected component of texts with similarity 0.8 or more; its id is its smallest doc_id.
    Rows of equal text are one text: all null and empty texts are one class, other texts without words are
    linked to equal texts only. `n_links` counts the links found from a row's text to different texts.
    """
    rows, nodes = _classes(docs, id_col, text_col)
    return rows.join(nodes, "digest").select("doc_id", "class_id", "class_size", "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, that keep one document of each class: that of the smallest id."""
    _, nodes = _classes(docs, id_col, text_col)
    kept = nodes.where("digest = class_digest").select(F.col("digest").alias("_digest"))
    first = Window.partitionBy("_digest").orderBy(F.col(id_col).asc_nulls_last())
    return (
        docs.withColumn("_digest", text_digest(whole_text(F.col(text_col))))
        .withColumn("_place", F.row_number().over(first))
        .where("_place = 1")
        .join(kept, "_digest", "left_semi")
        .select(*docs.columns)
    )


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of every row, and (digest, class_id, class_digest, class_size, n_links) of every text."""
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), whole_text(F.col(text_col)).alias("text")
    ).withColumn("digest", text_digest(F.col("text")))
    rows = texts.select("doc_id", "digest")
    signed = keep_table(
        texts.select("digest", "text")
        .mapInArrow(_sign, "digest string, keys binary, sketch binary")
        .groupBy("digest")
        .agg(F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.xxhash64("digest"))
    )
    links = keep_table(_links(texts, signed))
    labels = connected_components(links.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    counted = links.groupBy("node").agg(F.sum("n").alias("n_links"))
    # Copies are counted before they meet their class, so a hot text is one row.
    sizes = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    nodes = (
        sizes.withColumn("node", F.xxhash64("digest"))
        .join(labels, "node", "left")
        .join(counted, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
    )
    classes = nodes.groupBy("label").agg(
        F.min("least").alias("class_id"),
        F.sum("n").alias("class_size"),
        F.min(F.struct(F.col("least").isNull(), "least", "digest")).alias("lead"),
    )
    nodes = nodes.join(classes, "label").select(
        "digest",
        "class_id",
        F.col("lead.digest").alias("class_digest"),
        "class_size",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    return rows, nodes


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches):
        items, starts = elements(*word_hashes(block.column("text")))
        signed = signatures(items, starts)
        some = np.flatnonzero(np.diff(starts) > 0).tolist()
        grouped = signed.reshape(-1, KEYS, ROWS)
        keys = np.tile(np.arange(1, KEYS + 1, dtype=np.uint64), (len(signed), 1))
        for row in range(ROWS):
            keys = mixed(keys * STEP + grouped[:, :, row])
        # A byte of each sketch says well enough how many agree.
        short = (signed >> np.uint64(40)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [
                block.column("digest").take(pa.array(some, pa.int64())),
                pa.array((keys[row].tobytes() for row in some), pa.binary()),
                pa.array((short[row].tobytes() for row in some), pa.binary()),
            ],
            ["digest", "keys", "sketch"],
        )


def _links(texts: DataFrame, signed: DataFrame) -> DataFrame:
    """(node, root, n): `n` links of a text to texts that share a key with it, `root` the least text that these
    links connect it with, each for a part of its links; every link is counted in one part."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
            node = np.repeat(batch.column("node").to_numpy(), KEYS)
            number = np.tile(np.arange(KEYS, dtype=np.int32), batch.num_rows)
            columns = [pa.array(node), pa.array(number), pa.array(key)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "number", "key"])

    by_key = ["number", "key"]
    keyed = signed.select("node", "keys").mapInArrow(keys, "node long, number int, key long")
    shared = keyed.groupBy(*by_key).agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK)
    members = (
        keyed.join(shared, by_key)
        .select("node", *by_key, blocks.alias("blocks"), F.pmod("node", blocks).alias("block"))
        .join(signed.select("node", "keys", "sketch"), "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            *by_key,
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            (F.col("block") > F.col("other")).alias("second"),
            "node",
            "keys",
            "sketch",
        )
    )
    kind = "number int, key long, low long, high long, node long"
    candidates = keep_table(
        members.repartition(*TASK)
        .sortWithinPartitions(*TASK, "second")
        .mapInArrow(_candidates, f"{kind}, partners array<long>")
    )
    return (
        candidates.join(_sequences(texts, signed, candidates), "node")
        .repartition(*TASK)
        .sortWithinPartitions(*TASK)
        .mapInArrow(_aligned, "node long, root long, n long")
    )


def _whole_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The sorted rows again, all of one bucket's two blocks together, and where each such part starts."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
        if not sum(map(len, held)):
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(table.num_rows - 1, dtype=bool)
        for name in TASK:
            column = table.column(name).to_numpy()
            new |= column[1:] != column[:-1]
        starts = np.concatenate(([0], np.flatnonzero(new) + 1))
        if batch is None:
            yield table, np.append(starts, table.num_rows)
        else:
            last = int(starts[-1])
            if last:
                yield table.slice(0, last), starts
            held = table.slice(last).to_batches()


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text that may be similar to others of its task, with those of them that stand behind it."""
    for table, starts in _whole_tasks(batches):
        number, low, high, second, node = (
            table.column(name).to_numpy() for name in ("number", "low", "high", "second", "node")
        )
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64).reshape(-1, KEYS)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8)
        sketch = sketch.reshape(-1, ROWS * KEYS)
        # A row meets those behind it in one block, or those of the second block.
        rows, sizes = np.arange(len(node)), np.diff(starts)
        end = np.repeat(starts[1:], sizes)
        middle = end - np.repeat(np.add.reduceat(second.astype(np.int64), starts[:-1]), sizes)
        begin = np.where(low == high, rows + 1, np.where(second, end, middle))
        counts = end - begin
        ends = np.cumsum(counts)
        left, right = [], []
        start = 0
        while start < len(rows):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
            count = counts[start:stop]
            x = np.repeat(rows[start:stop], count)
            y = np.arange(len(x)) + np.repeat(begin[start:stop] - np.cumsum(count) + count, count)
            near = (sketch[x] == sketch[y]).sum(axis=1) >= LEAST_AGREEING
            x, y = x[near], y[near]
            own = (keys[x] == keys[y]).argmax(axis=1) == number[x]
            left.append(x[own])
            right.append(y[own])
            start = stop
        x, y = np.concatenate(left), np.concatenate(right)
        some = np.unique(np.concatenate((x, y)))
        lists = pa.LargeListArray.from_arrays(
            np.searchsorted(x, np.append(some, len(rows))), pa.array(node[y])
        ).cast(pa.list_(pa.int64()))
        picked = table.select([*TASK, "node"]).take(pa.array(some)).append_column("partners", lists)
        yield from picked.to_batches()


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text with links inside its task: their number, and the least text they connect it with."""
    for table, starts in _whole_tasks(batches):
        node, partners = (table.column(name).to_pylist() for name in ("node", "partners"))
        sequence = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("sequence")]
        label, n_links = list(range(len(node))), [0] * len(node)

        def root(one: int, label: list[int] = label) -> int:
            while label[one] != one:
                label[one] = one = label[label[one]]
            return one

        for begin, end in pairwise(starts.tolist()):
            place = {node[row]: row for row in range(begin, end)}
            for x in range(begin, end):
                for partner in partners[x]:
                    y = place[partner]
                    if aligned_similarity(sequence[x], sequence[y]) > 0:
                        n_links[x] += 1
                        n_links[y] += 1
                        one, two = root(x), root(y)
                        if node[two] < node[one]:
                            one, two = two, one
                        label[two] = one
        linked = [row for row, n in enumerate(n_links) if n]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([node[row] for row in linked], pa.int64()),
                pa.array([node[root(row)] for row in linked], pa.int64()),
                pa.array([n_links[row] for row in linked], pa.int64()),
            ],
            ["node", "root", "n"],
        )


def _sequences(texts: DataFrame, signed: DataFrame, candidates: DataFrame) -> DataFrame:
    """(node, sequence): the elements, in 32 bits each, of every text that may be similar to another."""

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            items, starts = elements(*word_hashes(block.column("text")))
            short = mixed(items).astype(np.uint32)
            lists = [short[x:y].tobytes() for x, y in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [block.column("node"), pa.array(lists, pa.binary())], ["node", "sequence"]
            )

    wanted = signed.select("node", "digest").join(candidates.select("node"), "node", "left_semi")
    # One row of each text: its copies are dropped inside every task, before the shuffle.
    by_digest = Window.partitionBy("digest").orderBy("doc_id")
    return (
        texts.withColumn("_place", F.row_number().over(by_digest))
        .where("_place = 1")
        .join(wanted, "digest")
        .select("node", "text")
        .mapInArrow(sequences, "node long, sequence binary")
    )
