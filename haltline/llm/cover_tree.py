"""Exact top-k inner products by dual-tree cover-tree search (operator 8).

Equal vectors are collapsed first. A bounded number of far-apart pivots forms the root level: every vector
belongs to the cell of its nearest pivot, and each cell is cut into blocks of bounded size. Below that level
every block has a cover tree of its own, whose nodes cover their vectors by a radius that shrinks by a fixed
factor from level to level. Queries are indexed in the same cells and blocks.

A pair of a query node and a data node is pruned if no pair of vectors below it can reach the worst kth
score of the query group: with centres q and c and radii r and s, an inner product is at most
<q, c> + r |c| + s |q| + r s. First each query block meets a block of its own cell, which gives kth scores to
start from; then all other block pairs whose bound reaches them are searched. A task takes one data block and all
query blocks of a slice that have to meet it, so both trees are built once for many block pairs. Node pairs
of few products are multiplied at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haltline.session import keep_table

#: Most pivots, and the sample of vectors that they are chosen from.
PIVOTS, PIVOT_SAMPLE = 64, 4096
#: Distinct vectors of one block, and queries that meet a data block in one task.
DATA_BLOCK, QUERY_BLOCK, QUERY_SLICE = 1 << 15, 512, 1 << 14
#: Blocks and slices of long vectors have fewer of them, so that none has more components than this.
COMPONENTS = 1 << 21
#: Radii shrink by this factor from a cover-tree level to the next; nodes of few vectors are leaves.
BASE, LEAF = 1.3, 48
#: Most children of a node.
FAN = 16
#: A node pair of up to so many products is not split.
PRODUCTS = 1 << 20
#: Most tasks of a search.
MOST_TASKS = 20_000
#: The kth score of a query that has none yet.
NO_SCORE = np.iinfo(np.int64).min


@dataclass
class Node:
    """The vectors `start` to `end` of a tree, in the order of the tree."""

    start: int
    end: int
    center: np.ndarray
    radius: float
    norm: float
    children: list[Node] = field(default_factory=list)
    centers: np.ndarray | None = None
    radii: np.ndarray | None = None
    norms: np.ndarray | None = None

    def __len__(self) -> int:
        return self.end - self.start


class Tree:
    """A cover tree over `points`. `exact` and `ids` are theirs, and all three are kept in the order of the tree."""

    def __init__(self, points: np.ndarray, kind: type, ids: np.ndarray) -> None:
        self.points, self.exact, self.ids = points.astype(np.float64), points.astype(kind), ids.astype(np.int64)
        self.squares = (self.points**2).sum(axis=1)
        self.root = self._node(0, len(points))

    def _node(self, start: int, end: int) -> Node:
        center = self.points[start].copy()
        distance = np.sqrt(((self.points[start:end] - center) ** 2).sum(axis=1))
        return Node(start, end, center, float(distance.max()), float(np.sqrt(self.squares[start])))

    def grow(self) -> None:
        """All nodes at once; else they are split when a search comes to them."""
        open_ = [self.root]
        while open_:
            node = open_.pop()
            self.split(node)
            open_ += node.children

    def split(self, node: Node) -> None:
        if node.children or len(node) <= LEAF or node.radius == 0:
            return
        own, squares = self.points[node.start : node.end], self.squares[node.start : node.end]

        def to(row: int) -> np.ndarray:
            return np.maximum(squares + squares[row] - 2 * (own @ own[row]), 0)

        # Far points become children until all are covered by the next level's radius.
        cover, nearest, leads = (node.radius / BASE) ** 2, to(0), [0]
        owner = np.zeros(len(own), np.int64)
        while len(leads) < FAN:
            far = int(nearest.argmax())
            if far in leads or (nearest[far] <= cover and len(leads) > 1):
                break
            distance = to(far)
            closer = distance < nearest
            nearest = np.where(closer, distance, nearest)
            owner[closer] = len(leads)
            leads.append(far)
        if len(leads) < 2:
            return
        # The chosen point leads its own child.
        owner[leads] = np.arange(len(leads))
        first = np.ones(len(own), np.int64)
        first[leads] = 0
        moved = np.lexsort((first, owner))
        for array in (self.points, self.squares, self.exact, self.ids):
            array[node.start : node.end] = array[node.start : node.end][moved]
        ends = node.start + np.bincount(owner, minlength=len(leads)).cumsum()
        starts = [node.start, *ends[:-1].tolist()]
        node.children = [self._node(start, end) for start, end in zip(starts, ends.tolist(), strict=True)]
        node.centers = np.stack([child.center for child in node.children])
        node.radii = np.array([child.radius for child in node.children])
        node.norms = np.array([child.norm for child in node.children])


class DualTree:
    """The best `k` data rows of each query row, `kth` being scores that others have reached: a bound, not an answer."""

    def __init__(self, queries: np.ndarray, kth: np.ndarray, k: int, data: np.ndarray, ids: np.ndarray) -> None:
        self.k = k
        most = _longest(queries) * _longest(data)
        # All partial sums of a product are integers of at most |q| |c|: exact below 2 ** 24, 2 ** 53 and 2 ** 63.
        sure = ((np.float32, 2**24 - 2**10), (np.float64, 2**52), (np.int64, 2**62))
        self.kind = next((kind for kind, below in sure if most < below), object)
        self.asked, self.items = Tree(queries, self.kind, np.arange(len(queries))), Tree(data, self.kind, ids)
        self.asked.grow()
        self.kth = kth[self.asked.ids].astype(self.kind)
        # The best of each query so far, ordered by query, and what was found since.
        self.best = tuple(np.zeros(0, np.int64) for _ in range(3))
        self.since: list[tuple[np.ndarray, ...]] = []
        self.n_since = 0

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of the best."""
        open_ = [(np.inf, self.asked.root, self.items.root)]
        while open_:
            bound, a, b = open_.pop()
            if bound < float(self.kth[a.start : a.end].min()):
                continue
            if len(a) * len(b) > PRODUCTS:
                self.items.split(b)
            if len(a) * len(b) <= PRODUCTS or not a.children and not b.children:
                self._multiply(a, b)
                continue
            if not a.children or b.children and b.radius >= a.radius:
                pairs, bounds = [(a, child) for child in b.children], self._bounds(a, b)
            else:
                pairs, bounds = [(child, b) for child in a.children], self._bounds(b, a)
            # The last one is searched first.
            for n in np.argsort(bounds).tolist():
                open_.append((float(bounds[n]), *pairs[n]))
        self._merge()
        rows, scores, ids = self.best
        return self.asked.ids[rows], ids, scores

    @staticmethod
    def _bounds(one: Node, parent: Node) -> np.ndarray:
        """Bounds of `one` with each child of `parent`."""
        bounds = parent.centers @ one.center + one.radius * parent.norms + parent.radii * (one.norm + one.radius)
        return bounds + 1e-9 * (np.abs(bounds) + one.norm * parent.norms) + 1e-6

    def _multiply(self, a: Node, b: Node) -> None:
        scores = self.asked.exact[a.start : a.end] @ self.items.exact[b.start : b.end].T
        kth = self.kth[a.start : a.end]
        rows, places = np.nonzero(scores >= kth[:, None])
        if len(rows) > 4 * len(a) and len(b) > self.k and self.kind is not object:
            least = np.partition(scores, -self.k, axis=1)[:, -self.k]
            np.maximum(kth, least, out=kth)
            rows, places = np.nonzero(scores >= kth[:, None])
        if not len(rows):
            return
        self.since.append((rows + a.start, scores[rows, places].astype(np.int64), self.items.ids[b.start + places]))
        self.n_since += len(rows)
        if self.n_since > 4 * len(self.kth) + PRODUCTS // 16:
            self._merge()

    def _merge(self) -> None:
        """The best `k` of each query, equal scores to the smaller id."""
        if not self.since:
            return
        rows, scores, ids = (np.concatenate(parts) for parts in zip(self.best, *self.since, strict=True))
        self.since, self.n_since = [], 0
        order = np.lexsort((ids, ~scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        begins = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        nth = np.arange(len(rows)) - np.repeat(begins, np.diff(np.r_[begins, len(rows)]))
        last = nth == self.k - 1
        reached = scores[last].astype(self.kind)
        self.kth[rows[last]] = np.maximum(self.kth[rows[last]], reached)
        kept = nth < self.k
        self.best = rows[kept], scores[kept], ids[kept]


def _longest(points: np.ndarray) -> float:
    return float(np.sqrt((points.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))


def quantized(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, or null where a component is null, NaN or infinite."""
    usable = F.forall(
        vector,
        lambda x: x.isNotNull()
        & ~F.isnan(x)
        & (F.abs(x.cast("double")) != F.lit(float("inf"))),
    )
    return F.when(
        usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    )


def top_inner_products(
    vectors: DataFrame,
    k: int = 10,
    query_every: int = 100,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's `k` highest inner products with other rows.

    Queries are the rows whose id is divisible by `query_every`; vectors of another length than a query's are
    no candidates. Equal scores go to the smaller id; fewer candidates give fewer rows. Null ids and vectors
    that are null or hold null or non-finite components take no part. Rows that repeat an id and vector count
    once. Scores are exact and have to fit a long.
    """
    rows = keep_table(
        vectors.select(
            F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col), scale).alias("v")
        ).where("id is not null and v is not null")
    )
    # The k + 1 smallest ids of a vector decide, as one of them may be the query itself.
    by_vector = Window.partitionBy("v").orderBy("id")
    members = (
        rows.distinct()
        .withColumn("n", F.row_number().over(by_vector))
        .where(F.col("n") <= k + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.col("ids")[0].alias("id"), "v", "ids")
    )
    members = keep_table(members)
    asked = rows.where(F.col("id") % query_every == 0).distinct()
    lead = keep_table(asked.groupBy("v").agg(F.min("id").alias("query")))

    pivots = _pivots(members)
    cells = {size: len(points) for size, points in pivots.items()}
    data = keep_table(_blocks(members.select("id", "v"), pivots, DATA_BLOCK))
    groups = _blocks(lead.select(F.col("query").alias("id"), "v"), pivots, QUERY_BLOCK)
    n_slices = F.ceil(F.sum(F.col("n") * F.greatest(F.lit(1), F.col("size") * QUERY_SLICE / COMPONENTS)) / QUERY_SLICE)
    slices = groups.groupBy("size").agg(n_slices.alias("slices"))
    groups = groups.join(slices, "size").withColumn("slice", F.pmod(F.xxhash64("block"), F.col("slices")).cast("int"))
    groups = groups.drop("slices")
    groups = keep_table(
        groups.select("size", "slice", *(F.col(c).alias(f"q_{c}") for c in groups.columns if c not in ("size", "slice")))
    )

    heads, stems = groups.drop("q_ids", "q_points"), data.drop("ids", "points")
    near = heads.join(stems.where("part = 0").withColumnRenamed("cell", "q_cell"), ["size", "q_cell"])
    first = keep_table(_meet(near, groups.withColumn("kth", F.lit(None).cast("map<long,long>")), data, k + 1))
    kth = keep_table(
        first.groupBy("q_block", "query")
        .agg(F.count("*").alias("n"), F.min("score").alias("score"))
        .where(F.col("n") > k)
        .groupBy("q_block")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("query", "score"))).alias("kth"),
            F.min("score").alias("worst"),
            F.count("*").alias("known"),
        )
    )
    # Every query block against the blocks of every cell, by their covering radii alone.
    pairs = (
        heads.join(kth.drop("kth"), "q_block", "left")
        .withColumn("cell", F.explode(_sequence(cells)))
        .join(stems, ["size", "cell"])
        .where((F.col("q_cell") != F.col("cell")) | (F.col("part") != 0))
        .where(
            F.col("worst").isNull()
            | (F.col("known") < F.col("q_n"))
            | (_block_bound() >= F.col("worst"))
        )
    )
    asking = groups.join(kth.select("q_block", "kth"), "q_block", "left")
    found = first.unionByName(_meet(pairs, asking, data, k + 1))

    order = (F.col("score").desc(), F.col("id").asc())
    found = (
        found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
        .where(F.col("n") <= k + 1)
        .join(members.select("id", "ids"), "id")
        .select("query", "score", F.explode("ids").alias("vec_id"))
    )
    wanted = asked.join(lead, "v").select(F.col("id").alias("query_id"), "query")
    ranks = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return (
        wanted.join(found, "query")
        .where(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(ranks))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _sequence(cells: dict[int, int]) -> Column:
    """All cells of a row's vector length."""
    result = F.array().cast("array<int>")
    for size, count in cells.items():
        result = F.when(
            F.col("size") == size, F.sequence(F.lit(0), F.lit(count - 1)).cast("array<int>")
        ).otherwise(result)
    return result


def _block_bound() -> Column:
    dot = F.aggregate(
        F.zip_with("q_center", "center", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x
    )
    slack = F.col("q_norm") * F.col("norm") * 1e-9 + 1e-6
    return (
        dot
        + F.col("q_radius") * F.col("norm")
        + F.col("radius") * F.col("q_norm")
        + F.col("q_radius") * F.col("radius")
        + slack
    )


def _pivots(members: DataFrame) -> dict[int, np.ndarray]:
    """Far-apart vectors of a bounded sample, for each vector length."""
    sizes = [row[0] for row in members.select(F.size("v")).distinct().collect()]
    found = {}
    for size in sizes:
        own = members.where(F.size("v") == size)
        sample = own.select("v").orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect()
        points = np.array([row.v for row in sample], dtype=np.float64).reshape(len(sample), size)
        chosen, distance = [0], ((points - points[0]) ** 2).sum(axis=1)
        while len(chosen) < PIVOTS and distance.max(initial=0) > 0:
            chosen.append(int(distance.argmax()))
            distance = np.minimum(distance, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        found[size] = points[chosen]
    return found


def _blocks(vectors: DataFrame, pivots: dict[int, np.ndarray], limit: int) -> DataFrame:
    """Vectors by nearest pivot, in blocks of about `limit`: one row a block, with centre and radius."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            sizes = lists.value_lengths().to_numpy()
            cells = np.zeros(len(sizes), dtype=np.int32)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                points = lists.take(pa.array(own)).flatten().to_numpy().astype(np.float64)
                points, pivot = points.reshape(len(own), size), pivots[int(size)]
                away = (pivot**2).sum(axis=1) - 2 * points @ pivot.T
                cells[own] = away.argmin(axis=1)
            columns = [batch.column("id"), lists, pa.array(sizes, pa.int32()), pa.array(cells)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "size", "cell"])

    def pack(table: pa.Table) -> pa.Table:
        size, cell, part = (table.column(name)[0].as_py() for name in ("size", "cell", "part"))
        order = np.argsort(table.column("id").to_numpy())
        ids = table.column("id").to_numpy()[order]
        lists = table.column("v").combine_chunks()
        points = lists.flatten().to_numpy().reshape(len(ids), size)[order]
        center = points.mean(axis=0) if size else np.zeros(0)
        away = np.sqrt(((points - center) ** 2).sum(axis=1)).max()
        row = {
            "block": f"{size}/{cell}/{part}",
            "size": size,
            "cell": cell,
            "part": part,
            "n": len(ids),
            "center": center.tolist(),
            "radius": float(away),
            "norm": float(np.sqrt((center**2).sum())),
            "ids": ids.astype(np.int64).tobytes(),
            "points": _packed(points),
        }
        return pa.Table.from_pylist([row], schema=block_schema)

    block_schema = pa.schema(
        [
            ("block", pa.string()),
            ("size", pa.int32()),
            ("cell", pa.int32()),
            ("part", pa.int32()),
            ("n", pa.int64()),
            ("center", pa.list_(pa.float64())),
            ("radius", pa.float64()),
            ("norm", pa.float64()),
            ("ids", pa.binary()),
            ("points", pa.binary()),
        ]
    )
    placed = vectors.mapInArrow(assign, "id long, v array<long>, size int, cell int")
    most = F.greatest(F.lit(1), F.least(F.lit(limit), F.floor(F.lit(COMPONENTS) / F.greatest(F.col("size"), F.lit(1)))))
    parts = placed.groupBy("size", "cell").agg(F.ceil(F.count("*") / most).alias("parts"))
    return (
        placed.join(parts, ["size", "cell"])
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .groupBy("size", "cell", "part")
        .applyInArrow(
            pack,
            "block string, size int, cell int, part int, n long, center array<double>, "
            "radius double, norm double, ids binary, points binary",
        )
    )


def _packed(points: np.ndarray) -> bytes:
    """Integers in as few bytes each as all of them fit."""
    kinds = (np.int16, np.int32, np.int64)
    low, high = points.min(initial=0), points.max(initial=0)
    return points.astype(next(kind for kind in kinds if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max)).tobytes()


def _unpacked(packed: bytes, rows: int, size: int) -> np.ndarray:
    if not size:
        return np.zeros((rows, 0), np.int64)
    return np.frombuffer(packed, f"i{len(packed) // (rows * size)}").reshape(rows, size)


def _meet(pairs: DataFrame, asking: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """Search pairs(q_block, slice, block) of query and data blocks: (q_block, query, id, score).

    A task takes a data block and the query blocks of one slice that meet it. Their rows are few and long to
    search, so their number, not their size, says how many partitions there are.
    """
    pairs = keep_table(pairs.select("q_block", "slice", "block"))
    units = pairs.select("slice", "block").distinct()
    n_tasks = min(2 * units.count() + 1, MOST_TASKS)
    blocks = units.join(data.select("block", "size", "ids", "points"), "block")
    queries = pairs.select("q_block", F.col("slice").alias("q_slice"), F.col("block").alias("q_unit"))
    queries = queries.join(asking.select("q_block", "q_ids", "q_points", "kth"), "q_block")

    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        found = [pa.array([], kind) for kind in (pa.string(), pa.int64(), pa.int64(), pa.int64())]
        if blocks.num_rows and queries.num_rows:
            (block,) = blocks.to_pylist()
            ids, asked, kths, points = np.frombuffer(block["ids"], np.int64), [], [], []
            for row in queries.select(["q_ids", "q_points", "kth"]).to_pylist():
                known = dict(row["kth"] or ())
                asked.append(np.frombuffer(row["q_ids"], np.int64))
                kths.append(np.array([known.get(query, NO_SCORE) for query in asked[-1].tolist()], np.int64))
                points.append(_unpacked(row["q_points"], len(asked[-1]), block["size"]))
            names = np.repeat(np.arange(len(asked)), [len(one) for one in asked])
            asked, kths, points = (np.concatenate(parts) for parts in (asked, kths, points))
            rows, best, scores = DualTree(points, kths, k, _unpacked(block["points"], len(ids), block["size"]), ids).search()
            q_block = queries.column("q_block").take(pa.array(names[rows])).cast(pa.string())
            found = [q_block, pa.array(asked[rows]), pa.array(best), pa.array(scores)]
        return pa.table(found, names=["q_block", "query", "id", "score"])

    queries = queries.repartition(n_tasks, "q_slice", "q_unit").groupBy("q_slice", "q_unit")
    return (
        blocks.repartition(n_tasks, "slice", "block")
        .groupBy("slice", "block")
        .cogroup(queries)
        .applyInArrow(run, "q_block string, query long, id long, score long")
    )
