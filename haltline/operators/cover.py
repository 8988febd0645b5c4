"""The first keys inside boxes from whole cells, for boxes that hold far more points than they ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltline.operators.grid import CELL_SIZES, box_cells, cell_keys, points_in_boxes
from haltline.operators.ranking import first_per_group, merge_lists, ranked_lists
from haltline.operators.spread import spread_join
from haltline.session import keep_table

#: A box is covered by cells if its own cells hold more points than so many times its limit.
CROWD = 4
#: A cell on the border of a box is taken point by point once it holds less than this share of the limit.
BORDER_SHARE = 8
#: Before a crowded box is covered, so many keys for each one it asks for are read of every cell it touches, and
#: `PREFIX_ROWS` more.
PREFIX_TIMES = (2, 16)
PREFIX_ROWS = 16

_CELL = ["cell_level", "cell_y", "cell_x"]


def first_keys_in_boxes(spots: DataFrame, key: str, requests: DataFrame, largest: int) -> DataFrame:
    """requests(request_id, min_lat, min_lon, max_lat, max_lon, limit) to rows (request_id, limit, key).

    They hold the first `limit` keys of each box; the caller cuts the rest. Points of a box with few of them are
    looked at one by one. For a crowded box the first keys of the few cells it touches are read, twice at most, which
    answers all boxes but those that hold little of their cells. These are covered by whole cells of mixed size, and by
    the points of small cells along the border. Each cell has its keys as a ranked list, and these lists are merged
    as far as asked, so rows grow with the limit and the border, not with what the box holds.
    """
    spots = keep_table(spots)
    # Sizes are guessed from compressed files, in which cells and borders count for next to nothing: without the hints
    # millions of them would be broadcast, through the driver.
    counts = keep_table(cell_keys(spots).groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n"))).hint("merge")
    touched = box_cells(requests).join(counts, _CELL)
    held = touched.groupBy("request_id", "limit").agg(F.sum("n").alias("n"))
    crowded = keep_table(held.filter(F.col("n") > CROWD * F.col("limit")).select("request_id"))
    columns = ["request_id", "limit", key]
    if crowded.isEmpty():
        return points_in_boxes(spots, requests).select(*columns)
    quiet = requests.join(crowded, "request_id", "left_anti")
    found = points_in_boxes(spots, quiet).select(*columns)
    left = keep_table(requests.join(crowded, "request_id", "left_semi"))
    for times in PREFIX_TIMES:
        answered, left = _from_prefixes(spots, key, left, counts, largest, times)
        found = found.unionByName(answered.select(*columns))
        if left.isEmpty():
            break
    inner, border = _cover(box_cells(left).join(counts, _CELL), counts)
    cells = cell_keys(spots).hint("merge")
    rows = cells.join(inner.select(*_CELL).distinct().hint("merge"), _CELL, "left_semi").select(*_CELL, key)
    ranked, _ = ranked_lists(rows, _CELL, key, [], largest)
    asked = inner.select("request_id", "limit", *_CELL, F.lit(0).cast("long").alias("before"))
    whole = merge_lists(ranked.hint("merge"), asked, _CELL, key, ["request_id"]).select(*columns)
    single = border.join(cells, _CELL).filter(_inside_box("latitude", "longitude")).select(*columns)
    return found.unionByName(whole).unionByName(single)


def _from_prefixes(
    spots: DataFrame, key: str, boxes: DataFrame, counts: DataFrame, largest: int, times: int
) -> tuple[DataFrame, DataFrame]:
    """Answers of the boxes that the first keys of their cells are enough for, and the boxes left.

    Of a cell read in part nothing is known behind its last key read. Up to the least of these keys a box knows all it
    holds, and it is answered if that is as much as it asks for.
    """
    depth = (F.col("limit") * times + PREFIX_ROWS).alias("depth")
    asked = box_cells(boxes).select("*", depth).join(counts, _CELL)
    depths = asked.groupBy(*_CELL).agg(F.max("depth").alias("deepest"))
    rows = cell_keys(spots).join(depths.hint("merge"), _CELL)
    rows = first_per_group(rows, _CELL, [key], largest * times + PREFIX_ROWS)
    rows = keep_table(rows.filter(F.col("rank") <= F.col("deepest")).drop("deepest"))
    read = keep_table(
        spread_join(asked, rows, _CELL, ["request_id"])
        .filter(F.col("rank") <= F.col("depth"))
        .select(
            "request_id",
            "limit",
            key,
            _inside_box("latitude", "longitude").alias("inside"),
            ((F.col("rank") == F.col("depth")) & (F.col("n") > F.col("depth"))).alias("cut"),
        )
        .filter("inside OR cut")
    )
    known = read.filter("cut").groupBy("request_id").agg(F.min(key).alias("known"))
    first = first_per_group(read.filter("inside"), ["request_id"], [key], largest).filter("rank <= limit")
    last = first.filter("rank = limit").select("request_id", F.col(key).alias("last"))
    enough = F.col("known").isNull() | F.coalesce(F.col("last") <= F.col("known"), F.lit(False))
    ended = boxes.select("request_id").join(known, "request_id", "left").join(last, "request_id", "left").filter(enough)
    ended = keep_table(ended.select("request_id"))
    return first.join(ended, "request_id", "left_semi"), keep_table(boxes.join(ended, "request_id", "left_anti"))


def _inside_box(lat: str, lon: str) -> Column:
    return F.col(lat).between(F.col("min_lat"), F.col("max_lat")) & F.col(lon).between(
        F.col("min_lon"), F.col("max_lon")
    )


def _cover(front: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells wholly inside their box, and cells on its border that are small enough."""
    size = F.element_at(F.array(*map(F.lit, CELL_SIZES)), F.col("cell_level") + 1)
    south, west = F.col("cell_y") * size, F.col("cell_x") * size
    whole = (
        (south >= F.col("min_lat"))
        & (south + size <= F.col("max_lat"))
        & (west >= F.col("min_lon"))
        & (west + size <= F.col("max_lon"))
    )
    small = (F.col("n") * BORDER_SHARE <= F.col("limit")) | (F.col("cell_level") == len(CELL_SIZES) - 1)
    kind = F.when(whole, "inner").when(small, "border").otherwise("open")
    steps = F.sequence(F.lit(0), F.lit(3))
    found: DataFrame | None = None
    while True:
        cells = keep_table(front.withColumn("kind", kind))
        done = cells.filter("kind != 'open'")
        found = done if found is None else found.unionByName(done)
        open_ = cells.filter("kind = 'open'").drop("kind", "n")
        if open_.isEmpty():
            return found.filter("kind = 'inner'"), found.filter("kind = 'border'")
        # A cell has four by four children, each a quarter of its size.
        front = (
            open_.withColumn("cell_level", F.col("cell_level") + 1)
            .withColumn("step", F.explode(steps))
            .withColumn("cell_y", F.col("cell_y") * 4 + F.col("step"))
            .withColumn("step", F.explode(steps))
            .withColumn("cell_x", F.col("cell_x") * 4 + F.col("step"))
            .drop("step")
            .join(counts, _CELL)
        )
