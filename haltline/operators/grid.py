"""Points in boxes as an equality join over grid cells of several sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haltline.operators.spread import spread_join

# Cell sizes in degrees, each a quarter of the one before: 256, 64, … 0.0009765625.
# Powers of two keep cell borders exact, and the coarsest cell covers any box.
CELL_SIZES = tuple(256.0 / 4**level for level in range(10))


def _cell(value: Column, size: Column | float) -> Column:
    return F.floor(value / size).cast("int")


def distinct_spots(points: DataFrame, key: str, keep: int) -> DataFrame:
    """Of points at exactly the same position, the `keep` smallest keys.

    Answers never hold more than `keep` rows and break ties by key, so the others can never be
    part of one. However many points share a position, a box meets at most `keep` of them.
    """
    spot = Window.partitionBy("latitude", "longitude").orderBy(key)
    return (
        points.withColumn("nth", F.row_number().over(spot))
        .filter(F.col("nth") <= keep)
        .drop("nth")
    )


def cell_keys(points: DataFrame) -> DataFrame:
    """Each point once per cell size, with (cell_level, cell_y, cell_x)."""
    return points.withColumn(
        "cell",
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(level).alias("level"),
                        _cell(F.col("latitude"), size).alias("y"),
                        _cell(F.col("longitude"), size).alias("x"),
                    )
                    for level, size in enumerate(CELL_SIZES)
                )
            )
        ),
    ).select(
        "*",
        F.col("cell.level").alias("cell_level"),
        F.col("cell.y").alias("cell_y"),
        F.col("cell.x").alias("cell_x"),
    ).drop("cell")


def box_cells(boxes: DataFrame) -> DataFrame:
    """Boxes once per cell they touch, on the finest size that needs at most 5 x 5 cells."""
    extent = F.greatest(
        F.col("max_lat") - F.col("min_lat"), F.col("max_lon") - F.col("min_lon")
    )
    level, size = F.lit(0), F.lit(CELL_SIZES[0])
    for index, cell_size in enumerate(CELL_SIZES[1:], start=1):
        fits = extent <= 4 * cell_size
        level = F.when(fits, F.lit(index)).otherwise(level)
        size = F.when(fits, F.lit(cell_size)).otherwise(size)
    sized = boxes.withColumn("cell_level", level).withColumn("cell_size", size)
    for axis, low, high in (("y", "min_lat", "max_lat"), ("x", "min_lon", "max_lon")):
        sized = sized.withColumn(
            f"cell_{axis}",
            F.explode(
                F.sequence(
                    _cell(F.col(low), F.col("cell_size")), _cell(F.col(high), F.col("cell_size"))
                )
            ),
        )
    return sized.drop("cell_size")


def points_in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes joined with the points inside them, borders included.

    `points` needs latitude and longitude, `boxes` min_lat, min_lon, max_lat, max_lon.
    """
    located = cell_keys(
        points.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    )
    cell = ["cell_level", "cell_y", "cell_x"]
    return (
        spread_join(box_cells(boxes), located, cell, boxes.columns)
        .filter(
            F.col("latitude").between(F.col("min_lat"), F.col("max_lat"))
            & F.col("longitude").between(F.col("min_lon"), F.col("max_lon"))
        )
        .drop("cell_level", "cell_y", "cell_x")
    )
