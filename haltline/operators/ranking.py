"""Top-k per request and ranks inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haltline.session import cut_lineage, keep_table

#: A list of more rows is ranked in pieces of so many.
LIST_ROWS = 1 << 20

DEFAULT_LIMIT = 20
DEFAULT_RECT_LIMIT = 10_000


def with_limits(requests: DataFrame, default: int = DEFAULT_LIMIT) -> tuple[DataFrame, int]:
    """Requests with the default where `limit` is missing, and the largest limit among them.

    A limit is what the request asks for; there is no upper end. The largest one is a literal for
    plans that cut groups before a shuffle, from one small aggregate over the requests.
    """
    asked = requests.withColumn("limit", F.coalesce("limit", F.lit(default)))
    return asked, asked.agg(F.coalesce(F.max("limit"), F.lit(1))).first()[0]


def first_per_group(
    rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], cap: int
) -> DataFrame:
    """The first `cap` rows of every group with their `rank`.

    The bound is a literal, so up to `spark.sql.optimizer.windowGroupLimitThreshold` Spark also
    cuts every group inside each map task before the shuffle; a group holding a third of the
    rows then sends at most `cap` rows per task.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= cap)


def ids_repeat(requests: DataFrame) -> bool:
    """Whether several requests share an id, or lack one. Only ids are shuffled."""
    n, n_ids = requests.agg(F.count(F.lit(1)), F.count_distinct("request_id")).first()
    return n != n_ids


def top_per_request(rows: DataFrame, order: Sequence[Column | str], largest: int, *place: str) -> DataFrame:
    """Rows of each request up to its own `limit`; `largest` is the largest of them.

    Where no id repeats, rows that lie by `place`, columns of the request, are cut without a shuffle.
    """
    return first_per_group(rows, [*place, "request_id"], order, largest).filter(
        F.col("rank") <= F.col("limit")
    )


def bucket_offsets(rows: DataFrame, group: Sequence[str], bucket: str, weight: Column) -> DataFrame:
    """Per group and bucket: how much weight lies in the buckets before it.

    Buckets are counted before any shuffle; the running sum only sees one row per bucket.
    """
    before = (
        Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.groupBy(*group, bucket)
        .agg(F.sum(weight).alias("bucket_weight"))
        .withColumn("offset", F.coalesce(F.sum("bucket_weight").over(before), F.lit(0)))
        .drop("bucket_weight")
    )


def rank_by_bucket(
    rows: DataFrame,
    group: Sequence[str],
    bucket: str,
    order: Sequence[Column | str],
    weight: Column | None = None,
) -> DataFrame:
    """`rank` inside `group` in the order (bucket, order): the running sum of `weight`.

    Without a weight this is the row number. `bucket` must rise with the wanted order. Only one
    bucket of a group is ever sorted in one place, so a huge group spreads over its buckets.
    """
    weight = F.lit(1) if weight is None else weight
    offsets = bucket_offsets(rows, group, bucket, weight)
    local = (
        Window.partitionBy(*group, bucket)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("rank", F.sum(weight).over(local))
        .join(offsets, [*group, bucket])
        .withColumn("rank", F.col("rank") + F.col("offset"))
        .drop("offset")
    )


def rank_by_range(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    weight: Column | None = None,
) -> DataFrame:
    """As `rank_by_bucket` for keys without a numeric bucket: the bucket is a key range.

    Ranges are chosen by Spark's range partitioner over (group, order), which also splits a
    huge group. The assignment is written once, so ranks and offsets agree after a task is lost.
    """
    ranged = cut_lineage(
        rows.repartitionByRange(*group, *order).withColumn("bucket", F.spark_partition_id())
    )
    return rank_by_bucket(ranged, group, "bucket", order, weight).drop("bucket")


#: A group of up to so many rows, or so many times its limit, is cheaper to look through than to merge.
QUIET_ROWS, QUIET_TIMES = 64, 4


def by_crowd(asked: DataFrame, rows: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """asked(group, limit, …) whose group has few rows, with `n_rows`, and those whose group has many."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    sized = keep_table(asked.join(sizes, group))
    quiet = F.col("n_rows") <= F.greatest(F.lit(QUIET_ROWS), QUIET_TIMES * F.col("limit"))
    return sized.filter(quiet), sized.filter(~quiet).drop("n_rows")


def ranked_lists(
    rows: DataFrame,
    lists: Sequence[str],
    key: str,
    order: Sequence[str],
    largest: int,
    marks: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows with their `rank` in each list and `ahead`, and marks with `before`. Both are written once.

    A list is ordered by (key, order). `ahead` holds the keys of the first, second, fourth, eighth … row from
    this one on, null behind the end; steps beyond `largest` rows are left out. marks(*lists, key) stand before
    the rows of the same key, `before` is how many rows of their list they have before them.

    Usually one shuffle does it all. Where a list exceeds `LIST_ROWS` rows, ranks come from key ranges and
    `ahead` from pieces that know the first rows of the next one, so no task sorts the whole list.
    """
    steps = [1 << step for step in range(max(largest, 1).bit_length())]
    everything = rows.withColumn("weight", F.lit(1))
    biggest = rows.groupBy(*lists).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    if marks is not None:
        marks = marks.select(*lists, key).distinct().withColumn("weight", F.lit(0))
        everything = everything.unionByName(marks, allowMissingColumns=True)
    sort = [F.col(key), F.col("weight"), *map(F.col, order)]
    if biggest <= LIST_ROWS:
        one_list = Window.partitionBy(*lists)
        so_far = one_list.orderBy(*sort).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = everything.withColumn("rank", F.sum("weight").over(so_far).cast("long"))
        # Marks last, so that they are not among the rows ahead.
        onward = one_list.orderBy(F.desc("weight"), *sort)
        keys = F.when(F.col("weight") == 1, F.col(key))
        found = found.withColumn("ahead", F.array(*(F.lead(keys, step - 1).over(onward) for step in steps)))
        found = keep_table(found)
    else:
        ranked = rank_by_range(everything, lists, sort, F.col("weight"))
        found = keep_table(ranked.withColumn("rank", F.col("rank").cast("long")))
        size = max(LIST_ROWS, largest)
        piece = F.floor((F.col("rank") - 1) / size)
        near = ((F.col("rank") - 1) % size < largest) & (piece > 0)
        pieces = found.filter("weight = 1").withColumn("own", piece)
        pieces = pieces.withColumn(
            "piece", F.explode(F.when(near, F.array(piece, piece - 1)).otherwise(F.array(piece)))
        )
        onward = Window.partitionBy(*lists, "piece").orderBy("rank")
        ahead = F.array(*(F.lead(key, step - 1).over(onward) for step in steps))
        pieces = pieces.withColumn("ahead", ahead).filter(F.col("piece") == F.col("own")).drop("piece", "own")
        found = keep_table(pieces.unionByName(found.filter("weight = 0"), allowMissingColumns=True))
    before = found.filter("weight = 0").select(*lists, key, F.col("rank").alias("before"))
    return found.filter("weight = 1").drop("weight"), before


def merge_lists(
    ranked: DataFrame, asked: DataFrame, lists: Sequence[str], key: str, ask: Sequence[str]
) -> DataFrame:
    """For asked(*ask, *lists, before, limit, …): rows of the lists behind `before` that hold the first `limit`.

    All lists of one question together give at most three times its limit and the rows that share the last
    key, however many lists there are: a list is read up to where the question's lists together surely have
    `limit` rows, in steps of 1, 2, 4, 8 … rows known from `ahead`. The caller cuts the rest.
    """
    place = asked.withColumn("rank", F.col("before") + 1)
    starts = place.join(ranked.select(*lists, "rank", "ahead"), [*lists, "rank"]).drop("rank")
    doubled = lambda step: F.call_function("shiftleft", F.lit(1), step)
    gained = F.when(F.col("step") == 0, 1).otherwise(doubled(F.col("step") - 1))
    probes = (
        starts.select(*ask, "limit", F.posexplode("ahead").alias("step", "reached"))
        .filter(F.col("reached").isNotNull())
        .select(*ask, "limit", "reached", gained.alias("gained"))
        .groupBy(*ask, "limit", "reached")
        .agg(F.sum("gained").alias("gained"))
    )
    upto = Window.partitionBy(*ask).orderBy("reached").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = (
        probes.withColumn("surely", F.sum("gained").over(upto))
        .filter(F.col("surely") >= F.col("limit"))
        .groupBy(*ask)
        .agg(F.min("reached").alias("bound"))
    )
    inside = F.filter("ahead", lambda one: one.isNotNull() & (F.col("bound").isNull() | (one <= F.col("bound"))))
    wanted = (
        starts.join(bounds, list(ask), "left")
        .withColumn("steps", F.size(inside))
        .filter(F.col("steps") > 0)
        .withColumn("n", F.least(doubled(F.col("steps")) - 1, F.col("limit")))
        .withColumn("rank", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))))
        .drop("ahead", "bound", "steps", "n", "before")
    )
    return wanted.join(ranked.drop("ahead"), [*lists, "rank"]).drop("rank")
