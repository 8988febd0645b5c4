"""Joins whose answer is far larger than both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the answer that one task gives, about.
TASK_ROWS = 1 << 22
#: An answer of more tasks than this has larger ones instead.
MOST_TASKS = 20_000
#: The same where rows are only handed on: a task holds no more for more rows, and each one costs a copy of its items.
MOST_PASSING_TASKS = 2_000


def spread_join(
    asked: DataFrame,
    items: DataFrame,
    keys: Sequence[str],
    ask: Sequence[str],
    weight: Column | None = None,
    how: str = "inner",
    sizes: DataFrame | None = None,
    task_rows: int | None = None,
    keep_slot: bool = False,
    deal: str | None = None,
    most_tasks: int | None = None,
) -> DataFrame:
    """asked joined with items(*keys, …), with tasks cut by what they give, not by what they read.

    Both sides of such a join are small, so Spark would put them into a few tasks, and one key may hold a third of
    the rows. The rows that ask for a busy key are dealt over slots by `ask`, its items are repeated for each slot, and
    the number of partitions follows the answer. `weight` is how many rows an item stands for. Only busy keys
    are broadcast, fewer than there are tasks.

    Repeating all items of a key for each of its slots would cost more than the input as answers grow with its square. With
    `deal`, a column that numbers the items of a key, they are dealt over pieces too, and what asks is repeated for each
    piece instead, so that both sides are repeated about as much. This is for inner joins without `keep_slot`.

    sizes(*keys, n_rows double) are counted here unless they are given. With `keep_slot` the answer has its `slot`: all
    rows of one (*keys, *ask) share it, and rows lie by (*keys, slot).
    """
    keys, task_rows = list(keys), TASK_ROWS if task_rows is None else task_rows
    dealt_items = deal is not None and how == "inner" and not keep_slot and sizes is None
    if sizes is None:
        stands_for = items.groupBy(*keys).agg(
            F.sum(F.lit(1) if weight is None else weight).alias("n_items"), F.count(F.lit(1)).alias("n_parts")
        )
        sizes = (
            asked.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_asked"))
            .join(stands_for, keys, how)
            .withColumn("n_rows", (F.col("n_asked") * F.coalesce("n_items", F.lit(1))).cast("double"))
        )
    total = sizes.agg(F.sum("n_rows")).first()[0] or 0.0
    if total <= task_rows:
        # Sizes are guessed from compressed files and know nothing of exploded rows, so nothing is left to a broadcast.
        joined = asked.join(items.hint("merge"), keys, how)
        return joined.withColumn("slot", F.lit(0)) if keep_slot else joined
    task_rows = max(task_rows, int(total / (MOST_TASKS if most_tasks is None else most_tasks)))
    n_tasks = int(total // task_rows) + 1
    n_own, pieces = F.ceil(F.col("n_rows") / task_rows), F.lit(1)
    if dealt_items:
        even = F.floor(F.sqrt(n_own * F.col("n_items") / F.col("n_asked")))
        pieces = F.greatest(F.lit(1), F.least(even, F.col("n_parts")))
    busy = F.broadcast(
        sizes.filter(F.col("n_rows") > task_rows)
        .dropna(subset=keys)
        .withColumn("pieces", pieces.cast("int"))
        .select(*keys, F.ceil(n_own / F.col("pieces")).cast("int").alias("slots"), "pieces")
    )
    no_key = F.greatest(*(F.col(key).isNull().cast("int") for key in (*keys, keys[0]))) == 1
    slots = F.when(no_key, F.lit(n_tasks)).otherwise(F.coalesce("slots", F.lit(1)))
    dealt = asked.join(busy, keys, "left").withColumn("slot", F.pmod(F.xxhash64(*ask), slots).cast("int"))
    repeated = items.join(busy, keys, "left").withColumn("slot", F.explode(_upto("slots")))
    place = [*keys, "slot"]
    if dealt_items:
        dealt = dealt.withColumn("piece", F.explode(_upto("pieces")))
        own_piece = F.pmod(F.col(deal), F.coalesce("pieces", F.lit(1))).cast("int")
        repeated = repeated.withColumn("piece", F.coalesce(own_piece, F.lit(0)))
        place.append("piece")
    left, right = (side.drop("slots", "pieces").repartition(n_tasks, *place) for side in (dealt, repeated))
    joined = left.join(right.hint("merge"), place, how).drop("piece")
    return joined if keep_slot else joined.drop("slot")


def _upto(name: str) -> Column:
    """0 and on, as many numbers as the column says, one if it is null."""
    return F.sequence(F.lit(0), F.coalesce(name, F.lit(1)) - 1)
