"""Sequence numbers for a batch of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listinglake.session import durable
from listinglake.skew import attach, carry_forward

# Entries that one window task numbers; a batch of 10^12 leaves a million blocks to add up.
BLOCK_ROWS = 1_000_000


def assign_sequence(
    batch: DataFrame, position: str, last_seq: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Fill ``seq`` in ``position`` order: a null continues from the entry before, a number stays.

    ``in_order`` is false where a number that was brought along does not exceed the one before it.
    ``position`` is a distinct whole number per entry. Blocks of positions are numbered in
    parallel; what a block needs from those before it is the last number brought along and how
    many entries were counted since, one row per block.
    """
    blocked, keys = carry_forward(batch, [], position, block_rows)
    before = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    # the running count has to exist before it can be captured at each brought-along number
    upto = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    counted = blocked.withColumn("_unnumbered", F.sum(F.col("seq").isNull().cast("bigint")).over(upto))
    captured = F.when(F.col("seq").isNotNull(), F.struct(F.col("seq").alias("s"), F.col("_unnumbered").alias("u")))
    local = counted.select(
        "*",
        F.last(captured, ignorenulls=True).over(before).alias("_base"),
        (F.col("_unnumbered") - F.col("seq").isNull().cast("bigint")).alias("_before"),
    )
    folds = counted.groupBy("_block").agg(
        F.max("_unnumbered").alias("n"),
        F.max(F.when(F.col("seq").isNotNull(), F.struct(F.col(position), F.col("seq").alias("s"), F.col("_unnumbered").alias("u")))).alias("base"),
    )
    # one row per block, a million times fewer than entries
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    running = folds.withColumn("_total", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    carried = F.when(
        F.col("base").isNotNull(),
        F.struct(F.col("base.s").alias("s"), (F.col("_total") + F.col("base.u")).alias("u")),
    )
    carry = durable(
        running.select(
            "_block", "_total", F.last(carried, ignorenulls=True).over(earlier).alias("_carried")
        )
    )
    joined = attach(local, carry, ["_block"], "inner")
    seen = F.col("_total") + F.col("_before")
    previous = (
        F.when(F.col("_base").isNotNull(), F.col("_base.s") + F.col("_before") - F.col("_base.u"))
        .when(F.col("_carried").isNotNull(), F.col("_carried.s") + seen - F.col("_carried.u"))
        .otherwise(F.lit(last_seq) + seen)
    )
    return (
        joined.withColumn("_previous", previous)
        .withColumn("in_order", F.col("seq").isNull() | (F.col("seq") > F.col("_previous")))
        .withColumn("seq", F.coalesce("seq", F.col("_previous") + 1))
        .select(*batch.columns, "in_order")
    )
