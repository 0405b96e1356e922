"""Joins and ordered scans that hold up when one key owns a large share of all rows.

Five tools, used wherever a group has no upper bound:

* ``attach``        join a per-group summary back to its rows: broadcast when its counted size is
                    small, otherwise replicate the summary over salts so a hot group's rows spread
* ``attach_counted`` the same where the summary is long and knows its keys' sizes: only hot keys are repeated
* ``shuffled``      a table of any length for a join that must not collect it on the driver
* ``carry_forward`` an ordered running computation per group, done block by block
* ``with_position`` a row's place in its group's order, without sorting the group in one task
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listinglake.session import durable

# What one broadcast may hold; both are checked, since rows can be of any width.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
SALTS = 16
# A key is heavy if it holds at least one row in so many.
HEAVY = 1000
# Rows of one group that a single window task handles.
BLOCK_ROWS = 100_000


def attach(
    rows: DataFrame,
    summary: DataFrame,
    on: Sequence[str],
    how: str = "left",
    salts: int = SALTS,
    broadcast_rows: int = BROADCAST_ROWS,
    summary_rows: int | None = None,
    size: str | None = None,
    stored: bool = False,
) -> DataFrame:
    """Join ``rows`` with ``summary``, which holds at most one row per key.

    ``summary`` must be a durable table, so counting it reads file footers only; a caller that
    knows an upper bound of its rows passes it instead. Where ``summary`` counts each key's rows in
    ``size``, or ``rows`` are ``stored``, so that their keys can be counted, a long one is repeated for hot keys only.
    """
    on = list(on)
    count = summary.count() if summary_rows is None else summary_rows
    if count <= broadcast_rows and _bytes_of(summary) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(summary), on, how)
    if size is not None:
        return attach_counted(rows, summary, on, size, how, salts)
    if stored:
        total = rows.count()
        hot = durable(rows.groupBy(*on).count().where(F.col("count") * HEAVY >= F.lit(total)).select(*on))
        marked = summary.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
        return _hot_repeated(rows, marked, hot, F.col("_hot"), on, how, salts).drop("_hot")
    return salted_join(rows, summary, on, how, salts)


def shuffled(table: DataFrame) -> DataFrame:
    """``table`` as a side of a join that shuffles and merges, however small the planner takes it to be.

    The planner goes by the size of compressed files and does not count what ``explode`` adds, so that a table
    of any length may pass for a small one, be collected on the driver and broadcast.
    """
    return table.hint("merge")


def _bytes_of(summary: DataFrame) -> int:
    """The table's size as text; only asked of tables known to have few rows."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in summary.columns])))
    return summary.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def salted_join(
    rows: DataFrame, summary: DataFrame, on: Sequence[str], how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Join with every key split over ``salts`` partitions; ``summary`` is repeated once per salt.

    The salt comes from the row itself, so a task that is run again puts each row where it was.
    """
    hashed = [F.col(c) for c, kind in rows.dtypes if "map<" not in kind]  # maps have no hash
    spread = F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int")
    left = rows.withColumn("_salt", spread)
    right = summary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(shuffled(right), [*on, "_salt"], how).drop("_salt")


def attach_counted(
    rows: DataFrame, summary: DataFrame, on: Sequence[str], size: str, how: str = "left", salts: int = SALTS
) -> DataFrame:
    """``attach`` where ``summary``, a durable table of any length, counts each key's rows in ``size``.

    Only keys with a thousandth of all rows or more are spread over salts; there are at most a thousand
    of those, and they alone are repeated. All others are joined as they are.
    """
    on = list(on)
    total = summary.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    is_heavy = F.col(size) * HEAVY >= F.lit(total)
    return _hot_repeated(rows, summary, summary.where(is_heavy).select(*on), is_heavy, on, how, salts)


def _hot_repeated(
    rows: DataFrame, summary: DataFrame, hot: DataFrame, is_hot: Column, on: list[str], how: str, salts: int
) -> DataFrame:
    """Join with the keys of ``hot``, a short table, spread over salts; ``is_hot`` tells them in ``summary``."""
    heavy = hot.withColumn("_heavy", F.lit(True))
    hashed = [F.col(c) for c, kind in rows.dtypes if "map<" not in kind]  # maps have no hash
    spread = F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int")
    left = rows.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.when(F.col("_heavy"), spread).otherwise(0))
    lots = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = shuffled(summary.withColumn("_salt", F.explode(lots)))
    return left.join(right, [*on, "_salt"], how).drop("_salt", "_heavy")


def carry_forward(
    rows: DataFrame,
    group: Sequence[str],
    position: str,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, list[str]]:
    """Cut each group into runs of consecutive positions small enough for one window task.

    Returns the rows with a ``_block`` number and the keys that a block-level window partitions by.
    Callers fold each block, scan the folds (``block_rows`` times fewer rows) and join them back.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(position) / F.lit(block_rows)).cast("long"))
    return blocked, [*group, "_block"]


def with_position(
    rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "position"
) -> DataFrame:
    """Number the rows of each group from 1 in ``order``, which must be a total order.

    A global range sort spreads even a single huge group over tasks. The sorted rows are written
    once, so the partition each row was sorted into is fixed; counts per (partition, group) give
    every partition its starting number.
    """
    group = list(group)
    ordered = durable(
        rows.orderBy(*[F.col(c) for c in group], *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )
    pieces = ordered.groupBy(*group, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")
    )
    # one row per (group, partition it touches): bounded by groups plus partitions
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(
        pieces.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    return (
        attach(ordered, offsets, [*group, "_part"], "inner")
        .withColumn(name, F.col("_offset") + F.col("_at") - F.col("_first") + 1)
        .drop("_at", "_part", "_first", "_offset")
    )
