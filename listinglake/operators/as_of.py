"""The last row known at a moment, from a table of any size.

Both sides go through one range sort by key, time and side, so a key that owns most rows is cut by
time and spread over tasks, and nothing is broadcast. Each task carries the last known row along; what
it needs from the tasks before it is one row per task and key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listinglake.session import durable
from listinglake.skew import attach

_OWN = ("_key", "_time", "_known", "_row", "_said", "_at", "_part", "_last", "_carried")


def last_known(
    rows: DataFrame, known: DataFrame, on: Sequence[tuple[str, str]], time: str, since: str, take: Sequence[str],
    before: bool = False,
) -> DataFrame:
    """``rows`` with the columns ``take`` of the ``known`` row with the largest ``since`` up to ``time``.

    ``on`` pairs columns of ``rows`` with those of ``known``. ``since`` equal to ``time`` counts, unless
    ``before``. Of several known rows of one key and moment the largest in ``take`` is used, nulls being
    smallest. Nothing known by then, a null in a key or a null time gives nulls; known rows with a
    null key or moment say nothing. Rows stay as often as they are there. ``time`` and ``since`` need
    types that one order fits.
    """
    clash = {c.lower() for c in rows.columns} & {c.lower() for c in (*take, *_OWN)}
    if clash:
        raise ValueError(f"rows already have columns {sorted(clash)}")
    keyed = [F.col(k) for _, k in on]
    clean = known.where(F.col(since).isNotNull())
    for column in keyed:
        clean = clean.where(column.isNotNull())
    # equal moments of a key are folded before the sort: one row each
    once = clean.groupBy(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(keyed)]).alias("_key"), F.col(since).alias("_time")).agg(
        F.max(F.struct(*[F.col(c) for c in take])).alias("_known")
    )
    asked = rows.select(
        F.struct(*[F.col(r).alias(f"k{i}") for i, (r, _) in enumerate(on)]).alias("_key"), F.col(time).alias("_time"),
        F.struct(*[F.col(c) for c in rows.columns]).alias("_row"),
        F.xxhash64(*[F.col(c) for c, kind in rows.dtypes if "map<" not in kind]).alias("_said"),  # maps have no hash
    )
    both = once.unionByName(asked, allowMissingColumns=True)
    # what is known comes first within its moment, or last if it counts only afterwards; the hash
    # lets the sort cut a moment that very many rows share
    side = F.col("_row").isNull() if before else F.col("_row").isNotNull()
    ordered = durable(
        both.orderBy(*[F.col(f"_key.k{i}") for i in range(len(on))], "_time", side, "_said")
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )
    folds = ordered.where(F.col("_known").isNotNull()).groupBy("_key", "_part").agg(F.max_by("_known", "_at").alias("_last"))
    # every part a key touches, with the last row known before it: keys plus parts, whatever the rows
    touched = ordered.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = durable(
        touched.join(folds, ["_key", "_part"], "left")
        .select("_key", "_part", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
        .where(F.col("_carried").isNotNull())
    )
    upto = Window.partitionBy("_key", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ordered.withColumn("_last", F.last("_known", ignorenulls=True).over(upto)).where(F.col("_row").isNotNull())
    answered = attach(local, carry, ["_key", "_part"]).withColumn("_last", F.coalesce("_last", "_carried"))
    told = F.when(F.col("_time").isNotNull(), F.col("_last"))
    return answered.select("_row.*", *[told[c].alias(c) for c in take])
