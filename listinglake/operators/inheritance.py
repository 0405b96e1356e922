"""Which key each replacing key takes its answer from."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglake.model import KEY
from listinglake.session import durable
from listinglake.skew import attach, shuffled

_FROM = ["from_venue_id", "from_url"]


def inherited_from(replacements: DataFrame, known: DataFrame) -> DataFrame:
    """Walk each replacing key outside ``known`` back to the first member of ``known``.

    ``replacements`` holds ``venue_id, url`` (the old key), ``by_venue_id, by_url`` and ``seq``;
    where a key replaced several, the newest counts. Columns of the result: the key and
    ``from_venue_id, from_url``. Keys whose walk meets no known key are left out.

    Pointers are doubled, so a chain of length n takes about log2 n rounds, and a round that
    exceeds that bound can only hold cycles, which never answer.
    """
    edges = (
        replacements.groupBy(F.col("by_venue_id"), F.col("by_url"))
        .agg(F.max_by(F.struct(*KEY), "seq").alias("old"))
        .select(F.col("by_venue_id").alias("venue_id"), F.col("by_url").alias("url"),
                F.col("old.venue_id").alias("from_venue_id"), F.col("old.url").alias("from_url"))
    )
    answers = known.select(F.col("venue_id").alias("from_venue_id"), F.col("url").alias("from_url"), F.lit(True).alias("hit"))
    walk = durable(
        edges.join(shuffled(known.select(*KEY)), KEY, "left_anti").join(shuffled(answers), _FROM, "left")
        .select(*KEY, *_FROM, F.coalesce("hit", F.lit(False)).alias("hit"))
    )
    found = [walk.where("hit").select(*KEY, *_FROM)]
    size, waiting = walk.agg(F.count(F.lit(1)), F.count_if(~F.col("hit"))).first()
    for _ in range(math.ceil(math.log2(max(size, 2))) + 1):
        if not waiting:
            break
        # a pointer at a key that is not walking has nothing further to ask
        step = walk.select(
            F.col("venue_id").alias("from_venue_id"), F.col("url").alias("from_url"),
            F.col("from_venue_id").alias("_v"), F.col("from_url").alias("_u"), "hit",
        )
        moved = durable(
            attach(walk.where(~F.col("hit")).drop("hit"), step, _FROM, "inner", summary_rows=size, stored=True)
            .select(*KEY, F.col("_v").alias("from_venue_id"), F.col("_u").alias("from_url"), "hit")
        )
        found.append(moved.where("hit").select(*KEY, *_FROM))
        walk = walk.where("hit").unionByName(moved)
        waiting = moved.agg(F.count_if(~F.col("hit"))).first()[0]
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result
