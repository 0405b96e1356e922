"""Rewriting the log without what no projection reads, and proving nothing changed."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglake.model import CLASSIFIED, GIG_FIELDS, KEY, LOG_COLUMNS, OBSERVED, USER
from listinglake.operators import projections as p
from listinglake.session import durable, side_by_side


def compact(log: DataFrame) -> DataFrame:
    """The newest observation and the effective verdict of each key, and all other entries.

    Both kinds reduce in one aggregation: entries group by kind and key, a user verdict outranks
    any model verdict, and ``seq`` decides the rest. Numbers are kept, so gaps show what went.
    """
    reduced = F.col("_type").isin(OBSERVED, CLASSIFIED)
    rest = [c for c in LOG_COLUMNS if c not in ("_type", *KEY)]
    rank = F.struct(F.coalesce(F.col("source") == USER, F.lit(False)).alias("by_user"), F.col("seq"))
    newest = (
        log.where(reduced).groupBy("_type", *KEY).agg(F.max_by(F.struct(*rest), rank).alias("e"))
        .select("_type", *KEY, "e.*")
    )
    return newest.select(*LOG_COLUMNS).unionByName(log.where(~reduced).select(*LOG_COLUMNS))


def compact_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Entries per kind before and after, and how many were dropped."""
    counts = lambda df, name: df.groupBy("_type").agg(F.count(F.lit(1)).alias(name))
    # one row per kind on either side
    return (
        counts(before, "before").join(counts(after, "after"), "_type", "full")
        .select("_type", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
        .withColumn("dropped", F.col("before") - F.col("after"))
    )


# What must read the same from both logs: projection, columns compared.
PROJECTIONS = {
    "current_gigs": [*KEY, *GIG_FIELDS],
    "class_status": [*KEY, "genre"],
    "metal_gigs": [*KEY, *GIG_FIELDS],
    "already_classified": KEY,
    "last_scraped": ["venue_id", "last_scraped"],
}


def projections_of(log: DataFrame) -> dict[str, DataFrame]:
    """Every compared projection; the walk along replacements is made once for all that need it.

    Descriptions are compared by their SHA-256, so the comparison shuffles no texts. A key has a
    verdict exactly when it was classified or inherits, so the classified keys are the status keys.
    """
    current = p.current_gigs(log).withColumn("description", F.sha2("description", 256))
    status = durable(p.class_status(log))
    return {
        "current_gigs": current,
        "class_status": status,
        "metal_gigs": p.metal_of(current, status),
        "already_classified": status.select(*KEY),
        "last_scraped": p.last_scraped(log),
    }


def differences(one: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Rows found more often on one side than the other, in a single shuffle: ``only_in``, ``n``."""
    both = one.select(*columns, F.lit(1).alias("_side")).unionByName(other.select(*columns, F.lit(-1).alias("_side")))
    return (
        both.groupBy(*columns).agg(F.sum("_side").alias("n")).where(F.col("n") != 0)
        .withColumn("only_in", F.when(F.col("n") > 0, "one").otherwise("other"))
        .withColumn("n", F.abs("n"))
    )


def compact_verify(log: DataFrame, compacted: DataFrame) -> DataFrame:
    """Per projection, how many rows only the log and only the compacted log yield."""
    one, other = side_by_side([partial(projections_of, log), partial(projections_of, compacted)])
    out = None
    for name, columns in PROJECTIONS.items():
        diff = differences(one[name], other[name], columns)
        row = diff.agg(
            F.coalesce(F.sum(F.when(F.col("only_in") == "one", F.col("n"))), F.lit(0)).alias("missing"),
            F.coalesce(F.sum(F.when(F.col("only_in") == "other", F.col("n"))), F.lit(0)).alias("extra"),
        ).select(F.lit(name).alias("projection"), "missing", "extra")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("equal", (F.col("missing") == 0) & (F.col("extra") == 0))


def compacted_log(log: DataFrame) -> DataFrame:
    """``compact`` written aside and read back, so the proof covers what was stored."""
    return durable(compact(log).repartitionByRange("seq").sortWithinPartitions("seq"))

