"""Checks of rows against each other.

Each groups the narrow facts on the key concerned, keeps the few groups over the limit, and
attaches those to the rows. Counts combine before the shuffle, and attaching broadcasts or salts,
so one venue, picture or text holding a large share of all rows stays spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglake.operators.quality.batch import CLAIM, Batch
from listinglake.session import durable
from listinglake.skew import attach

# The words of all reports below; the most rows a venue may show on one day, and under one picture.
MAX_ON_A_DAY, MAX_SHARING_A_POSTER = 5, 20


def empty(batch: Batch) -> DataFrame:
    """Venues that were asked and listed nothing; told apart by what the log holds for them."""
    listed = batch.facts.select("venue_id").distinct()
    held = batch.previous.groupBy("venue_id").agg(F.count(F.lit(1)).alias("held"))
    silent = batch.scraped_venues.select("venue_id").distinct().join(listed, "venue_id", "left_anti")
    return silent.join(held, "venue_id", "left").select(
        "venue_id",
        F.lit("empty").alias("problem"),
        F.when(F.col("held").isNull(), "listed nothing, and the log holds no gigs for it either")
        .otherwise(F.concat(F.lit("listed nothing, though the log holds "), F.col("held").cast("string"), F.lit(" gig(s) for it")))
        .alias("detail"),
        F.lit(None).cast("string").alias("gig"),
        F.lit(None).cast("bigint").alias("listing_pos"),
        F.lit(None).cast("string").alias("url"),
    )


def _claims(batch: Batch, groups: DataFrame, keys: list[str], detail: Column, problem: Column) -> DataFrame:
    flagged = durable(groups.select(*keys, "n", problem.alias("problem"), detail.alias("detail")))
    return attach(batch.facts.select("*"), flagged, keys, "inner", size="n").select(*CLAIM)


def duplicate(batch: Batch) -> DataFrame:
    """One key listed more than once; whether the copies agree is part of the report."""
    keys = ["venue_id", "url"]
    groups = (
        batch.facts.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.min("gig").alias("a"), F.max("gig").alias("b"))
        .where(F.col("n") > 1)
    )
    times = F.concat(F.lit("listed "), F.col("n").cast("string"), F.lit(" times"))
    detail = F.when(F.col("a") == F.col("b"), times).otherwise(F.concat(times, F.lit(", and not identically")))
    return _claims(batch, groups, keys, detail, F.col("url"))


def crowded(batch: Batch) -> DataFrame:
    """More rows on one day than a venue could run."""
    keys = ["venue_id", "date"]
    groups = batch.facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_ON_A_DAY)
    day = F.col("date").cast("string")
    return _claims(batch, groups, keys, F.concat(F.col("n").cast("string"), F.lit(" gig(s) on "), day), day)


def shared_poster(batch: Batch) -> DataFrame:
    """More rows under one picture than any run of dates explains."""
    keys = ["venue_id", "poster_url"]
    groups = batch.facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_SHARING_A_POSTER)
    return _claims(
        batch, groups, keys,
        F.concat(F.col("n").cast("string"), F.lit(" gig(s) share "), poster_file(F.col("poster_url"))),
        F.col("poster_url"),
    )


def poster_file(poster_url: Column) -> Column:
    return F.substring_index(F.substring_index(poster_url, "?", 1), "/", -1)


def shared_description(batch: Batch) -> DataFrame:
    """One text on several rows whose titles have no word in common.

    A word common to all titles of a group is one counted as often as the group has rows; words
    are counted per (group, word), so no group is gathered anywhere.
    """
    keys = ["venue_id", "copy"]
    rows = batch.facts.where(~F.col("blank"))
    groups = durable(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("quoted").alias("quoted")).where(F.col("n") > 1)
    )
    worded = attach(rows.select(*keys, "title_words"), groups.select(*keys, "n"), keys, "inner", size="n")
    common = (
        worded.select(*keys, "n", F.explode("title_words").alias("word"))
        .groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"))
        .where(F.col("rows") == F.col("n")).select(*keys).distinct()
    )
    flagged = groups.join(common, keys, "left_anti")
    return _claims(batch, flagged, keys, F.col("quoted"), F.col("copy"))
