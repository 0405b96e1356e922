"""Counts the runs report. All are conditional counts in one pass over their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglake.functions.text import is_blank
from listinglake.model import KEY, METAL, OTHER, PENDING
from listinglake.venues import with_venue_name


def status_breakdown(gigs: DataFrame, today: Column) -> DataFrame:
    """Metal, Other and Pending over all gigs (``gigs`` carries ``status``) and over those to come."""
    counts = gigs.groupBy((F.col("date") >= today).alias("ahead")).agg(
        F.count(F.lit(1)).alias("gigs"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in (METAL, OTHER, PENDING)]
    )
    # two rows at most from here on
    scoped = counts.withColumn(
        "scope", F.explode(F.when(F.col("ahead"), F.array(F.lit("overall"), F.lit("upcoming"))).otherwise(F.array(F.lit("overall"))))
    )
    return scoped.groupBy("scope").agg(*[F.sum(c).alias(c) for c in ("gigs", "metal", "other", "pending")])


def pending_by_venue(gigs: DataFrame, today: Column) -> DataFrame:
    """Upcoming gigs without a verdict per venue name, most first."""
    waiting = gigs.where((F.col("date") >= today) & (F.col("status") == PENDING))
    counted = waiting.groupBy("venue_id").agg(F.count(F.lit(1)).alias("n"))
    return with_venue_name(counted).groupBy("venue").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "venue")


def classify_summary(outcome: DataFrame, metal: DataFrame) -> DataFrame:
    """One run's verdicts, how many of those gigs are now Metal, and how many failed."""
    now_metal = outcome.where(F.col("error").isNull()).join(metal.select(*KEY), KEY, "left_semi")
    runs = outcome.agg(
        F.count_if(F.col("error").isNull()).alias("classified"), F.lit(0).cast("bigint").alias("metal"), F.count_if(F.col("error").isNotNull()).alias("failed")
    )
    none = F.lit(0).cast("bigint")
    held = now_metal.agg(none.alias("classified"), F.count(F.lit(1)).alias("metal"), none.alias("failed"))
    # two rows from here on
    return runs.unionByName(held).agg(*[F.sum(c).alias(c) for c in ("classified", "metal", "failed")]).select(
        "classified", "metal", (F.col("classified") - F.col("metal")).alias("other"), "failed"
    )


def scrape_summary(scraped: DataFrame, to_observe: DataFrame, observed: DataFrame) -> DataFrame:
    """One scrape's rows: all, logged, withheld, and logged without any text."""
    names = ("scraped", "changed", "logged", "without_text")
    count = F.count(F.lit(1))

    def counted(rows: DataFrame, **counts: Column) -> DataFrame:
        return rows.agg(*[counts.get(n, F.lit(0).cast("bigint")).alias(n) for n in names])

    # three rows from here on
    parts = counted(scraped, scraped=count).unionByName(counted(to_observe, changed=count)).unionByName(
        counted(observed, logged=count, without_text=F.count_if(is_blank(F.col("description"))))
    )
    return parts.agg(*[F.sum(n).alias(n) for n in names]).select(
        "scraped", "logged", (F.col("changed") - F.col("logged")).alias("withheld"), "without_text"
    )


def unresolved(gigs: DataFrame) -> DataFrame:
    """Gigs on the page without a verdict, soonest first. Any blocks publishing unless forced."""
    return gigs.where(F.col("status") == PENDING).orderBy("date", "first_seq")
