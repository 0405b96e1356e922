"""Running checks in order, reporting each gig once, and withholding failed venues."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listinglake.operators.quality import contamination, group_checks, text_checks
from listinglake.operators.quality.batch import CLAIM, Batch, Check
from listinglake.session import durable, side_by_side
from listinglake.skew import attach

# In the order in which checks speak for a gig.
CHECKS = [
    Check(1, "empty", "Venues that listed nothing", group_checks.empty),
    Check(2, "misshapen", "Gigs that look wrongly parsed", text_checks.misshapen),
    Check(3, "unparsed", "Gigs with unparsed text", text_checks.unparsed),
    Check(4, "duplicate", "Gigs listed more than once", group_checks.duplicate),
    Check(5, "crowded", "Days with more gigs than a venue could run", group_checks.crowded),
    Check(6, "shared_poster", "Gigs under one picture", group_checks.shared_poster),
    Check(7, "shared_description", "Unrelated gigs with one description", group_checks.shared_description),
    Check(8, "contamination", "Gigs carrying site-wide text", contamination.contamination),
]


def claims_of(batch: Batch, checks: Sequence[Check] = CHECKS) -> DataFrame:
    """What every check names, one row per problem and distinct gig, written once.

    The checks do not need each other, so their jobs run side by side.
    """
    found = side_by_side([partial(c.claims, batch) for c in checks])
    every = reduce(
        DataFrame.unionByName,
        [
            claims.select(F.lit(c.order).alias("check_ord"), F.lit(c.name).alias("check_name"), *CLAIM)
            for c, claims in zip(checks, found, strict=True)
        ],
    )
    return durable(
        every.groupBy("check_ord", "check_name", "venue_id", "problem", "gig")
        .agg(F.min("detail").alias("detail"), F.min(F.struct("listing_pos", "url")).alias("first"))
        .select("check_ord", "check_name", "venue_id", "problem", "gig", "detail", "first.listing_pos", "first.url")
    )


def problems_of(claims: DataFrame) -> DataFrame:
    """Claims as problems: distinct gigs named and the first of them in listing order."""
    return (
        claims.groupBy("check_ord", "check_name", "venue_id", "problem")
        .agg(
            F.min("detail").alias("detail"), F.count("gig").alias("n_gigs"),
            F.min(F.struct("listing_pos", "url")).alias("first"),
        )
        .select("check_ord", "check_name", "venue_id", "problem", "detail", "n_gigs", F.when(F.col("n_gigs") > 0, F.col("first.url")).alias("first_url"))
    )


def report(claims: DataFrame) -> DataFrame:
    """Problems worth saying: those naming a gig no earlier check named, and those naming none.

    The window covers one gig's claims, at most one per check and problem.
    """
    of_gig = Window.partitionBy("venue_id", "gig")
    spoken = (
        claims.where(F.col("gig").isNotNull())
        .withColumn("fresh", F.min("check_ord").over(of_gig) >= F.col("check_ord"))
        .groupBy("check_ord", "venue_id", "problem").agg(F.bool_or("fresh").alias("fresh"))
        .where(~F.col("fresh")).select("check_ord", "venue_id", "problem")
    )
    return problems_of(claims).join(spoken, ["check_ord", "venue_id", "problem"], "left_anti")


def failed_venues(claims: DataFrame) -> DataFrame:
    """Venues with a problem that names a gig, reported or not."""
    return durable(claims.where(F.col("gig").isNotNull()).select("venue_id").distinct())


def failing(batch: Batch, checks: Sequence[Check] = CHECKS) -> DataFrame:
    """The venues that ``failed_venues`` would name, where no report is wanted.

    Only venue ids leave a check, folded before the shuffle; no claim is written and no row meets its detail.
    """
    found = side_by_side([partial(c.claims, batch) for c in checks])
    named = [claims.where(F.col("gig").isNotNull()).select("venue_id").distinct() for claims in found]
    return durable(reduce(DataFrame.unionByName, named).distinct())


def withheld(listing: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows of failed venues; ``failed`` is durable."""
    return attach(listing, failed, ["venue_id"], "left_semi")


def passed(listing: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows of all other venues; ``failed`` is durable."""
    return attach(listing, failed, ["venue_id"], "left_anti")


def misplaced_claims(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Claims about a gig the named venue did not list. There must be none."""
    return claims.where(F.col("gig").isNotNull()).join(
        facts.select("venue_id", "gig").distinct(), ["venue_id", "gig"], "left_anti"
    )
