"""What every check reads, and the shape in which it answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglake.session import durable

# One row per gig a problem names, or a single row with a null ``gig`` for one that names none.
CLAIM = ["venue_id", "problem", "detail", "gig", "listing_pos", "url"]


def description_print() -> Column:
    return F.sha2("description", 256)


def gig_print() -> Column:
    """Equal exactly when two rows of a venue are the same gig in every field."""
    return F.sha2(F.to_json(F.struct("url", "title", "date", "poster_url", description_print().alias("d"))), 256)


@dataclass(frozen=True)
class Batch:
    """One scrape. ``previous`` is what the log holds as current.

    ``facts`` is the narrow side of the listing, without descriptions, written once so that every
    grouping of it shuffles keys and prints rather than text.
    """

    listing: DataFrame
    scraped_venues: DataFrame
    previous: DataFrame
    facts: DataFrame

    @staticmethod
    def of(listing: DataFrame, scraped_venues: DataFrame, previous: DataFrame) -> Batch:
        return Batch(listing, scraped_venues, previous, durable(facts_of(listing)))


@dataclass(frozen=True)
class Check:
    order: int
    name: str
    heading: str
    claims: Callable[[Batch], DataFrame]


def facts_of(listing: DataFrame) -> DataFrame:
    from listinglake.functions.text import shortened, title_words
    from listinglake.operators.quality.text_checks import marker_in, misshapen_reason

    return listing.select(
        "venue_id", "listing_pos", "url", "date", "poster_url",
        gig_print().alias("gig"),
        description_print().alias("copy"),
        shortened(F.col("description")).alias("quoted"),
        title_words(F.col("title")).alias("title_words"),
        misshapen_reason().alias("misshapen"),
        marker_in(F.col("title")).alias("title_marker"),
        marker_in(F.col("description")).alias("copy_marker"),
        (~F.col("description").rlike(r"[^\s\p{Z}\x{1c}-\x{1f}\x{85}]")).alias("blank"),
    )
