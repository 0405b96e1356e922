"""State read off the log. "Latest" is always by ``seq``, never by ``recorded_at``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglake.functions.once import once
from listinglake.model import CLASSIFIED, GIG_FIELDS, KEY, METAL, OBSERVED, OTHER, PENDING, RENDERED, REPLACED, USER
from listinglake.operators.inheritance import inherited_from
from listinglake.skew import shuffled
from listinglake.sources.log import entries_of


def latest_observations(log: DataFrame) -> DataFrame:
    """The newest observation of every gig, replaced gigs included. Combined before the shuffle.

    ``first_seq`` is where the gig first appeared, the order that breaks ties between dates.
    """
    row = F.struct("seq", "recorded_at", *GIG_FIELDS)
    return (
        entries_of(log, OBSERVED).groupBy(*KEY)
        .agg(F.max_by(row, "seq").alias("o"), F.min("seq").alias("first_seq"))
        .select(*KEY, "o.*", "first_seq")
    )


def current_gigs(log: DataFrame) -> DataFrame:
    """The newest observation of every gig whose key nothing has ever replaced.

    Reduced to one row per key first, so the join reuses the aggregation's partitioning.
    """
    replaced = entries_of(log, REPLACED).select(*KEY).distinct()
    return latest_observations(log).join(shuffled(replaced), KEY, "left_anti").select(*KEY, *GIG_FIELDS, "seq", "first_seq")


def same_gig(left: str, right: str) -> Column:
    """Every field equal, nulls included, so an absent right side is a difference."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")) for f in GIG_FIELDS])


def new_or_changed(scraped: DataFrame, current: DataFrame) -> DataFrame:
    """Scraped rows whose gig is not current yet, or differs from the current one in any field."""
    known = current.select(*KEY, F.lit(True).alias("known"), *GIG_FIELDS)
    return (
        scraped.alias("s").join(shuffled(known.alias("c")), KEY, "left")
        .where(F.col("c.known").isNull() | ~same_gig("s", "c"))
        .select(*[F.col(c) if c in KEY else F.col(f"s.{c}") for c in scraped.columns])
    )


def last_scraped(log: DataFrame) -> DataFrame:
    """When each venue last had an observation recorded."""
    return entries_of(log, OBSERVED).groupBy("venue_id").agg(F.max("recorded_at").alias("last_scraped"))


def effective_verdicts(log: DataFrame) -> DataFrame:
    """Each classified key's own genre: the newest user verdict, else the newest model verdict.

    ``seq`` and the two-valued genre share one long, so the aggregate keeps fixed-width state and
    stays a hash aggregate.
    """
    coded = F.col("seq") * 2 + (F.col("genre") == METAL).cast("bigint")
    by_user = F.col("source") == USER
    return (
        entries_of(log, CLASSIFIED).groupBy(*KEY)
        .agg(F.max(F.when(by_user, coded)).alias("u"), F.max(F.when(~by_user, coded)).alias("m"))
        .select(*KEY, F.when(F.coalesce("u", "m") % 2 == 1, METAL).otherwise(OTHER).alias("genre"))
    )


def classified_keys(log: DataFrame) -> DataFrame:
    return entries_of(log, CLASSIFIED).select(*KEY).distinct()


def user_keys(log: DataFrame) -> DataFrame:
    return entries_of(log, CLASSIFIED).where(F.col("source") == USER).select(*KEY).distinct()


def inherited(log: DataFrame, known: DataFrame) -> DataFrame:
    return inherited_from(entries_of(log, REPLACED), known)


def class_status(log: DataFrame) -> DataFrame:
    """The genre every key has, its own or the one inherited along its replacements."""
    own = effective_verdicts(log)
    taken = inherited(log, own.select(*KEY))
    from_own = own.select(F.col("venue_id").alias("from_venue_id"), F.col("url").alias("from_url"), "genre")
    handed_on = taken.join(shuffled(from_own), ["from_venue_id", "from_url"]).select(*KEY, "genre")
    return own.unionByName(handed_on)


def with_status(gigs: DataFrame, status: DataFrame) -> DataFrame:
    """Add each gig's genre as ``status``, ``Pending`` where it has none."""
    return (
        gigs.join(status.select(*KEY, "genre"), KEY, "left")
        .withColumn("status", F.coalesce("genre", F.lit(PENDING))).drop("genre")
    )


def metal_gigs(log: DataFrame) -> DataFrame:
    return metal_of(current_gigs(log), class_status(log))


def metal_of(current: DataFrame, status: DataFrame) -> DataFrame:
    metal = status.where(F.col("genre") == METAL).select(*KEY)
    return current.join(shuffled(metal), KEY, "left_semi")


def already_classified(log: DataFrame) -> DataFrame:
    """Keys with a verdict of any source, and keys that inherit one."""
    known = classified_keys(log)
    return known.unionByName(inherited(log, known).select(*KEY))


def overridden(log: DataFrame) -> DataFrame:
    """Keys a user judged, and keys that inherit from one; model verdicts do not stop the walk."""
    known = user_keys(log)
    return known.unionByName(inherited(log, known).select(*KEY))


def already_ingested(log: DataFrame, sources: DataFrame) -> DataFrame:
    """Poster sources (``source_url``) some observed url starts with, followed by ``#``.

    A source may itself hold ``#``, so each observed url offers every prefix that ends before one;
    the prefixes join by equality.
    """
    prefixes = once(
        F.split("url", "#"),
        lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "#")),
    )
    seen = (
        entries_of(log, OBSERVED).where(F.col("url").contains("#"))
        .select(F.explode(prefixes).alias("source_url")).distinct()
    )
    return sources.join(seen, "source_url", "left_semi")


def already_rendered(log: DataFrame, dates: DataFrame) -> DataFrame:
    """Dates (``logical_date``) the page was rendered for, whenever that happened."""
    done = entries_of(log, RENDERED).select("logical_date").distinct()
    return dates.join(done, "logical_date", "left_semi")


def due_venues(venues: DataFrame, last: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """Venues to scrape: all when forced, else those not seen changing within the last day."""
    if force:
        return venues
    recent = last.where(F.col("last_scraped") > now - F.expr("INTERVAL 1 DAY")).select("venue_id")
    return venues.join(recent, "venue_id", "left_anti")


def override_batch(current: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User verdicts for current gigs named by url, and the overrides that name none."""
    # where venues share a url, the gig that the log held first
    by_url = current.groupBy("url").agg(F.min(F.struct("first_seq", "venue_id"))["venue_id"].alias("venue_id"))
    matched = overrides.join(by_url, "url", "left")
    verdicts = matched.where(F.col("venue_id").isNotNull()).select(
        F.lit(CLASSIFIED).alias("_type"), *KEY, "genre", F.lit(USER).alias("source")
    )
    return verdicts, matched.where(F.col("venue_id").isNull()).select("url", "genre")
