"""One scrape: extracted rows in, log entries and a report out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglake.model import GIG_FIELDS, KEY, OBSERVED, REPLACED
from listinglake.operators import projections as p
from listinglake.operators import relisting, report
from listinglake.operators.listings import isolate_failures
from listinglake.operators.quality import gate
from listinglake.operators.quality.batch import Batch
from listinglake.session import durable
from listinglake.skew import attach
from listinglake.venues import unknown_venues


@dataclass(frozen=True)
class Scrape:
    entries: DataFrame  # to append, with a position
    problems: DataFrame  # what the checks have to say
    failed: DataFrame  # venues that could not be read, and why
    summary: DataFrame


def venues_to_scrape(asked: DataFrame, known: DataFrame, log: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """The venues due among those asked for; one the sources do not cover is an error."""
    unknown = unknown_venues(asked, known).take(1)
    if unknown:
        raise ValueError(f"unknown venue id: {unknown[0][0]}")
    return p.due_venues(asked.select("venue_id").distinct(), p.last_scraped(log), now, force)


def scrape(
    log: DataFrame, extracted: DataFrame, asked: DataFrame, url_status: DataFrame, now: Column, today: Column
) -> Scrape:
    """``extracted`` is listing rows with an ``error`` column; ``asked`` the venues that were tried.

    A venue with an error is out of the run and is not taken for one that listed nothing. A venue a
    check names a gig of has its whole listing withheld and is not looked at for moved gigs.
    """
    listing, failed = isolate_failures(durable(extracted))
    listing = durable(listing)
    scraped = durable(asked.select("venue_id").distinct().join(failed.select("venue_id"), "venue_id", "left_anti"))
    current = durable(p.current_gigs(log))
    batch = Batch.of(listing, scraped, current)
    claims = gate.claims_of(batch)
    withheld = gate.failed_venues(claims)

    changed = durable(p.new_or_changed(listing, current))
    observed = gate.passed(changed, withheld)
    # a venue that was not scraped this time says nothing about the gigs it no longer lists
    held = attach(current, scraped, ["venue_id"], "left_semi")
    moved = relisting.replacements(gate.passed(listing, withheld), gate.passed(held, withheld), url_status, today)
    entries = observed.select(F.lit(OBSERVED).alias("_type"), now.alias("recorded_at"), *KEY, *GIG_FIELDS).unionByName(
        moved.select(F.lit(REPLACED).alias("_type"), now.alias("recorded_at"), *KEY, "by_venue_id", "by_url"),
        allowMissingColumns=True,
    )
    return Scrape(
        entries=durable(entries.withColumn("position", F.monotonically_increasing_id())),
        problems=gate.report(claims),
        failed=failed,
        summary=report.scrape_summary(listing, changed, observed),
    )
