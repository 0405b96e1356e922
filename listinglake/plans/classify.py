"""One classification run over the gigs of a log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglake.operators import classification as c
from listinglake.operators import projections as p
from listinglake.operators import report
from listinglake.session import durable
from listinglake.venues import unknown_venues, venues


@dataclass(frozen=True)
class Classification:
    entries: DataFrame  # to append, with a position
    failed: DataFrame  # gigs that stay pending, and why
    cost: DataFrame
    summary: DataFrame


def classify(
    log: DataFrame,
    judge: c.Judge | c.BatchJudge,
    now: Column,
    venue_ids: DataFrame | None = None,
    limit: int | None = None,
    force: bool = False,
    kept: DataFrame | None = None,
    in_batches: bool = False,
) -> Classification:
    """Judge what has no verdict yet; forced, everything but what a user has judged.

    ``kept`` holds replies of a run that did not get to its end; they are not asked for again.
    ``judge`` takes single rows, or lists of them where it says ``in_batches``.
    """
    if venue_ids is not None:
        unknown = unknown_venues(venue_ids, venues(log.sparkSession)).take(1)
        if unknown:
            raise ValueError(f"unknown venue id: {unknown[0][0]}")
    current = durable(p.current_gigs(log))
    settled = p.overridden(log) if force else p.already_classified(log)
    asked = c.routed(c.to_classify(current, settled, limit, venue_ids))
    # written once: every reply is paid for
    outcome = durable(c.outcomes(c.score_batches(asked, judge if in_batches else c.one_by_one(judge), kept)))
    entries = durable(c.verdict_entries(outcome, now).withColumn("position", F.monotonically_increasing_id()))
    last = log.agg(F.max("seq")).first()[0]
    numbered = entries.withColumn("seq", F.col("position") + (0 if last is None else last + 1)).drop("position")
    after = log.unionByName(numbered, allowMissingColumns=True)
    metal = p.metal_of(current, p.class_status(after))
    return Classification(
        entries=entries,
        failed=outcome.where(F.col("error").isNotNull()).select("venue_id", "url", "error"),
        cost=c.cost_report(entries),
        summary=report.classify_summary(outcome, metal),
    )
