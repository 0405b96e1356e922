"""One render of the published list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglake.operators import projections as p
from listinglake.operators import publishing as pub
from listinglake.operators import report
from listinglake.session import durable
from listinglake.sources.published import publish

CARD = ["date", "display_date", "position", "title", "venue", "url", "image_url"]


class Unresolved(Exception):
    """Gigs of the page have no verdict yet."""


@dataclass(frozen=True)
class Render:
    page: DataFrame
    entries: DataFrame  # the rendered entry, with a position
    changed_days: DataFrame
    images_to_publish: DataFrame
    images_to_drop: DataFrame


def render(
    log: DataFrame, today: Column, at: Column, archive_path: str, images: DataFrame, force: bool = False, show: int = 5,
    page_path: str | None = None,
) -> Render:
    """Publish the page as of ``today``, unless gigs on it are unresolved and it is not forced.

    The page is archived under its instant; days that differ from the newest archived page are
    told, so nothing else has to be touched. With ``page_path`` the page is published there as well,
    of which only those days are written. ``images`` lists published image files.
    """
    spark = log.sparkSession
    current, status = durable(p.current_gigs(log)), durable(p.class_status(log))
    if not force:
        waiting = report.unresolved(pub.page_window(p.with_status(current, status), today))
        soonest = waiting.limit(show).collect()
        if soonest:
            listed = "; ".join(f"{r.date} {r.venue_id} {r.title} {r.url}" for r in soonest)
            raise Unresolved(f"{waiting.count()} upcoming gig(s) not yet classified, soonest: {listed}")
    metal = p.metal_of(current, status)
    cards = durable(pub.cards(metal, today))
    page = durable(pub.placed(cards))
    published = _published(spark, archive_path, page)
    changed = durable(pub.publish_delta(page, published))
    if page_path is not None:
        publish(page, page_path, at)
    stamp = spark.range(1).select(pub.snapshot_stamp(at)).first()[0]
    pub.write_snapshot(page.select(*CARD), archive_path, stamp)
    entry = pub.rendered_entry(page, f"snapshot={stamp}", today, at).withColumn("position", F.lit(0).cast("bigint"))
    return Render(page, entry, changed, pub.images_to_publish(cards, images), pub.images_to_drop(metal, images))


def _published(spark, archive_path: str, page: DataFrame) -> DataFrame:
    """The newest archived page, an empty one before the first render."""
    from pyspark.errors import AnalysisException

    try:
        # written out, since this render is about to add to the archive it reads
        return durable(pub.current_snapshot(spark.read.parquet(archive_path)).select(*CARD))
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return page.select(*CARD).limit(0)
        raise
