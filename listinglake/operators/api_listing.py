"""Listing API answers to listing rows, each with its ``error`` or null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglake.functions.urls import first_not_blank, resolved, without_query
from listinglake.operators import dom
from listinglake.operators.extraction import LISTING, page_copy, with_errors
from listinglake.operators.listings import dedupe_first, page_position, silent_venues
from listinglake.skew import attach
from listinglake.sources import payloads
from listinglake.sources.html import with_nodes

# Where partner events live, and where a search event's own page is.
PARTNER_EVENTS = "https://dice.fm/event/"
SEARCH_SITE = "https://www.academymusicgroup.com/"
_KEEP = ["venue_id", "page_no"]


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("listing_pos", page_position(F.col("page_no"), F.col("item_no")))


def _failures(reasons: DataFrame) -> DataFrame:
    """Venues that fail as a whole, as rows that carry nothing but why."""
    empty = {"listing_pos": "bigint", "url": "string", "title": "string", "date": "date", "poster_url": "string", "description": "string"}
    return reasons.select("venue_id", *[F.lit(None).cast(kind).alias(name) for name, kind in empty.items()], "error")


def _checked(rows: DataFrame, rules: DataFrame) -> DataFrame:
    return with_errors(attach(rows, rules.select("venue_id", "under"), ["venue_id"], "inner")).select(*LISTING, "error")


def _unread(events: DataFrame) -> DataFrame:
    return events.where(~F.col("readable")).select("venue_id").distinct().select("venue_id", F.lit("Answer is not the JSON expected").alias("error"))


def _nothing(bodies: DataFrame, events: DataFrame) -> DataFrame:
    listed = events.where(F.col("event").isNotNull())
    return silent_venues(bodies, listed).select("venue_id", F.lit("No events returned").alias("error"))


def hero_images(event_pages: DataFrame) -> DataFrame:
    """The picture each event page opens with, without its query."""
    hero = dom.first(dom.select(F.col("nodes"), dom.selector(tag="img", attr="sizes", equals="100vw")))
    src = without_query(resolved(dom.attr(hero, "src"), F.col("url")))
    return with_nodes(event_pages, "body").select("venue_id", F.col("url").alias("page_url"), first_not_blank(src).alias("hero"))


def search_rows(bodies: DataFrame, event_pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Search answers (``venue_id, page_no, body``); a picture they lack comes off the event's page."""
    events = payloads.search_events(bodies, _KEEP)
    listed = _placed(payloads.search_listing(events)).withColumn(
        "page_url", F.concat(F.lit(SEARCH_SITE), F.replace("venue_id", F.lit("-"), F.lit("")), F.lit("/events/"), "page_name")
    )
    filled = listed.join(hero_images(event_pages), ["venue_id", "page_url"], "left").withColumn(
        "poster_url", F.coalesce("poster_url", "hero")
    )
    return _checked(filled, rules).unionByName(_failures(_nothing(bodies, events)))


def partner_rows(bodies: DataFrame, url_status: DataFrame, rules: DataFrame) -> DataFrame:
    """Partner answers; what each event's url answered names its key."""
    listed = _placed(payloads.partner_listing(bodies, _KEEP)).withColumn("listed", F.concat(F.lit(PARTNER_EVENTS), "perm_name"))
    answers = url_status.select(F.col("url").alias("listed"), "status", "location")
    key = payloads.redirected_key(F.col("listed"), F.col("status"), F.col("location"), PARTNER_EVENTS)
    resolved_rows = _checked(listed.join(answers, "listed", "left").withColumn("url", F.coalesce(key, F.lit(""))), rules)
    events = payloads.events_of(bodies, payloads.PARTNER_SCHEMA, "data", _KEEP)
    return resolved_rows.unionByName(_failures(_nothing(bodies, events)))


def calendar_rows(bodies: DataFrame, event_pages: DataFrame, rules: DataFrame, copies: DataFrame) -> DataFrame:
    """Month calendars: music only, the first of each page and date, its copy off the event's page."""
    events = payloads.events_of(bodies, payloads.CALENDAR_SCHEMA, "events", _KEEP)
    music = _placed(payloads.music_listing(events.where(F.col("event").isNotNull()), _KEEP))
    said = page_copy(event_pages, copies).select("venue_id", F.col("url").alias("page_url"), "description")
    told = dedupe_first(music, ["venue_id", "url"]).join(said, ["venue_id", "page_url"], "left")
    return _checked(told.withColumn("poster_url", first_not_blank(F.col("poster_url"))), rules).unionByName(_failures(_unread(events)))
