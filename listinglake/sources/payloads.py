"""Listing API payloads: nested JSON bodies as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglake.functions.dates import iso_date, local_date
from listinglake.functions.text import is_blank, title_spacing
from listinglake.functions.urls import dated_key, first_not_blank, without_query
from listinglake.operators.dom import html_text

SEARCH_SCHEMA = (
    "documents array<struct<name: string, encodedName: string, eventDate: string, image: string, "
    "tickets: array<struct<ticketUrl: string>>, localizations: array<struct<description: string>>, "
    "genres: array<struct<name: string>>, lineup: array<struct<id: string, name: string>>>>"
)
PARTNER_SCHEMA = (
    "data array<struct<name: string, perm_name: string, date: string, timezone: string, "
    "images: array<string>, raw_description: string, status: string>>, links struct<next: string>"
)
# the picture is a url or the literal false, so its type is read per event
CALENDAR_SCHEMA = (
    "events array<struct<Title: string, URL: string, StartDateTime: string, Category: string, ImageURL: variant>>"
)
# The calendar's music category; the copy that stands in for a cancelled show's.
MUSIC = "3"
CANCELLED = r"(?i)^sorry, this show has been cancelled"


def events_of(bodies: DataFrame, schema: str, field: str, keep: list[str]) -> DataFrame:
    """One row per array element of ``body``, in order.

    A body without elements keeps one row with a null ``event``; ``readable`` says whether it was
    such JSON at all.
    """
    return bodies.select(*keep, F.from_json("body", schema).alias("_b")).select(
        *keep, F.col(f"_b.{field}").isNotNull().alias("readable"), F.posexplode_outer(f"_b.{field}").alias("item_no", "event")
    )


def search_events(bodies: DataFrame, keep: list[str]) -> DataFrame:
    return events_of(bodies, SEARCH_SCHEMA, "documents", keep)


def ticketed(events: DataFrame) -> DataFrame:
    return events.where(F.size("event.tickets") > 0)


def ticketless(events: DataFrame) -> DataFrame:
    return events.where((F.size("event.tickets") <= 0) & F.col("event").isNotNull())


def ticketless_report(events: DataFrame) -> DataFrame:
    """Per venue how many events had no ticket link. Their names stay rows, see ``ticketless``."""
    return ticketless(events).groupBy("venue_id").agg(F.count(F.lit(1)).alias("skipped"))


def search_copy(copy: Column, event: str = "event") -> Column:
    """The event's own copy, unless blank or a cancellation notice; else its acts and genres."""
    names = lambda f: F.array_join(F.transform(F.coalesce(F.col(f"{event}.{f}"), F.array()), lambda x: x["name"]), ", ")
    part = lambda label, text: F.when(~is_blank(text), F.concat(F.lit(f"{label}: "), text, F.lit(".")))
    fallback = F.concat_ws(" ", part("Lineup", names("lineup")), part("Genre", names("genres")))
    return F.when(~is_blank(copy) & ~copy.rlike(CANCELLED), copy).otherwise(fallback)


def search_listing(events: DataFrame) -> DataFrame:
    """Ticketed events as listing rows; a blank picture is left null for the event page to fill."""
    markup = F.coalesce(F.try_element_at("event.localizations", F.lit(1))["description"], F.lit(""))
    kept = [c for c in events.columns if c not in ("readable", "item_no", "event")]
    return html_text(ticketed(events).withColumn("copy", markup), "copy").select(
        *kept, "item_no",
        without_query(F.try_element_at("event.tickets", F.lit(1))["ticketUrl"]).alias("url"),
        title_spacing(F.col("event.name")).alias("title"),
        iso_date(F.substring_index("event.eventDate", "T", 1), r"^(\d{4}-\d{2}-\d{2})$").alias("date"),
        first_not_blank(F.col("event.image")).alias("poster_url"),
        search_copy(F.col("copy")).alias("description"),
        F.concat(F.col("event.encodedName"), F.lit("-tickets-ae"), F.try_element_at("event.lineup", F.lit(1))["id"]).alias("page_name"),
    )


def partner_listing(bodies: DataFrame, keep: list[str]) -> DataFrame:
    """Partner API events as listing rows; ``perm_name`` still has to be resolved to its url."""
    events = events_of(bodies, PARTNER_SCHEMA, "data", keep).where(F.col("event").isNotNull())
    e = lambda f: F.col(f"event.{f}")
    return events.select(
        *keep, "item_no", e("perm_name").alias("perm_name"),
        title_spacing(cancelled_title(e("name"), e("status"))).alias("title"),
        local_date(F.try_to_timestamp(e("date")), e("timezone")).alias("date"),
        first_not_blank(F.try_element_at(e("images"), F.lit(1))).alias("poster_url"),
        e("raw_description").alias("description"),
    )


def cancelled_title(name: Column, status: Column) -> Column:
    return F.when(status == "cancelled", F.concat(name, F.lit(" - CANCELLED"))).otherwise(name)


def redirected_key(listed: Column, status: Column, location: Column, prefix: str) -> Column:
    """A listed url as the answer to it names it: a redirect's target if under ``prefix``, else null."""
    return F.when(
        status.between(300, 399), F.when(F.startswith(location, F.lit(prefix)), location)
    ).when(status.between(200, 299), listed)


def calendar_events(bodies: DataFrame, keep: list[str]) -> DataFrame:
    return events_of(bodies, CALENDAR_SCHEMA, "events", keep).where(F.col("event").isNotNull())


def text_or_null(value: Column) -> Column:
    """A variant's text; null where it holds anything but text."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def music_listing(events: DataFrame, keep: list[str]) -> DataFrame:
    """Music events as rows keyed by page and date, so two nights of one page stay two gigs."""
    date = iso_date(F.substring("event.StartDateTime", 1, 10))
    return events.where(F.col("event.Category") == MUSIC).select(
        *keep, "item_no", dated_key(F.col("event.URL"), date).alias("url"), F.col("event.URL").alias("page_url"),
        title_spacing(F.col("event.Title")).alias("title"), date.alias("date"),
        text_or_null(F.col("event.ImageURL")).alias("poster_url"),
    )


def unwrapped_html(body: Column) -> Column:
    """HTML that arrives as one JSON string; blank for an empty body or any other JSON value.

    A body that is not JSON at all gives null, which fails its venue.
    """
    bare = F.trim(body)
    value = F.from_json(F.concat(F.lit('{"h":'), bare, F.lit("}")), "h variant")["h"]
    return F.when(bare == "", "").when(value.isNotNull(), F.coalesce(text_or_null(value), F.lit("")))


def unquoted_literal(literal: Column) -> Column:
    """Markup held in a single-quoted script literal."""
    inner = F.regexp_replace(F.trim(literal), "(?s)^'(.*)'$", "$1")
    return F.from_json(F.concat(F.lit('{"h":"'), inner, F.lit('"}')), "h string")["h"]
