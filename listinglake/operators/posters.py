"""Gigs read off poster images: replies are a table, one per poster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglake.functions.text import slug, stripped
from listinglake.model import CLASSIFIED, METAL, OBSERVED, USER
from listinglake.operators.projections import new_or_changed
from listinglake.venues import venues

# The largest image sent, and the form of a reply line.
MAX_IMAGE_BYTES = 7_000_000
LINE = r"^(\d{4}-\d{2}-\d{2})\s*\|\s*(.+)$"


def poster_key(source_url: Column, title: Column, date: Column) -> Column:
    """A url for a gig that has no page: its poster's, with title and date as fragment."""
    return F.concat(source_url, F.lit("#gig-"), slug(title), F.lit("-"), date.cast("string"))


def within_size(content: Column) -> Column:
    return F.octet_length(content) <= MAX_IMAGE_BYTES


def too_large(images: DataFrame) -> DataFrame:
    """Images (``image_url, content``) that are not sent, each with its failure."""
    size = F.octet_length("content")
    message = F.concat(  # fixed value: the text of the failure
        F.lit("Image at "), "image_url", F.lit(" is "), size.cast("string"), F.lit(f" bytes, too large to send (limit ~{MAX_IMAGE_BYTES})")
    )
    return images.where(~within_size(F.col("content"))).select("image_url", size.alias("bytes"), message.alias("error"))


def _listed(reply: Column) -> Column:
    """The reply's lines that are wholly ``yyyy-MM-dd | Title``, trimmed."""
    lines = F.transform(F.split(reply, r"\r\n|\n|\r"), stripped)
    return F.filter(lines, lambda line: line.rlike(LINE))


def _day(line: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(line, LINE, 1), F.lit("yyyy-MM-dd")).cast("date")


def _readable(reply: Column) -> Column:
    """The reply lists something, and every date it lists is one."""
    lines = _listed(reply)
    return F.coalesce((F.size(lines) > 0) & F.forall(lines, lambda line: _day(line).isNotNull()), F.lit(False))


def poster_rows(replies: DataFrame) -> DataFrame:
    """One row per listed gig of every readable reply, numbered as the poster lists them.

    ``replies`` has ``image_url, source_url, venue_id, reply``.
    """
    lines = replies.where(_readable(F.col("reply"))).select(
        "image_url", "source_url", "venue_id", F.posexplode(_listed(F.col("reply"))).alias("line_no", "line")
    )
    return lines.select(
        "image_url", "source_url", "venue_id", "line_no", _day(F.col("line")).alias("date"),
        stripped(F.regexp_extract("line", LINE, 2)).alias("title"),
    )


def unread_replies(replies: DataFrame) -> DataFrame:
    """Replies nothing could be read from: those posters failed."""
    return replies.where(~_readable(F.col("reply")))


def without_excluded(rows: DataFrame) -> DataFrame:
    """Rows but for titles their venue lists that are no gigs; other venues are untouched."""
    rules = venues(rows.sparkSession).select("venue_id", "excluded_title_regex")
    return (
        rows.join(F.broadcast(rules.where(F.col("excluded_title_regex").isNotNull())), "venue_id", "left")
        .where(F.col("excluded_title_regex").isNull() | ~F.rlike("title", F.concat(F.lit("(?i)"), "excluded_title_regex")))
        .drop("excluded_title_regex")
    )


def poster_gigs(replies: DataFrame) -> DataFrame:
    """Gigs of the posters; a poster gig has no page, so its title is its description."""
    return without_excluded(poster_rows(replies)).select(
        "venue_id", poster_key(F.col("source_url"), F.col("title"), F.col("date")).alias("url"), "title", "date",
        F.col("image_url").alias("poster_url"), F.col("title").alias("description"), "line_no",
    )


def ingest_entries(gigs: DataFrame, current: DataFrame, recorded_at: Column) -> DataFrame:
    """Log entries: new or changed gigs as observed, and all of them as Metal by the user."""
    observed = new_or_changed(gigs, current).select(
        F.lit(OBSERVED).alias("_type"), recorded_at.alias("recorded_at"), "venue_id", "url", "title", "date",
        "poster_url", "description",
    )
    judged = gigs.select(
        F.lit(CLASSIFIED).alias("_type"), recorded_at.alias("recorded_at"), "venue_id", "url",
        F.lit(METAL).alias("genre"), F.lit(USER).alias("source"),
    )
    return observed.unionByName(judged, allowMissingColumns=True)


