"""Checks of a row's own text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglake.functions.text import is_blank, longer_than, utf16_length
from listinglake.operators.quality.batch import CLAIM, Batch

# Limits in characters.
MAX_TITLE, MAX_DESCRIPTION = 200, 10_000
# What a page says in place of its content, matched ignoring case.
BOILERPLATE = r"(?i)we use cookies|allow the use of cookies|enable j(ava)?s(cript)?\b"
# Marks of text that was copied without being parsed, tags matched ignoring case.
HTML_TAG = r"(?i)</?(?:a|p|br|div|span|img|li|ul|ol|em|strong|b|i|h[1-6]|iframe|script|table|tr|td|figure|blockquote)\b[^<>]*>"
HTML_ENTITY = r"&(?:[a-zA-Z][a-zA-Z0-9]{1,31}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});"
MOJIBAKE = r"[\x{c3}\x{c2}][\x{80}-\x{bf}]|\x{e2}\x{20ac}."


def misshapen_reason() -> Column:
    """The first rule a row breaks, as the text it is reported under; null when it breaks none."""
    # the report's words below are fixed values
    description = F.col("description")
    chars = lambda what, n: F.concat(F.lit(f"{what} of "), n.cast("string"), F.lit(" chars"))
    return (
        F.when(longer_than(F.col("title"), MAX_TITLE), chars("title", utf16_length(F.col("title"))))
        .when(is_blank(description), F.lit("no description"))
        .when(
            description.startswith("{") | description.rlike(BOILERPLATE),
            F.lit("description is a cookie or bot wall, not gig copy"),
        )
        .when(longer_than(description, MAX_DESCRIPTION), chars("description", utf16_length(description)))
    )


def marker_in(text: Column) -> Column:
    # a text without a pattern's first character is spared the pattern
    begun = lambda *firsts: reduce(or_, [text.contains(c) for c in firsts])
    # the marks' names are fixed values
    return (
        F.when(begun("<") & text.rlike(HTML_TAG), F.lit("unparsed markup"))
        .when(begun("&") & text.rlike(HTML_ENTITY), F.lit("an html entity"))
        .when(begun("\u00c3", "\u00c2", "\u00e2") & text.rlike(MOJIBAKE), F.lit("mis-decoded characters"))
    )


def misshapen(batch: Batch) -> DataFrame:
    reason = F.col("misshapen")
    return batch.facts.where(reason.isNotNull()).select(
        "venue_id", reason.alias("problem"), reason.alias("detail"), "gig", "listing_pos", "url"
    )


def unparsed(batch: Batch) -> DataFrame:
    """Titles name their gigs; descriptions are reported per venue and marker and name none."""
    titles = batch.facts.where(F.col("title_marker").isNotNull()).select(
        "venue_id",
        F.concat(F.lit("title holds "), "title_marker").alias("problem"),
        F.concat(F.lit("title holds "), "title_marker").alias("detail"),
        "gig", "listing_pos", "url",
    )
    found = (
        batch.facts.where(F.col("copy_marker").isNotNull()).groupBy("venue_id", "copy_marker")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("listing_pos", "url")).alias("first"))
    )
    copies = found.select(
        "venue_id",
        F.concat(F.lit("description holds "), "copy_marker").alias("problem"),
        F.concat(F.col("n").cast("string"), F.lit(" description(s) hold "), "copy_marker", F.lit(", e.g. "), "first.url").alias("detail"),
        F.lit(None).cast("string").alias("gig"),
        "first.listing_pos", "first.url",
    )
    return titles.unionByName(copies).select(*CLAIM)
