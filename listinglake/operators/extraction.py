"""Fetched pages to listing rows, by rules: one plan for all venues.

Rules join to pages by broadcast, once their size is counted; everything a rule reads is in its page's row. The only shuffles
are the ones the result needs: cards meeting their event pages, and venue-wide order and failures.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglake.functions import dates as d
from listinglake.functions import urls as u
from listinglake.functions.once import once
from listinglake.functions.text import is_blank, not_blank, title_problem, title_spacing
from listinglake.operators import dom
from listinglake.operators.listings import (
    dedupe_first, isolate_failures, january_after_another, later_month, page_position, pages_in_use, running_year,
)
from listinglake.session import durable
from listinglake.skew import attach, shuffled
from listinglake.sources import payloads
from listinglake.sources.html import with_nodes

CARD_PARTS = ["must_hold", "link", "link_fallback", "title", "date_at", "month", "day", "poster", "card_copy"]
LISTING = ["venue_id", "listing_pos", "url", "title", "date", "poster_url", "description"]


def _attr_of(found: Column, name: Column) -> Column:
    """An attribute of the first found node that has it, ``""`` without one."""
    holder = dom.first(F.filter(found, lambda n: dom.attr(n, name).isNotNull()))
    return F.coalesce(dom.attr(holder, name), F.lit(""))


def _absolute(link: Column, page_url: Column) -> Column:
    return once(link, lambda at: F.when(is_blank(at), F.lit("")).otherwise(u.resolved(at, page_url)))


def card_rows(pages: DataFrame, rules: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per card of every page, with what its rule reads off it.

    ``pages`` is ``venue_id, url, page_no, status, body`` of listing pages that opened. Columns of
    the result: key, place, ``title``, ``date`` or ``month`` and ``day``, ``poster``, ``card_copy``,
    and the page's own columns named in ``keep``.
    """
    parsed = attach(with_nodes(pages, "body"), rules.withColumnRenamed("date", "date_at"), ["venue_id"], "inner")
    nodes, r = F.col("nodes"), F.col
    found = F.when(
        r("card_has").isNotNull(), dom.having(nodes, F.element_at("cards", 1), r("card_has"))
    ).otherwise(dom.select_any(nodes, r("cards")))
    # what a rule's selectors want around a node is looked for once in a page, not once in a card
    scopes = F.struct(*[dom.scoped(r(rule), nodes).alias(rule) for rule in CARD_PARTS])
    dated = F.filter(nodes, lambda n: dom.attr(n, r("date_attr")).isNotNull())
    parsed = parsed.withColumn("scopes", scopes).withColumn("dated", dated)
    kept = F.filter(
        found,
        lambda c: r("must_hold").isNull() | (F.size(dom.select_scoped(dom.subtree(nodes, c), F.col("scopes.must_hold"))) > 0),
    )
    # each field's nodes, within the card: read while the page is at hand, so that no card carries a page along
    def fields_of(c: Column) -> Column:
        part = dom.subtree(nodes, c)
        pick = lambda rule: dom.select_scoped(part, F.col(f"scopes.{rule}"))
        link = F.when(r("link_has").isNotNull(), dom.having(part, F.element_at("link", 1), r("link_has"))).otherwise(pick("link"))
        above = F.filter(F.col("dated"), lambda n: (n["node_id"] < c["node_id"]) & (c["node_id"] <= n["end_id"]))
        return F.struct(
            link.alias("link_nodes"), pick("link_fallback").alias("fallback_nodes"), pick("title").alias("title_nodes"),
            pick("date_at").alias("date_nodes"), pick("month").alias("month_nodes"), pick("day").alias("day_nodes"),
            pick("poster").alias("poster_nodes"), pick("card_copy").alias("copy_nodes"), part.alias("part"),
            dom.attr(F.try_element_at(above, F.lit(-1)), r("date_attr")).alias("block"),
        )

    # an outer explode keeps a page without cards as one row, which is what ends a walk
    read_off = parsed.withColumn("found", F.transform(kept, fields_of)).drop("nodes", "scopes", "dated")
    card = read_off.select("*", F.posexplode_outer("found").alias("item_no", "card")).drop("found")
    part = F.col("part")
    fields = card.select(
        *keep, "venue_id", F.col("url").alias("page_url"), "page_no", "under", "title_first", "tidy_title", "date_attr", "date_kind",
        "date_pattern", "century", "year_rule", "poster_kind", "house_image", "distinct_links",
        "item_no", page_position(F.col("page_no"), F.coalesce("item_no", F.lit(0))).alias("listing_pos"),
        r("card_copy").isNotNull().alias("has_card_copy"), "poster_attrs", "card.*",
    )
    text = lambda column: F.coalesce(dom.joined_text(F.col(column), part), F.lit(""))
    href = _absolute(_attr_of(F.col("link_nodes"), F.lit("href")), F.col("page_url"))
    fallback = _absolute(_attr_of(F.col("fallback_nodes"), F.lit("href")), F.col("page_url"))
    title = F.when(F.coalesce("title_first", F.lit(False)), F.coalesce(dom.text_of(dom.within(part, dom.first(F.col("title_nodes")))), F.lit(""))).otherwise(text("title_nodes"))
    read = durable(
        fields.withColumn("url", F.coalesce(u.first_not_blank(href, fallback), F.lit("")))
        .withColumn("title", F.when(F.coalesce("tidy_title", F.lit(False)), title_spacing(title)).otherwise(title))
        .withColumn("date", _date(text("date_nodes")))
        .withColumn("month", _month(text("month_nodes")))
        .withColumn("day", F.regexp_extract(text("day_nodes"), r"(\d{1,2})", 1).try_cast("int"))
        .withColumn("poster", _poster())
        .withColumn("card_copy", F.when(F.col("has_card_copy"), text("copy_nodes")))
        .select(*keep, "venue_id", "page_no", "item_no", "listing_pos", "url", "under", "title", "date", "month", "day",
                "year_rule", "poster", "house_image", "card_copy", "distinct_links")
    )
    return walked(read).drop("page_no", "item_no")


def walked(read: DataFrame) -> DataFrame:
    """Cards of the pages before the first without any; ``after_gap`` marks those behind a missing page."""
    pages = durable(read.groupBy("venue_id", "page_no").agg(F.count("item_no").alias("items")))
    used = durable(pages_in_use(pages).select("venue_id", "page_no", "after_gap"))
    return attach(read.where(F.col("item_no").isNotNull()), used, ["venue_id", "page_no"], "inner", stored=True)


def _date(text: Column) -> Column:
    """The date by the rule's kind."""
    part, found, kind, pattern = F.col("part"), F.col("date_nodes"), F.col("date_kind"), F.col("date_pattern")
    attr = _attr_of(found, F.coalesce("date_attr", F.lit("")))
    inner = lambda node, name: dom.text_of(_classed(part, node, name))
    marked = lambda *names: F.coalesce(*[dom.first(_named(part, found, name)) for name in names])
    parts = once(
        F.struct(marked("m-date__rangeFirst", "m-date__singleDate").alias("a"), marked("m-date__rangeLast", "m-date__rangeFirst", "m-date__singleDate").alias("b")),
        lambda ends: once(
            F.array(inner(ends["a"], "m-date__day"), inner(ends["a"], "m-date__month"), inner(ends["b"], "m-date__month"), inner(ends["b"], "m-date__year")),
            lambda v: d.parts_start(v[0], v[1], v[2], v[3]),
        ),
    )
    printed = lambda line: d.day_of(
        _group(line, pattern, 3).try_cast("int") + F.coalesce("century", F.lit(0)),
        d.month_number(_group(line, pattern, 2)), _group(line, pattern, 1).try_cast("int"),
    )
    by_text = once(
        text,
        lambda line: F.when(kind == "printed", printed(line)).when(kind == "range", d.range_start(line))
        .when(kind == "month_first_range", d.month_first_range_start(line))
        .when(kind == "block", d.block_date(F.col("block"), _group(line, pattern, 1))),
    )
    return (
        F.when(kind == "iso", d.iso_date(attr)).when(kind == "slug", d.iso_date(F.col("url"), r"/events/(\d{4}-\d{2}-\d{2})-"))
        .when(kind == "parts", parts).otherwise(by_text)
    )


def _group(text: Column, pattern: Column, group: int) -> Column:
    # the function form takes the pattern from a column
    return F.call_function("regexp_extract", text, F.coalesce(pattern, F.lit(d.ORDINAL)), F.lit(group))


def _named(part: Column, found: Column, name: str) -> Column:
    """Nodes of a class inside the first found node."""
    return once(dom.first(found), lambda node: _of_class(dom.within(part, node), name))


def _of_class(part: Column, name: str) -> Column:
    return F.filter(part, lambda n: F.array_contains(n["classes"], name))


def _classed(part: Column, node: Column, name: str) -> Column:
    """The first node of a class inside a node, with its own inside."""
    return once(dom.first(_of_class(dom.within(part, node), name)), lambda n: dom.within(part, n))


def _month(text: Column) -> Column:
    """A month standing alone, or after its day as in ``14th August``."""
    return once(text, lambda line: F.coalesce(d.month_number(line), d.month_number(F.regexp_extract(line, d.DAY_MONTH, 2))))


def _poster() -> Column:
    """The picture's url by the rule's kind, null without one."""
    kind = F.col("poster_kind")
    attrs = F.coalesce("poster_attrs", F.array(F.lit("src")))
    raw = dom.first(F.filter(F.transform(attrs, lambda name: _attr_of(F.col("poster_nodes"), name)), not_blank))
    in_style = kind.isin("css", "css_thumbnail")
    found = once(raw, lambda value: F.when(in_style, u.css_background(value)).otherwise(_absolute(value, F.col("page_url"))))
    srcset = _attr_of(F.col("poster_nodes"), F.lit("srcset"))
    return once(
        found,
        lambda link: F.when(kind.isin("css_thumbnail", "thumbnail"), u.without_thumbnail_suffix(link))
        .when(kind == "original", u.original_size(link)).when(kind == "imgix", u.imgix_full_width(link))
        .when(kind == "widest", F.coalesce(u.widest_of(srcset), link)).otherwise(F.nullif(link, F.lit(""))),
    )


def dated(cards: DataFrame, base_year: int) -> DataFrame:
    """Complete the dates of venues that print no year, each by its rule, in listing order."""
    printed = cards.where(F.col("year_rule").isNull())
    rules = {"later": later_month, "january": january_after_another}
    completed = [
        running_year(durable(cards.where(F.col("year_rule") == name)), base_year, turns)
        .withColumn("date", d.day_of(F.col("year"), F.col("month"), F.col("day"))).select(*cards.columns)
        for name, turns in rules.items()
    ]
    return reduce(DataFrame.unionByName, completed, printed)


def page_copy(event_pages: DataFrame, rules: DataFrame) -> DataFrame:
    """What each event page says about its gig: ``description`` and ``page_poster``.

    No match is null, which fails the venue; a match that says nothing is ``""``, which does not.
    """
    parsed = attach(with_nodes(event_pages, "body"), rules, ["venue_id"], "inner")
    nodes, r = F.col("nodes"), F.col
    matched = dom.select_any(nodes, r("content"))
    content = F.when(F.coalesce(r("content_first"), F.lit(False)), F.slice(matched, 1, 1)).otherwise(matched)
    rows = parsed.withColumn("content", content)
    content = F.col("content")
    lead_nodes = F.flatten(F.transform(content, lambda c: dom.select_any(dom.subtree(nodes, c), r("lead"), nodes)))
    rows = rows.withColumn("lead_nodes", lead_nodes).withColumn(
        "part", dom.without(nodes, F.concat(dom.select_any(nodes, r("removed")), F.col("lead_nodes")))
    )
    part = F.col("part")
    rows = rows.withColumn("part", F.when(
        r("drop_worded").isNotNull() & r("reading").isNull(),
        dom.without_worded(part, F.filter(part, lambda n: n["tag"] == "p"), r("drop_worded")),
    ).otherwise(part))
    only = dom.first(content)
    pieces = F.when(r("reading") == "children", dom.children(part, only)).when(
        r("reading") == "paragraphs", F.filter(dom.within(part, only), lambda n: n["tag"] == "p")
    )
    rows = rows.withColumn("pieces", pieces)
    pieces = F.col("pieces")
    rows = rows.withColumn("pieces", F.when(r("stop_at").isNotNull(), dom.take_until(pieces, part, r("stop_at"))).otherwise(pieces))
    rows = rows.withColumn("pieces", F.when(r("start_at").isNotNull(), dom.drop_until(pieces, part, F.lit("h3"), r("start_at"))).otherwise(pieces))
    rows = rows.withColumn("pieces", F.when(
        r("drop_worded").isNotNull(), F.filter(pieces, lambda n: ~F.rlike(dom.text_of(dom.within(part, n)), r("drop_worded")))
    ).otherwise(pieces))
    plain = dom.joined_text(content, part)
    read = F.when(r("reading").isNotNull(), F.array_join(dom.texts_of(pieces, part), " ")).otherwise(plain)
    lead = F.coalesce(dom.joined_text(F.col("lead_nodes"), nodes), F.lit(""))
    tail = F.coalesce(dom.joined_text(dom.select_any(nodes, r("tail")), nodes), F.lit(""))
    text = F.trim(F.concat_ws(" ", lead, read, tail))
    with_text = rows.select(
        "venue_id", "url", "blank_is_missing", F.coalesce("reparse", F.lit(False)).alias("reparse"), "literal_attr",
        F.when(F.size("content") > 0, F.when(
            r("literal_attr").isNotNull(), payloads.unquoted_literal(dom.attr(only, r("literal_attr")))
        ).otherwise(text)).alias("text"),
        _absolute(_attr_of(dom.select_any(nodes, r("page_poster")), F.coalesce("page_poster_attr", F.lit("src"))), F.col("url")).alias("page_poster"),
    )
    # markup shown as text, or held in a literal, is read once more
    again = F.col("reparse") | F.col("literal_attr").isNotNull()
    second = dom.html_text(with_text.where(again), "text")
    both = with_text.where(~again).unionByName(second)
    missing = F.coalesce("blank_is_missing", F.lit(False)) & is_blank(F.col("text"))
    return both.select(
        "venue_id", "url", F.when(~missing, F.col("text")).alias("description"), u.first_not_blank(F.col("page_poster")).alias("page_poster")
    )


def with_errors(rows: DataFrame) -> DataFrame:
    """Say what is wrong with each row; the first reason wins. The failures' words are fixed values."""
    prefixes = F.array_join("under", " or ")
    after_gap = F.col("after_gap") if "after_gap" in rows.columns else F.lit(False)
    return rows.withColumn(
        "error",
        F.when(~u.is_under(F.col("url"), F.col("under")), F.concat(F.lit("Gig url "), "url", F.lit(" isn't under "), prefixes))
        .when(after_gap, F.lit("A page of the listing is missing"))
        .when(title_problem(F.col("title")).isNotNull(), F.concat(F.lit("Title refused: "), title_problem(F.col("title"))))
        .when(F.col("date").isNull(), F.concat(F.lit("No date for "), "url"))
        .when(F.col("poster_url").isNull(), F.concat(F.lit("No poster for "), "url"))
        .when(F.col("description").isNull(), F.concat(F.lit("No description found on event page "), "url")),
    )


def html_listing(
    pages: DataFrame, event_pages: DataFrame, cards: DataFrame, copies: DataFrame, base_year: int
) -> DataFrame:
    """Listing rows, each with its ``error`` or null, of all venues read from HTML."""
    found = durable(card_rows(pages, cards))
    once = found.where(~F.coalesce("distinct_links", F.lit(False))).unionByName(
        dedupe_first(found.where(F.coalesce("distinct_links", F.lit(False))), ["venue_id", "url"])
    )
    said = page_copy(event_pages, copies)
    return with_errors(
        dated(once, base_year).join(shuffled(said), ["venue_id", "url"], "left")
        .withColumn("description", F.coalesce("card_copy", "description"))
        .withColumn("poster_url", u.first_not_blank(F.col("poster"), F.col("page_poster"), F.col("house_image")))
    ).select(*LISTING, "error")


def listing_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of venues without an error, and the venues that failed with why."""
    return isolate_failures(durable(rows))
