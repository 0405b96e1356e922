"""What to read from each venue's pages: one row per source, joined to its pages by broadcast.

All values here are fixed values. A selector is a dict of the parts in ``operators.dom``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listinglake.operators.dom import SELECTOR

_PARTS = ["tag", "classes", "id", "attr", "equals", "part", "without", "in_tag", "in_class", "in_id"]


def _class(*names: str, **more) -> dict:
    return {"classes": list(names), **more}


def _inside(css_class: str, tag: str, **more) -> dict:
    return {"tag": tag, "in_class": css_class, **more}


# --- listings ---------------------------------------------------------------------------------

CARD_SCHEMA = (
    f"venue_id string, base_url string, under array<string>, cards array<{SELECTOR}>, card_has {SELECTOR}, "
    f"must_hold array<{SELECTOR}>, link array<{SELECTOR}>, link_has {SELECTOR}, link_fallback array<{SELECTOR}>, "
    f"title array<{SELECTOR}>, title_first boolean, tidy_title boolean, "
    f"date array<{SELECTOR}>, date_attr string, date_kind string, date_pattern string, century int, "
    f"month array<{SELECTOR}>, day array<{SELECTOR}>, year_rule string, "
    f"poster array<{SELECTOR}>, poster_attrs array<string>, poster_kind string, house_image string, "
    f"card_copy array<{SELECTOR}>, distinct_links boolean"
)


def _squarespace(venue_id: str, url: str, **more) -> dict:
    title = _class("eventlist-title-link")
    return dict(
        venue_id=venue_id, base_url=url, under=[url + "/"], cards=[_class("eventlist-event--upcoming", tag="article")],
        link=[title], title=[title], date=[_class("event-date", tag="time")], date_attr="datetime", date_kind="iso",
        poster=[_inside("eventlist-column-thumbnail", "img")], poster_attrs=["src", "data-image"], **more,
    )


def _month_guide(venue_id: str, url: str, site: str, house_image: str | None = None) -> dict:
    heading = _class("card__heading")
    return dict(
        venue_id=venue_id, base_url=url, under=[site + "/gigs/"], cards=[_class("card", "card--full")], link=[heading],
        link_fallback=[_inside("card__notification", "a")], title=[heading], date=[_class("card__strip-heading")],
        date_kind="printed", date_pattern=r"\w{3}\.(\d{2})\.(\w{3})\.(\d{2})", century=2000,
        poster=[_inside("card__grid-media", "img")], poster_attrs=["data-lazy-src", "src"], house_image=house_image,
    )


def _arena(venue_id: str) -> dict:
    site = "https://www.theo2.co.uk/"
    return dict(
        venue_id=venue_id, base_url=site, under=[site + "events/detail/"], cards=[_class("eventItem")],
        link=[_inside("title", "a")], title=[_inside("title", "a")], date=[_class("date")], date_kind="parts",
        poster=[_class("square", tag="img", in_class="thumb")],
    )


CARD_RULES = [
    _squarespace("black-heart", "https://www.ourblackheart.com/events"),
    _squarespace("dome", "https://www.domelondon.co.uk/whatson"),
    _squarespace("fiddlers-elbow", "https://www.thefiddlerselbow.co.uk/whos-playing", card_copy=[_class("eventlist-excerpt")]),
    _month_guide("the-garage", "https://www.thegarage.london/live/", "https://www.thegarage.london",
                 "https://www.thegarage.london/wp-content/uploads/2020/03/gigs-front@3x.jpg"),
    _month_guide("the-grace", "https://www.thegrace.london/whats-on/", "https://www.thegrace.london"),
    _arena("indigo-at-the-o2"),
    _arena("the-o2-arena"),
    dict(venue_id="new-cross-inn", base_url="https://www.newcrossinn.com/gigs/", under=["https://pit.live/events/"],
         cards=[{"tag": "li"}], card_has=_class("nci-event-name", tag="h3"), link=[{"tag": "a"}],
         link_has=_class("nci-event-name", tag="h3"), title=[_class("nci-event-name", tag="h3")], date=[{"tag": "dd"}],
         date_kind="printed", date_pattern=r"(\d{2}) (\w{3}) (\d{4})", poster=[{"tag": "img"}], distinct_links=True),
    dict(venue_id="cart-and-horses", base_url="https://www.cartandhorses.london/news-offers-events/",
         under=["https://www.cartandhorses.london/"], cards=[_class("news-carousel__item")],
         must_hold=[_class("news-carousel__date-wrap")], link=[_class("news-carousel__link")],
         title=[_class("news-carousel__link")], month=[_class("news-carousel__month")], day=[_class("news-carousel__day")],
         year_rule="january", poster=[_class("news-carousel__image")]),
    dict(venue_id="electric-ballroom", base_url="https://electricballroom.co.uk/whats-on/",
         under=["https://electricballroom.co.uk/"], cards=[_class("grid-block", "card")], link=[_inside("event-name", "a")],
         title=[_inside("event-name", "a")], month=[_class("event-date")], day=[_class("event-date")], year_rule="later",
         poster=[_class("grid-image")], poster_attrs=["style"], poster_kind="css"),
    dict(venue_id="electric-brixton", base_url="https://www.electricbrixton.uk.com/events/",
         under=["https://www.electricbrixton.uk.com/events/"], cards=[_class("fl-post-grid-post")],
         link=[_inside("event-title", "a")], title=[_inside("event-title", "a")], date=[_class("event-date")],
         date_kind="printed", poster=[_inside("uabb-post-thumbnail", "img")]),
    dict(venue_id="islington-assembly-hall", base_url="https://islingtonassemblyhall.co.uk/events/",
         under=["https://islingtonassemblyhall.co.uk/events/"], cards=[_class("event__item", tag="li")],
         link=[_class("event__item__title", tag="a")], title=[_class("event__item__title", tag="a")],
         month=[_class("event__item__date__month")], day=[_class("event__item__date__numeric")], year_rule="later",
         poster=[_class("event__item__background", tag="a")], poster_attrs=["data-src"], poster_kind="thumbnail"),
    dict(venue_id="scala", base_url="https://scala.co.uk/events/categories/live-music/", under=["https://scala.co.uk/events/"],
         cards=[_class("tb-event-item")], link=[{"tag": "a", "in_tag": "h2"}], title=[{"tag": "a", "in_tag": "h2"}],
         date=[_class("date")], date_kind="printed", poster=[_class("tb-event-feature-pic")], poster_attrs=["style"],
         poster_kind="css"),
    dict(venue_id="windmill-brixton", base_url="https://www.windmillbrixton.co.uk/listings/categories/all/",
         under=["https://www.windmillbrixton.co.uk/events/"], cards=[_class("EventLink", tag="a")],
         link=[_class("EventLink", tag="a")], title=[_class("title", "name")], date_kind="slug",
         date_pattern=r"/events/(\d{4}-\d{2}-\d{2})-", poster=[_inside("Image-wrap", "img")], poster_kind="original"),
    dict(venue_id="union-chapel", base_url="https://unionchapel.org.uk/whats-on", under=["https://unionchapel.org.uk/whats-on/"],
         cards=[_class("item", attr="data-chron")], link=[{"tag": "a", "attr": "href", "part": "/whats-on/"}],
         title=[_class("card-title")], title_first=True, date=[_class("item", attr="data-chron")], date_attr="data-chron",
         date_kind="iso", poster=[_class("card-image")], poster_attrs=["style"], poster_kind="css"),
    dict(venue_id="alexandra-palace", base_url="https://www.alexandrapalace.com/whats-on/",
         under=["https://www.alexandrapalace.com/whats-on/"], cards=[_class("event_card_wrapper")], link=[_class("event_target")],
         title=[_class("event_target")], tidy_title=True, date=[_class("dates")], date_kind="range",
         poster=[_inside("event_img", "img")], poster_kind="widest"),
    dict(venue_id="eventim-apollo", base_url="https://www.eventimapollo.com/events/", under=["https://www.eventimapollo.com/events/"],
         cards=[_class("search-item")], link=[_class("cover-link", tag="a")], title=[_class("card__title")], tidy_title=True,
         date=[_class("date", tag="p")], date_kind="month_first_range", poster=[_inside("card__image", "img")]),
    dict(venue_id="dingwalls", base_url="https://dingwalls.com/whats-on/", under=["https://dingwalls.com/gig/"], cards=[_class("gig")],
         link=[_inside("elementor-widget-theme-post-title", "a")], title=[_inside("elementor-widget-theme-post-title", "a")],
         date=[_class("elementor-widget-heading", without="elementor-widget-theme-post-title")], date_kind="printed",
         poster=[_inside("elementor-widget-theme-post-featured-image", "img")]),
    dict(venue_id="roundhouse", base_url="https://www.roundhouse.org.uk/whats-on/?type=event",
         under=["https://www.roundhouse.org.uk/whats-on/"], cards=[_class("event-card")], link=[_class("event-card__link")],
         title=[_class("event-card__title")], date=[_class("event-card__date")], date_kind="printed",
         date_pattern=r"(\d{1,2}) (\w{3}) (\d{2})", century=2000, poster=[_inside("event-card__image", "img")]),
    dict(venue_id="paper-dress-vintage", base_url="https://paperdressvintage.co.uk/by-night",
         under=["https://paperdressvintage.co.uk/"], cards=[_class("events__event")], link=[_class("events__event")],
         title=[{"tag": "h4"}], date=[_class("margin__bottom--1", tag="p")], date_attr="data-event-month", date_kind="block",
         date_pattern=r"\w{3}\s+(\d{1,2})\s+\w{3}", poster=[_class("event__poster")], poster_attrs=["style"], poster_kind="css_thumbnail"),
    dict(venue_id="underworld", base_url="https://www.theunderworldcamden.co.uk/search-events/",
         under=["https://www.theunderworldcamden.co.uk/event/"], cards=[_class("list", tag="article", in_id="gigs")],
         link=[_inside("list-header-title", "a")], title=[_class("list-header-title")], date=[{"tag": "time"}],
         date_attr="datetime", date_kind="iso", poster=[_inside("list-image", "img")], poster_kind="imgix"),
]

# --- event pages ------------------------------------------------------------------------------

COPY_SCHEMA = (
    f"venue_id string, content array<{SELECTOR}>, content_first boolean, literal_attr string, reading string, "
    f"removed array<{SELECTOR}>, lead array<{SELECTOR}>, tail array<{SELECTOR}>, drop_worded string, stop_at string, "
    f"start_at string, blank_is_missing boolean, reparse boolean, page_poster array<{SELECTOR}>, page_poster_attr string"
)


def _page_copy(venue_ids: list[str], content: list[dict], **more) -> list[dict]:
    return [dict(venue_id=v, content=content, **more) for v in venue_ids]


COPY_RULES = [
    *_page_copy(["black-heart", "dome"], [_class("eventitem-column-content")], reparse=True),
    *_page_copy(
        ["the-garage", "the-grace"], [_class("single-article__content", in_class="single-article--contains-list")],
        content_first=True, reading="children", drop_worded=r"(?i)for more events|check out what.s on here",
        blank_is_missing=True, page_poster=[_class("article-image__bg", tag="img")], page_poster_attr="data-lazy-src",
    ),
    *_page_copy(["indigo-at-the-o2", "the-o2-arena", "ovo-arena"], [_class("event_description")]),
    *_page_copy(["new-cross-inn"], [{"attr": "x-ref", "equals": "desc"}], content_first=True, literal_attr="x-html", blank_is_missing=True),
    *_page_copy(["cart-and-horses"], [_class("page_header"), _class("page_content_inner")]),
    *_page_copy(
        ["electric-ballroom"], [_class("article-content")], content_first=True, blank_is_missing=True,
        drop_worded=r"(?i)please note this show is|strictly \d+\+|proof of age|photo id",
    ),
    *_page_copy(["electric-brixton"], [_class("event-context")]),
    *_page_copy(
        ["islington-assembly-hall"], [_class("event__description")], content_first=True, reading="paragraphs", blank_is_missing=True,
        drop_worded=r"(?i)by purchasing a ticket to this event|subject to a venue levy|^\*?this is an? \d+\+ event",
    ),
    *_page_copy(
        ["scala"], [_class("entry-content", in_class="event-post")], content_first=True, reading="children", blank_is_missing=True,
        removed=[_class("event-date", tag="p"), _class("age-restrictions", tag="p"), _class("event-time", tag="p"),
                 _class("guide-to", tag="p"), _class("add-calendar", tag="p"), _class("button"), _class("left-morebox"),
                 _class("right-morebox")],
        lead=[_class("tb-event-headerbox")], start_at="(?i)^about",
    ),
    *_page_copy(["windmill-brixton"], [_class("EventDetailDescription")]),
    *_page_copy(
        ["union-chapel"], [_class("pt-4", tag="article")], content_first=True, reading="children", blank_is_missing=True,
        stop_at="(?i)^(book for a pre-show dinner|more information|for accessibility|the venue is seating only)",
        drop_worded="(?i)book now button above|set ticket reminder|scroll down for info on reserving", tail=[_class("sidebar")],
    ),
    *_page_copy(["alexandra-palace"], [_class("ap_text_block"), {"id": "key-information"}]),
    *_page_copy(["eventim-apollo"], [_class("variable-color", "mt-sm", in_class="event-hero")]),
    *_page_copy(["dingwalls"], [_class("elementor-location-single")]),
    *_page_copy(
        ["roundhouse"], [_class("event-hero__heading-wrapper"), _class("event-about", tag="section")],
        removed=[_class("layout-block--related-events-list"), _class("layout-block--event-listing-card")],
    ),
    *_page_copy(["paper-dress-vintage"], [_class("event__content")]),
    *_page_copy(
        ["underworld"], [_class("event", tag="article")], content_first=True, blank_is_missing=True, removed=[{"tag": "footer"}],
        drop_worded=r"(?i:^this (is|event is) an? \d+\+ event)|carry PHOTO ID",
    ),
]

# --- listing APIs -----------------------------------------------------------------------------

API_SCHEMA = "venue_id string, api string, under array<string>"
_SEARCH = ["o2-forum-kentish-town", "o2-academy-brixton", "o2-academy-islington", "o2-shepherds-bush-empire"]
_PARTNER = [
    "229", "signature-brew-haggerston", "signature-brew-blackhorse-road", "blondies-taproom", "blondies-bar", "helgis", "barfly",
]
API_RULES = (
    [(v, "search", ["https://www.ticketmaster.co.uk/", "http://www.ticketmaster.co.uk/", "https://www.gigantic.com/"]) for v in _SEARCH]
    + [(v, "partner", ["https://dice.fm/event/"]) for v in _PARTNER]
    + [("ovo-arena", "calendar", ["https://www.ovoarena.co.uk/events/detail/"])]
)


def rule_row(rule: dict, schema: str) -> tuple:
    """A rule in schema order, its selectors completed with nulls."""
    full = lambda s: tuple(s.get(p) for p in _PARTS)

    def value(name: str, plain: bool):
        found = rule.get(name)
        if found is None or plain:
            return found
        return full(found) if isinstance(found, dict) else [full(s) for s in found]

    return tuple(value(f.name, "struct" not in f.dataType.simpleString()) for f in _fields(schema))


def _fields(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


def card_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([rule_row(r, CARD_SCHEMA) for r in CARD_RULES], CARD_SCHEMA)


def copy_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([rule_row(r, COPY_SCHEMA) for r in COPY_RULES], COPY_SCHEMA)


def api_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(API_RULES, API_SCHEMA)
