"""Queries over whole runs: extraction of every page, every listing API, and the daily chain."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from listinglake.catalog.extract import SEARCHED_SQL, calendar_bodies, docs, escaped_text, partner_bodies, search_bodies
from listinglake.catalog.pages import ARTICLE_SQL, shown
from listinglake.catalog.publish import JUDGED_SQL, LOG_STATE, METAL_SQL, TODAY, example_judge, today
from listinglake.catalog.registry import query, with_ctes
from listinglake.operators import api_listing, extraction
from listinglake.plans import classify, render
from listinglake.plans.daily import daily
from listinglake.session import durable, working_folder
from listinglake.skew import with_position
from listinglake.sources import log as log_source
from listinglake.sources import rules
from listinglake.sources import testviews as t

_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
_BASE_YEAR = 2026


def _of(*parts):
    """Parts put together; texts that aren't columns stand for themselves."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# --- pages ------------------------------------------------------------------------------------


def listed_pages(spark, sf):
    """Every page as a venue's listing page of one card, numbered per language; Spanish pages skip a number."""
    n, key = F.length("html"), F.col("page_id").cast("string")
    pages = t.table(spark, sf, "pages").withColumn("venue_id", F.regexp_extract("url", r"^https?://[^/]+/(\w+)", 1))
    numbered = with_position(pages, ["venue_id"], [F.col("page_id")], "place")
    month = F.element_at(F.array(*[F.lit(m) for m in _MONTHS]), (n % 12 + 1).cast("int"))
    on = F.when(n % 7 == 0, "").otherwise(F.date_add(F.lit("2026-01-01").cast("date"), (n % 300).cast("int")).cast("string"))
    picture = F.when(n % 5 == 0, "").otherwise(_of('<img class="pic" src="/p/', key, '.jpg">'))
    card = _of(
        '<time class="on" datetime="', on, '"></time><i class="month">', month, '</i><i class="day">', (n % 28 + 1).cast("string"),
        '</i><a class="more" href="/gig/', key, '">more</a>', picture, "<article>",
    )
    place = F.col("place") - 1
    page_no = place + F.when((F.col("venue_id") == "es") & (place >= 3), 1).otherwise(0)
    return numbered.select(
        "venue_id", "url", page_no.cast("int").alias("page_no"), F.lit(200).alias("status"),
        F.replace("html", F.lit("<article>"), card).alias("body"),
    )


def event_pages(spark, sf):
    """The page of each card's own url, but for every eleventh; a third open with a picture."""
    key = F.col("page_id").cast("string")
    hero = F.when(F.col("page_id") % 3 == 0, _of('<img class="hero" src="/hero/', key, '.jpg">')).otherwise("")
    return t.table(spark, sf, "pages").where(F.col("page_id") % 11 != 0).select(
        F.regexp_extract("url", r"^https?://[^/]+/(\w+)", 1).alias("venue_id"),
        _of(F.regexp_extract("url", r"^(https?://[^/]+)", 1), "/gig/", key).alias("url"),
        F.replace("html", F.lit("<article>"), _of(hero, "<article>")).alias("body"),
    )


def _rules(spark, rows, schema):
    return spark.createDataFrame([rules.rule_row(r, schema) for r in rows], schema)


def listing_rules(spark):
    card = dict(
        base_url="https://example.org/", under=["https://"], cards=[{"tag": "body"}], link=[{"classes": ["more"]}], title=[{"tag": "h1"}],
        poster=[{"classes": ["pic"]}],
    )
    printed = dict(date=[{"classes": ["on"]}], date_attr="datetime", date_kind="iso")
    running = dict(month=[{"classes": ["month"]}], day=[{"classes": ["day"]}], year_rule="later")
    return _rules(spark, [dict(card, venue_id=v, **(running if v == "fr" else printed)) for v in ("en", "de", "es", "fr")], rules.CARD_SCHEMA)


def event_rules(spark):
    rule = dict(content=[{"tag": "article"}], content_first=True, page_poster=[{"classes": ["hero"]}])
    return _rules(spark, [dict(rule, venue_id=v) for v in ("en", "de", "es", "fr")], rules.COPY_SCHEMA)


GIG_PAGES_SQL = rf"""placed AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS site, regexp_extract(url, '^https?://[^/]+/(\w+)', 1) AS venue_id, length(html) AS n,
    {shown("regexp_extract(art, '^<h1>(.*?)</h1>', 1)")} AS title, {shown('art')} AS copy FROM pages JOIN articles USING (page_id, url)),
numbered AS (SELECT *, site || '/gig/' || page_id AS gig_url, row_number() OVER (PARTITION BY venue_id ORDER BY page_id) - 1 AS place,
    coalesce(n % 12 < lag(n % 12) OVER (PARTITION BY venue_id ORDER BY page_id), false) AS turn FROM placed),
cards AS (SELECT *, (place + CASE WHEN venue_id = 'es' AND place >= 3 THEN 1 ELSE 0 END) * 4294967296 AS listing_pos,
    CASE WHEN venue_id = 'fr' THEN make_date({_BASE_YEAR} + CAST(count(*) FILTER (turn) OVER (PARTITION BY venue_id ORDER BY page_id) AS BIGINT), n % 12 + 1, n % 28 + 1)
      WHEN n % 7 <> 0 THEN DATE '2026-01-01' + CAST(n % 300 AS INTEGER) END AS date,
    CASE WHEN n % 5 <> 0 THEN site || '/p/' || page_id || '.jpg' WHEN page_id % 3 = 0 AND page_id % 11 <> 0 THEN site || '/hero/' || page_id || '.jpg' END AS poster_url,
    CASE WHEN page_id % 11 <> 0 THEN copy END AS description FROM numbered)"""


@query("extract_listing", with_ctes(ARTICLE_SQL, GIG_PAGES_SQL, """SELECT venue_id, listing_pos, gig_url AS url, title, date, poster_url, description,
    CASE WHEN site NOT LIKE 'https://%' THEN 'Gig url ' || gig_url || ' isn''t under https://' WHEN venue_id = 'es' AND place = 3 THEN 'A page of the listing is missing'
      WHEN title = '' THEN 'Title refused: blank' WHEN date IS NULL THEN 'No date for ' || gig_url WHEN poster_url IS NULL THEN 'No poster for ' || gig_url
      WHEN description IS NULL THEN 'No description found on event page ' || gig_url END AS error FROM cards"""))
def extract_listing(spark, sf):
    """Pages to listing rows: order, dates printed and counted on, pictures and copy off the event pages, and what is wrong."""
    return extraction.html_listing(listed_pages(spark, sf), event_pages(spark, sf), listing_rules(spark), event_rules(spark), _BASE_YEAR)


# --- listing APIs -----------------------------------------------------------------------------


def _under(venues, prefix):
    return durable(venues.distinct().select("venue_id", F.array(prefix).alias("under")))


@query("api_search_rows", with_ctes(SEARCHED_SQL, r"""listed AS (SELECT *, 'https://www.ticketmaster.co.uk/e/' || doc_id AS url, CASE WHEN n_chars % 2 = 0 THEN 'https://img.example.org/x.jpg'
      WHEN n_chars % 3 <> 0 THEN 'https://www.academymusicgroup.com/hero/' || doc_id || '.jpg' END AS poster_url FROM searched WHERE item_no = 0 OR n_chars % 4 <> 0)
  SELECT venue_id, doc_id * 4294967296 + item_no AS listing_pos, url, 'Event ' || (item_no + 1) || ' ' || lang AS title, DATE '2026-01-01' + CAST(n_chars % 300 AS INTEGER) AS date, poster_url,
    CASE WHEN item_no = 1 OR n_chars % 3 <> 2 THEN 'Lineup: Act 1 of ' || source || ', Act 2 of ' || source || '. Genre: ' || lang || '.' ELSE trim(regexp_replace('Hi & ' || text, '[\s\x{a0}]+', ' ', 'g')) END AS description,
    CASE WHEN source LIKE '%1' THEN 'Gig url ' || url || ' isn''t under https://www.gigantic.com/' WHEN poster_url IS NULL THEN 'No poster for ' || url END AS error FROM listed
  UNION ALL SELECT DISTINCT 'quiet-' || lang, NULL, NULL, NULL, NULL, NULL, NULL, 'No events returned' FROM documents"""))
def api_search_rows(spark, sf):
    """Search answers whose missing pictures come off event pages; some venues answer nothing, some link elsewhere."""
    key = F.col("doc_id").cast("string")
    bodies = search_bodies(spark, sf).select("venue_id", F.col("doc_id").alias("page_no"), "body")
    quiet = docs(spark, sf).select(_of("quiet-", F.col("lang")).alias("venue_id"), F.lit(0).cast("bigint").alias("page_no"), F.lit('{"documents":[]}').alias("body")).distinct()
    hero = F.when(F.col("n_chars") % 3 != 0, _of('<img sizes="100vw" src="/hero/', key, '.jpg?w=9">')).otherwise("")
    opened = docs(spark, sf).select(
        F.col("source").alias("venue_id"), _of("https://www.academymusicgroup.com/", F.col("source"), "/events/event-tickets-aea1-", key).alias("url"),
        _of("<p>", escaped_text(), "</p>", hero).alias("body"),
    )
    prefix = F.when(F.col("venue_id").endswith("1"), "https://www.gigantic.com/").otherwise("https://www.ticketmaster.co.uk/e/")
    return api_listing.search_rows(bodies.unionByName(quiet), opened, _under(bodies.select("venue_id"), prefix))


@query("api_partner_rows", """WITH listed AS (SELECT *, CASE event_id % 4 WHEN 0 THEN 'https://dice.fm/event/moved-' || event_id WHEN 2 THEN 'https://dice.fm/event/gig-' || event_id ELSE '' END AS url FROM events)
  SELECT 'v' || user_id AS venue_id, event_id * 4294967296 AS listing_pos, url, 'Gig ' || event_type || CASE WHEN event_type = 'error' THEN ' - CANCELLED' ELSE '' END AS title,
    CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE CASE WHEN user_id % 2 = 0 THEN 'Europe/London' ELSE 'America/New_York' END AS DATE) AS date, 'https://img.example.org/' || user_id AS poster_url,
    'copy' AS description, CASE WHEN url = '' THEN 'Gig url  isn''t under https://dice.fm/event/' END AS error FROM listed
  UNION ALL SELECT DISTINCT 'quiet-v' || user_id, NULL, NULL, NULL, NULL, NULL, NULL, 'No events returned' FROM events""")
def api_partner_rows(spark, sf):
    """Partner answers keyed by what each event's url answers: its new place, a strange one, itself, or nothing."""
    key, kind = F.col("event_id").cast("string"), F.col("event_id") % 4
    bodies = partner_bodies(spark, sf, "event_id").withColumnRenamed("event_id", "page_no")
    quiet = bodies.select(_of("quiet-", F.col("venue_id")).alias("venue_id")).distinct().select(
        "venue_id", F.lit(0).cast("bigint").alias("page_no"), F.lit('{"data":[],"links":{"next":null}}').alias("body"))
    answers = t.table(spark, sf, "events").select(
        _of("https://dice.fm/event/gig-", key).alias("url"), F.when(kind == 0, 301).when(kind == 1, 302).when(kind == 2, 200).otherwise(404).alias("status"),
        F.when(kind == 0, _of("https://dice.fm/event/moved-", key)).when(kind == 1, "https://elsewhere.example.org/").alias("location"),
    )
    return api_listing.partner_rows(bodies.unionByName(quiet), answers, _under(bodies.select("venue_id"), F.lit("https://dice.fm/event/")))


@query("api_calendar_rows", """WITH listed AS (SELECT *, unnest([0, 1]) AS item_no FROM orders),
  music AS (SELECT *, 'https://www.ovoarena.co.uk/events/detail/' || o_custkey || '#' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS url, o_orderkey * 4294967296 + item_no AS listing_pos
    FROM listed WHERE item_no = 0 OR starts_with(o_orderpriority, '1') QUALIFY row_number() OVER (PARTITION BY url ORDER BY listing_pos) = 1),
  told AS (SELECT m.*, CASE WHEN o_orderstatus <> 'F' THEN 'https://img.example.org/' || o_orderkey || '.jpg' END AS poster_url, CASE WHEN c_custkey % 7 <> 0 THEN 'Meet ' || c_name || ' ' || c_mktsegment END AS description
    FROM music m LEFT JOIN customer ON c_custkey = o_custkey)
  SELECT 'ovo-arena' AS venue_id, listing_pos, url, 'Order ' || o_orderkey AS title, CAST(o_orderdate AS DATE) AS date, poster_url, description,
    CASE WHEN poster_url IS NULL THEN 'No poster for ' || url WHEN description IS NULL THEN 'No description found on event page ' || url END AS error FROM told
  UNION ALL SELECT DISTINCT 'broken-' || o_orderstatus, NULL, NULL, NULL, NULL, NULL, NULL, 'Answer is not the JSON expected' FROM orders""")
def api_calendar_rows(spark, sf):
    """Calendars: music only, the first of each page and night, copy off the event's page; some answers are no JSON."""
    bodies = calendar_bodies(spark, sf).select("venue_id", F.col("o_orderkey").alias("page_no"), "body")
    broken = t.table(spark, sf, "orders").select(_of("broken-", F.col("o_orderstatus")).alias("venue_id"), F.lit(0).cast("bigint").alias("page_no"), F.lit("<html>").alias("body")).distinct()
    told = F.when(F.col("c_custkey") % 7 != 0, _of('<div class="event_description"><p>Meet ', F.col("c_name"), "</p><p>", F.col("c_mktsegment"), "</p></div>")).otherwise("<div></div>")
    opened = t.table(spark, sf, "customer").select(
        F.lit("ovo-arena").alias("venue_id"), _of("https://www.ovoarena.co.uk/events/detail/", F.col("c_custkey").cast("string")).alias("url"), told.alias("body"))
    return api_listing.calendar_rows(bodies.unionByName(broken), opened, rules.api_rules(spark), rules.copy_rules(spark))


# --- the daily chain --------------------------------------------------------------------------


@query("daily", with_ctes(*LOG_STATE, METAL_SQL, JUDGED_SQL, """added AS (SELECT 'classified' AS _type, count(*) FILTER (NOT failed) AS n FROM judged UNION ALL SELECT 'rendered', 1),
  counted AS (SELECT _type, count(*) AS n FROM log GROUP BY _type),
  state AS (SELECT _type, coalesce(c.n, 0) + coalesce(a.n, 0) AS n FROM counted c FULL JOIN added a USING (_type) WHERE coalesce(c.n, 0) + coalesce(a.n, 0) > 0)
  SELECT turn, turn = 1 AS ran, _type, n, (SELECT max(seq) FROM log) + (SELECT sum(n) FROM added) AS last_seq FROM state, (SELECT unnest([1, 2]) AS turn)""", recursive=True))
def daily_twice(spark, sf):
    """Classify and render the whole log as one day's chain, then again: the second call finds the day rendered."""
    path = f"{working_folder(spark)}/daily-{uuid.uuid4().hex}"
    log_source.write_log(t.log(spark, sf), path)
    at = F.lit(f"{TODAY} 06:00:00").cast("timestamp_ntz")

    def classified():
        log = log_source.read_log(spark, path)
        log_source.append(log, classify.classify(log, example_judge, at).entries, path)

    def rendered():
        log = log_source.read_log(spark, path)
        images = spark.createDataFrame([], "file string")
        log_source.append(log, render.render(log, today(), at, path + "-archive", images, force=True).entries, path)

    turns = []
    for turn in (1, 2):
        ran = daily(log_source.read_log(spark, path), TODAY, [classified, rendered])
        counted = durable(log_source.read_log(spark, path).groupBy("_type").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last")))
        last = counted.agg(F.max("last")).first()[0]
        turns.append(counted.select(F.lit(turn).alias("turn"), F.lit(ran).alias("ran"), "_type", "n", F.lit(last).cast("bigint").alias("last_seq")))
    return turns[0].unionByName(turns[1])
