"""Queries over classification, posters, reports and the published list."""

from __future__ import annotations

import re
import uuid
from functools import partial, reduce

from pyspark.sql import DataFrame, functions as F

from listinglake.catalog.logs import CURRENT_SQL, EDGES_SQL, OWN_SQL, STATUS_SQL, VENUES_SQL, walk_sql
from listinglake.catalog.quality import GATE_SQL, UNITS, batch_of
from listinglake.catalog.registry import query, with_ctes
from listinglake.classify_rates import TEXT_MODEL, VISION_MODEL
from listinglake.functions import urls
from listinglake.functions.text import slug
from listinglake.model import KEY
from listinglake.operators import classification as c, finder, posters, projections as p, publishing as pub, report
from listinglake.operators.as_of import last_known
from listinglake.operators.quality import gate
from listinglake.session import durable, side_by_side, working_folder
from listinglake.sources import published
from listinglake.sources import testviews as t

TODAY = "2024-06-01"
ON_PAGE = f"date BETWEEN DATE '{TODAY}' AND CAST(DATE '{TODAY}' + INTERVAL 1 YEAR AS DATE)"
FIRST_SQL = "firsts AS (SELECT venue_id, url, min(seq) AS first_seq FROM log WHERE _type = 'observed' GROUP BY 1, 2)"
METAL_SQL = "metal AS (SELECT c.*, f.first_seq FROM current c JOIN firsts f USING (venue_id, url) SEMI JOIN (SELECT venue_id, url FROM status WHERE genre = 'Metal') s USING (venue_id, url))"
IMAGE = "CAST(date AS VARCHAR) || '-' || venue_id || '-' || left(sha256(poster_url), 8) || '.webp'"
PAGE_SQL = f"page AS (SELECT date, title, venue, url, 'images/' || {IMAGE} AS image_url, venue_id, poster_url, first_seq FROM metal JOIN venues USING (venue_id) WHERE {ON_PAGE})"
LOG_STATE = [t.LOG_SQL, CURRENT_SQL, STATUS_SQL, FIRST_SQL, VENUES_SQL]


def _rec(*parts: str) -> str:
    return with_ctes(*parts, recursive=True)


def today():
    return F.lit(TODAY).cast("date")


def gigs_with_status(spark, sf):
    entries = t.log(spark, sf)
    return p.with_status(p.current_gigs(entries), p.class_status(entries))


# --- classification ---------------------------------------------------------------------------

_PENDING_ROWS = """FROM current c JOIN firsts f USING (venue_id, url)
  WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.venue_id = c.venue_id AND o.url = c.url)
    AND NOT EXISTS (SELECT 1 FROM taken o WHERE o.venue_id = c.venue_id AND o.url = c.url)"""
_SETTLED = [t.LOG_SQL, CURRENT_SQL, FIRST_SQL, OWN_SQL, EDGES_SQL, walk_sql("own", "taken")]


@query("to_classify", _rec(*_SETTLED, f"SELECT c.venue_id, c.url, c.date {_PENDING_ROWS}"))
def to_classify(spark, sf):
    entries = t.log(spark, sf)
    return c.to_classify(p.current_gigs(entries), p.already_classified(entries)).select(*KEY, "date")


@query("to_classify_soonest", _rec(*_SETTLED, f"SELECT c.venue_id, c.url, c.date {_PENDING_ROWS} ORDER BY c.date, f.first_seq LIMIT 100"))
def to_classify_soonest(spark, sf):
    """The hundred gigs a run limited to that many would take."""
    entries = t.log(spark, sf)
    return c.to_classify(p.current_gigs(entries), p.already_classified(entries), limit=100).select(*KEY, "date")


VISION = f"{UNITS.format('description')} < 80"
ROUTED_SQL = f"""routed AS (SELECT venue_id, url, {VISION} AS use_vision, CASE WHEN {VISION} THEN '{VISION_MODEL}' ELSE '{TEXT_MODEL}' END AS llm_model,
    'Title: ' || title || chr(10) || chr(10) || 'Event page text: ' || description AS prompt FROM listing)"""


@query("route", with_ctes(t.LISTING_SQL, ROUTED_SQL, "SELECT llm_model, use_vision, count(*) AS n FROM routed GROUP BY ALL"))
def route(spark, sf):
    return c.routed(t.listing(spark, sf)).groupBy("llm_model", "use_vision").agg(F.count(F.lit(1)).alias("n"))


@query("prompt", with_ctes(t.LISTING_SQL, ROUTED_SQL, "SELECT venue_id, url, md5(prompt) AS prompt_md5, length(prompt) AS chars FROM routed"))
def prompt(spark, sf):
    return c.routed(t.listing(spark, sf)).select(*KEY, F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("chars"))


def example_judge(row: dict) -> tuple[str, int | None, int | None]:
    """Stands in for a model: answers by the prompt's length, and fails on some."""
    n = len(row["prompt"])
    if n % 5 == 0:
        raise ValueError("poster too large")
    reply = ("Metal.", "I can't say who is pictured.\n\nOther\n", "  metal!  ", "Not metal")[n % 4]
    return reply, (n if n % 3 else None), 5


SCORED_SQL = """replies AS (SELECT venue_id, url, length(prompt) AS n, llm_model, use_vision FROM routed),
scored AS (SELECT *, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 4 IN (0, 2) THEN 'Metal' WHEN n % 4 = 1 THEN 'Other' END AS genre,
    CASE WHEN n % 5 <> 0 AND n % 3 <> 0 THEN n END AS input_tokens, CASE WHEN n % 5 <> 0 THEN 5 END AS output_tokens,
    CASE WHEN n % 5 = 0 THEN 'poster too large' WHEN n % 4 = 3 THEN 'Unexpected reply: "Not metal"' END AS error FROM replies)"""


@query("score", with_ctes(t.LISTING_SQL, ROUTED_SQL, SCORED_SQL, "SELECT venue_id, url, genre, input_tokens, output_tokens, error FROM scored"))
def score(spark, sf):
    found = c.outcomes(c.score(c.routed(t.listing(spark, sf)), example_judge))
    return found.select(*KEY, "genre", "input_tokens", "output_tokens", "error")


_ANSWERED = """replies AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN text || chr(10) || 'Metal.' WHEN 1 THEN text || chr(10) || ' OTHER! ' || chr(10) || ' '
    WHEN 2 THEN 'metal' WHEN 3 THEN text WHEN 4 THEN 'Metal' || chr(10) || text ELSE text || ' Other' END AS reply FROM conversations)"""
_LAST_LINE = r"list_last(list_filter(string_split_regex(reply, '\r\n|\n|\r'), lambda l: regexp_matches(l, '[^\s\x0b\p{Z}\x1c-\x1f\x{85}]')))"


@query("parse_reply", with_ctes(_ANSWERED, rf"""last_lines AS (SELECT conv_id, turn, lower(regexp_replace(regexp_replace({_LAST_LINE}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '[.!]+$', '')) AS answer FROM replies)
  SELECT conv_id, turn, CASE answer WHEN 'metal' THEN 'Metal' WHEN 'other' THEN 'Other' END AS genre FROM last_lines"""))
def parse_reply(spark, sf):
    """Replies made of every conversation turn, with the verdict before, after, or beside its text."""
    text, kind = F.col("text"), F.col("turn") % 6
    line = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    reply = (
        F.when(kind == 0, line(text, "\nMetal.")).when(kind == 1, line(text, "\n OTHER! \n "))
        .when(kind == 2, F.lit("metal")).when(kind == 3, text).when(kind == 4, line("Metal\n", text)).otherwise(line(text, " Other"))
    )
    return t.table(spark, sf, "conversations").select("conv_id", "turn", c.genre_of(reply).alias("genre"))


COST_SQL = f"""priced AS (SELECT *, CASE WHEN llm_model = '{TEXT_MODEL}' THEN input_tokens / 1e6 * 1.0 + output_tokens / 1e6 * 5.0
    WHEN llm_model = '{VISION_MODEL}' AND recorded_at < TIMESTAMP '2026-09-01' THEN input_tokens / 1e6 * 2.0 + output_tokens / 1e6 * 10.0
    WHEN llm_model = '{VISION_MODEL}' THEN input_tokens / 1e6 * 3.0 + output_tokens / 1e6 * 15.0 END AS cost FROM verdicts)"""


@query("llm_cost", with_ctes(t.VERDICTS_SQL, COST_SQL, "SELECT seq, llm_model, round(cost, 9) AS cost FROM priced"))
def llm_cost(spark, sf):
    return c.with_cost(t.verdicts(spark, sf)).select("seq", "llm_model", F.round("cost", 9).alias("cost"))


# Rates by model and day of order, some of them over the day they start; judged on days across the same years.
_DAILY_SQL = f"""daily AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN '{VISION_MODEL}' ELSE '{TEXT_MODEL}' END AS model, CAST(o_orderdate AS DATE) AS valid_from, count(*) AS n, max(o_orderkey % 100) AS m FROM orders GROUP BY 1, 2),
  day_rates AS (SELECT model, valid_from, CASE WHEN n % 3 < 2 THEN valid_from + CAST(n % 3 AS INTEGER) END AS valid_to, CAST(n AS DOUBLE) AS in_per_m, CAST(m AS DOUBLE) AS out_per_m FROM daily),
  judged AS (SELECT seq, llm_model, input_tokens, output_tokens, DATE '1994-12-01' + CAST(seq % 2500 AS INTEGER) AS day FROM verdicts)"""


@query("llm_cost_as_of", with_ctes(t.VERDICTS_SQL, _DAILY_SQL, """SELECT seq, llm_model, CASE WHEN valid_to IS NULL OR day < valid_to THEN round(input_tokens / 1e6 * in_per_m + output_tokens / 1e6 * out_per_m, 9) END AS cost
  FROM judged ASOF LEFT JOIN day_rates ON llm_model = model AND day >= valid_from"""))
def llm_cost_as_of(spark, sf):
    """Verdicts priced by thousands of daily rates."""
    model = F.when(F.col("o_custkey") % 2 == 0, VISION_MODEL).otherwise(TEXT_MODEL)
    daily = t.table(spark, sf, "orders").groupBy(model.alias("model"), F.col("o_orderdate").cast("date").alias("valid_from")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("o_orderkey") % 100).alias("m")
    )
    ends = F.when(F.col("n") % 3 < 2, F.date_add("valid_from", (F.col("n") % 3).cast("int")))
    day_rates = daily.select("model", "valid_from", ends.alias("valid_to"), F.col("n").cast("double").alias("in_per_m"), F.col("m").cast("double").alias("out_per_m"))
    at = F.date_add(F.lit("1994-12-01").cast("date"), (F.col("seq") % 2500).cast("int"))
    judged = t.verdicts(spark, sf).withColumn("recorded_at", at.cast("timestamp_ntz"))
    return c.with_cost_as_of(judged, day_rates).select("seq", "llm_model", F.round("cost", 9).alias("cost"))


@query("last_order_before", """WITH ordered AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2)
  SELECT l_orderkey, l_linenumber, b.o_orderkey AS previous_order FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey ASOF LEFT JOIN ordered b ON o.o_custkey = b.o_custkey AND o.o_orderdate > b.o_orderdate""")
def last_order_before(spark, sf):
    """For every line its customer's order of a day before."""
    orders = t.table(spark, sf, "orders")
    of = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("day"))
    lines = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(of, "l_orderkey")
    found = last_known(lines, orders, [("customer", "o_custkey")], "day", "o_orderdate", ["o_orderkey"], before=True)
    return found.select("l_orderkey", "l_linenumber", F.col("o_orderkey").alias("previous_order"))


@query("cost_report", with_ctes(t.VERDICTS_SQL, COST_SQL, """SELECT coalesce(path, 'total') AS path, count(*) AS n, coalesce(sum(input_tokens), 0) AS input_tokens,
    coalesce(sum(output_tokens), 0) AS output_tokens, count(*) FILTER (cost IS NULL) AS unpriced, printf('$%.4f', coalesce(sum(cost), 0)) AS dollars
  FROM (SELECT *, CASE WHEN use_vision THEN 'vision' ELSE 'text' END AS path FROM priced) GROUP BY ROLLUP (path)"""))
def cost_report(spark, sf):
    return c.cost_report(t.verdicts(spark, sf))


JUDGED_SQL = """outcome AS (SELECT venue_id, url, length('Title: ' || title || 'xx' || 'Event page text: ' || description) AS n
    FROM current c WHERE NOT EXISTS (SELECT 1 FROM status s WHERE s.venue_id = c.venue_id AND s.url = c.url)),
  judged AS (SELECT *, n % 5 = 0 OR n % 4 = 3 AS failed, n % 5 <> 0 AND n % 4 IN (0, 2) AS metal FROM outcome)"""


@query("classify_summary", _rec(*LOG_STATE, METAL_SQL, JUDGED_SQL, """SELECT count(*) FILTER (NOT failed) AS classified, count(*) FILTER (metal) AS metal, count(*) FILTER (NOT failed AND NOT metal) AS other,
    count(*) FILTER (failed) AS failed FROM judged"""))
def classify_summary(spark, sf):
    """One run over every unclassified gig of the log, its verdicts then read back off the log."""
    entries = t.log(spark, sf)
    current = durable(p.current_gigs(entries))
    asked = c.routed(c.to_classify(current, p.already_classified(entries)))
    outcome = durable(c.outcomes(c.score(asked, example_judge)))
    now = c.verdict_entries(outcome, F.lit("2024-07-01 00:00:00").cast("timestamp_ntz")).withColumn("seq", F.lit(1 << 40).cast("bigint"))
    after = entries.unionByName(now, allowMissingColumns=True)
    return report.classify_summary(outcome, p.metal_of(current, p.class_status(after)))


# --- reports ----------------------------------------------------------------------------------

WITH_STATUS_SQL = "gigs AS (SELECT c.*, f.first_seq, coalesce(s.genre, 'Pending') AS status FROM current c JOIN firsts f USING (venue_id, url) LEFT JOIN status s USING (venue_id, url))"


@query("status_breakdown", _rec(*LOG_STATE, WITH_STATUS_SQL, f"""scoped AS (SELECT 'overall' AS scope, status FROM gigs UNION ALL SELECT 'upcoming', status FROM gigs WHERE date >= DATE '{TODAY}')
  SELECT scope, count(*) AS gigs, count(*) FILTER (status = 'Metal') AS metal, count(*) FILTER (status = 'Other') AS other, count(*) FILTER (status = 'Pending') AS pending FROM scoped GROUP BY scope"""))
def status_breakdown(spark, sf):
    return report.status_breakdown(gigs_with_status(spark, sf), today())


@query("pending_by_venue", _rec(*LOG_STATE, WITH_STATUS_SQL, f"SELECT venue, count(*) AS n FROM gigs JOIN venues USING (venue_id) WHERE status = 'Pending' AND date >= DATE '{TODAY}' GROUP BY venue"))
def pending_by_venue(spark, sf):
    return report.pending_by_venue(gigs_with_status(spark, sf), today())


@query("unresolved", _rec(*LOG_STATE, WITH_STATUS_SQL, f"SELECT venue_id, url, date, title FROM gigs WHERE status = 'Pending' AND {ON_PAGE}"))
def unresolved(spark, sf):
    return report.unresolved(pub.page_window(gigs_with_status(spark, sf), today())).select(*KEY, "date", "title")


@query("unresolved_soonest", _rec(*LOG_STATE, WITH_STATUS_SQL, f"SELECT venue_id, url, date, title FROM gigs WHERE status = 'Pending' AND {ON_PAGE} ORDER BY date, first_seq LIMIT 5"))
def unresolved_soonest(spark, sf):
    """The five soonest, as the refusal to publish shows them."""
    return report.unresolved(pub.page_window(gigs_with_status(spark, sf), today())).limit(5).select(*KEY, "date", "title")


@query("scrape_summary", with_ctes(*GATE_SQL, """failed AS (SELECT DISTINCT venue_id FROM claims WHERE gig IS NOT NULL),
  changed AS (SELECT l.* FROM listing l LEFT JOIN previous p USING (venue_id, url) WHERE p.url IS NULL OR (l.title, l.date, l.poster_url, l.description) IS DISTINCT FROM (p.title, p.date, p.poster_url, p.description)),
  logged AS (SELECT * FROM changed WHERE venue_id NOT IN (SELECT venue_id FROM failed))
  SELECT (SELECT count(*) FROM listing) AS scraped, (SELECT count(*) FROM logged) AS logged, (SELECT count(*) FROM changed) - (SELECT count(*) FROM logged) AS withheld,
    (SELECT count(*) FROM logged WHERE trim(description) = '') AS without_text"""))
def scrape_summary(spark, sf):
    batch = batch_of(spark, sf)
    failed = gate.failing(batch)
    changed = durable(p.new_or_changed(batch.listing, batch.previous))
    return report.scrape_summary(batch.listing, changed, gate.passed(changed, failed))


@query("to_log", with_ctes(*GATE_SQL, """failed AS (SELECT DISTINCT venue_id FROM claims WHERE gig IS NOT NULL)
  SELECT l.venue_id, l.url, l.title FROM listing l LEFT JOIN previous p USING (venue_id, url)
  WHERE (p.url IS NULL OR (l.title, l.date, l.poster_url, l.description) IS DISTINCT FROM (p.title, p.date, p.poster_url, p.description)) AND l.venue_id NOT IN (SELECT venue_id FROM failed)"""))
def to_log(spark, sf):
    """Changed rows less the withheld ones: what a scrape appends."""
    batch = batch_of(spark, sf)
    failed = gate.failing(batch)
    return gate.passed(p.new_or_changed(batch.listing, batch.previous), failed).select(*KEY, "title")


# --- publishing -------------------------------------------------------------------------------


@query("upcoming", with_ctes(t.LOG_SQL, CURRENT_SQL, f"SELECT venue_id, url, date FROM current WHERE date >= DATE '{TODAY}'"))
def upcoming(spark, sf):
    return pub.upcoming(p.current_gigs(t.log(spark, sf)), today()).select(*KEY, "date")


@query("page_window", with_ctes(t.LOG_SQL, CURRENT_SQL, f"SELECT venue_id, url, date FROM current WHERE {ON_PAGE}"))
def page_window(spark, sf):
    return pub.page_window(p.current_gigs(t.log(spark, sf)), today()).select(*KEY, "date")


def page_of(spark, sf, day: str = TODAY):
    return pub.cards(p.metal_gigs(t.log(spark, sf)), F.lit(day).cast("date"))


CARD = "date, title, venue, url, image_url"
PAGE_STATE = [*LOG_STATE, METAL_SQL, PAGE_SQL]


@query("page_rows", _rec(*PAGE_STATE, f"SELECT {CARD} FROM page"))
def page_rows(spark, sf):
    return pub.page_rows(p.metal_gigs(t.log(spark, sf)), today()).select(*CARD.split(", "))


@query("stale_days", _rec(*PAGE_STATE, f"SELECT {CARD} FROM page WHERE date >= DATE '2024-07-16'"))
def stale_days(spark, sf):
    """The page as read half an hour before midnight UTC on a summer night, London being a day on."""
    now = F.lit("2024-07-15 23:30:00").cast("timestamp_ntz").cast("timestamp")
    return pub.drop_stale_days(page_of(spark, sf), now).select(*CARD.split(", "))


@query("search", _rec(*PAGE_STATE, f"SELECT {CARD} FROM page WHERE contains(lower(title || chr(10) || venue), 'brew')"))
def search(spark, sf):
    return pub.search(page_of(spark, sf), "  BREW ").select(*CARD.split(", "))


# Queries of one, two, three and more characters, among them one that nothing holds.
FOUND = ("  BREW ", "a", "e ", "the", "qzx", " Underworld")


@query("search_index", _rec(*PAGE_STATE, " UNION ALL ".join(f"SELECT {CARD}, '{q}' AS query FROM page WHERE contains(lower(title || chr(10) || venue), '{q.strip().lower()}')" for q in FOUND)))
def search_index(spark, sf):
    """The page searched by its index."""
    cards = page_of(spark, sf).select(*CARD.split(", "))
    index = finder.build(cards, ["title", "venue"], f"{working_folder(spark)}/index-{uuid.uuid4().hex}", shelves=16, buckets=16)
    found = [finder.find(spark, index, q).withColumn("query", F.lit(q)) for q in FOUND]
    return reduce(DataFrame.unionByName, found)


_DISPLAY = "dayname(date) || ', ' || day(date) || ' ' || monthname(date) || ' ' || year(date)"


@query("date_groups", _rec(*PAGE_STATE, f"SELECT date, {_DISPLAY} AS display_date, count(*) AS n_gigs FROM page GROUP BY date"))
def date_groups(spark, sf):
    return pub.date_groups(page_of(spark, sf))


@query("date_group_cards", _rec(*PAGE_STATE, f"SELECT {CARD}, {_DISPLAY} AS display_date, row_number() OVER (PARTITION BY date ORDER BY lower(title), first_seq) AS position FROM page"))
def date_group_cards(spark, sf):
    return pub.placed(page_of(spark, sf)).select(*CARD.split(", "), "display_date", "position")


PAGE_SIZE = 7


@query("day_pages", _rec(*PAGE_STATE, f"""put AS (SELECT date, url, title, {_DISPLAY} AS display_date, row_number() OVER (PARTITION BY date ORDER BY lower(title), first_seq) AS position FROM page)
  SELECT date, display_date, CAST((position - 1) // {PAGE_SIZE} + 1 AS BIGINT) AS page, count(*) AS n_cards, string_agg(url, chr(10) ORDER BY position) AS urls, arg_max(title, position) AS last_title FROM put GROUP BY 1, 2, 3"""))
def day_pages(spark, sf):
    """The page as nested days: lists of cards, a few each, told by their urls and last title."""
    pages = pub.day_pages(pub.placed(page_of(spark, sf)), PAGE_SIZE)
    urls = F.array_join(F.transform("cards", lambda card: card["url"]), "\n")
    return pages.select("date", "display_date", "page", F.size("cards").cast("long").alias("n_cards"), urls.alias("urls"), F.element_at("cards", -1)["title"].alias("last_title"))


EARLIER = "2024-01-20"


def earlier(sql: str) -> str:
    """The same state read off the entries recorded before that day."""
    names = ["newest", "current", "own", "edges", "taken_walk", "taken", "status", "firsts", "metal", "page"]
    return re.sub(rf"\b({'|'.join(names)})\b", r"\1_was", sql.replace("FROM log", "FROM log_was"))


LOG_WAS_SQL = f"log_was AS (SELECT * FROM log WHERE recorded_at < TIMESTAMP '{EARLIER}')"


@query("publish_delta", _rec(*PAGE_STATE, LOG_WAS_SQL, *[earlier(s) for s in (CURRENT_SQL, STATUS_SQL, FIRST_SQL, METAL_SQL, PAGE_SQL)], f"""days AS (SELECT date FROM page UNION SELECT date FROM page_was)
  SELECT date, CASE WHEN date NOT IN (SELECT date FROM page_was) THEN 'added' WHEN date NOT IN (SELECT date FROM page) THEN 'removed' ELSE 'changed' END AS change FROM days d
  WHERE EXISTS (SELECT {CARD} FROM page WHERE page.date = d.date EXCEPT ALL SELECT {CARD} FROM page_was WHERE page_was.date = d.date)
     OR EXISTS (SELECT {CARD} FROM page_was WHERE page_was.date = d.date EXCEPT ALL SELECT {CARD} FROM page WHERE page.date = d.date)"""))
def publish_delta(spark, sf):
    """The page against the one the log gave on an earlier day."""
    entries = t.log(spark, sf)
    before = entries.where(F.col("recorded_at") < F.lit(EARLIER).cast("timestamp_ntz"))
    now, was = side_by_side([partial(p.metal_gigs, entries), partial(p.metal_gigs, before)])
    return pub.publish_delta(pub.cards(now, today()), pub.cards(was, today()))


def _positions(table: str) -> str:
    return f"SELECT {CARD}, row_number() OVER (PARTITION BY date ORDER BY lower(title), first_seq) AS position FROM {table}"


@query("publish_days", _rec(*PAGE_STATE, LOG_WAS_SQL, *[earlier(s) for s in (CURRENT_SQL, STATUS_SQL, FIRST_SQL, METAL_SQL, PAGE_SQL)], f"""put AS ({_positions('page')}), put_was AS ({_positions('page_was')}),
moved AS (SELECT date FROM (SELECT * FROM put EXCEPT ALL SELECT * FROM put_was) UNION SELECT date FROM (SELECT * FROM put_was EXCEPT ALL SELECT * FROM put))
  SELECT {CARD}, position, CASE WHEN date IN (SELECT date FROM moved) THEN '2024-06-01' ELSE '2024-05-01' END AS lastmod FROM put"""))
def publish_days(spark, sf):
    """The page published as of an earlier log, then as of the whole one: only days that differ are written again, and read so."""
    path = f"{working_folder(spark)}/page-{uuid.uuid4().hex}"
    entries = t.log(spark, sf)
    before = entries.where(F.col("recorded_at") < F.lit(EARLIER).cast("timestamp_ntz"))
    for log, at in ((before, "2024-05-01"), (entries, "2024-06-01")):
        published.publish(durable(pub.placed(pub.cards(p.metal_gigs(log), today()))), path, F.lit(at).cast("timestamp"))
    return published.read_page(spark, path).select(*CARD.split(", "), F.col("position").cast("long").alias("position"), F.col("lastmod").cast("date").cast("string").alias("lastmod"))


@query("snapshot", _rec(*PAGE_STATE, f"SELECT {CARD}, '2024-06-01T12-00-00Z' AS snapshot FROM page"))
def snapshot(spark, sf):
    """Two renders archived, the newer read back as current."""
    path = f"{working_folder(spark)}/rendered-{uuid.uuid4().hex}"
    for day, at in (("2024-05-01", "2024-05-01T12-00-00Z"), (TODAY, "2024-06-01T12-00-00Z")):
        pub.write_snapshot(page_of(spark, sf, day).select(*CARD.split(", ")), path, at)
    return pub.current_snapshot(spark.read.parquet(path)).select(*CARD.split(", "), "snapshot")


@query("image_todo", _rec(*PAGE_STATE, f"""published AS (SELECT {IMAGE} AS file FROM metal WHERE date < DATE '2024-09-01')
  SELECT DISTINCT {IMAGE} AS file, poster_url FROM page WHERE {IMAGE} NOT IN (SELECT file FROM published)"""))
def image_todo(spark, sf):
    """Images still to publish when those up to August are."""
    metal = p.metal_gigs(t.log(spark, sf))
    done = pub.image_names(metal.where(F.col("date") < F.lit("2024-09-01").cast("date")))
    return pub.images_to_publish(pub.cards(metal, today()), done)


@query("image_gc", _rec(*PAGE_STATE, f"SELECT DISTINCT {IMAGE} AS file FROM log WHERE _type = 'observed' EXCEPT SELECT {IMAGE} FROM metal"))
def image_gc(spark, sf):
    """Had every observation's image been published: those no metal gig claims now."""
    entries = t.log(spark, sf)
    observed = pub.image_names(entries.where(F.col("_type") == "observed"))
    return pub.images_to_drop(p.metal_gigs(entries), observed)


_EXT = "CASE WHEN contains(list_last(string_split(split_part(poster_url, '?', 1), '/')), '.') THEN list_last(string_split(list_last(string_split(split_part(poster_url, '?', 1), '/')), '.')) ELSE 'jpg' END"


@query("image_cache", with_ctes(t.LOG_SQL, CURRENT_SQL, f"SELECT DISTINCT poster_url, left(sha256(poster_url), 8) || '.' || {_EXT} AS file FROM log WHERE _type = 'observed' AND poster_url NOT IN (SELECT poster_url FROM current WHERE date < DATE '{TODAY}')"))
def image_cache(spark, sf):
    """Posters still to download when those of gigs already played are cached."""
    entries = t.log(spark, sf)
    played = p.current_gigs(entries).where(F.col("date") < today())
    cached = played.select(urls.cached_image(F.col("poster_url")).alias("file")).distinct()
    return pub.images_to_cache(entries.where(F.col("_type") == "observed"), cached)


# --- posters ----------------------------------------------------------------------------------

REPLIES_SQL = """replies AS (SELECT 'https://img.example.org/flyer/' || conv_id || '-' || turn || '.jpg' AS image_url,
    'https://social.example.org/post/' || conv_id || '-' || turn AS source_url, CASE WHEN turn % 2 = 0 THEN 'the-dev' ELSE 'barfly' END AS venue_id,
    'Calendar:' || chr(10) || replace(replace(text, ' de ', ' Karaoke '), '. ', chr(10) || '2026-03-' || lpad(CAST(length(text) % 33 + 1 AS VARCHAR), 2, '0') || ' | ') AS reply FROM conversations)"""
LISTED_SQL = r"""lines AS (SELECT image_url, source_url, venue_id, list_filter(list_transform(string_split_regex(reply, '\r\n|\n|\r'),
      lambda l: regexp_replace(l, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda l: regexp_matches(l, '^(\d{4}-\d{2}-\d{2})\s*\|\s*(.+)$')) AS ls FROM replies),
readable AS (SELECT * FROM lines WHERE len(ls) > 0 AND len(list_filter(ls, lambda l: try_cast(left(l, 10) AS DATE) IS NULL)) = 0),
poster AS (SELECT image_url, source_url, venue_id, CAST(left(l, 10) AS DATE) AS date, regexp_replace(regexp_extract(l, '^(\d{4}-\d{2}-\d{2})\s*\|\s*(.+)$', 2), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS title, line_no
  FROM (SELECT *, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS line_no FROM readable))"""
_SLUG = "regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
POSTER_GIGS_SQL = f"""poster_gigs AS (SELECT venue_id, source_url || '#gig-' || {_SLUG} || '-' || CAST(date AS VARCHAR) AS url, title, date, image_url AS poster_url, title AS description, line_no
  FROM poster WHERE NOT (venue_id = 'the-dev' AND regexp_matches(title, '(?i)karaoke')))"""


def poster_replies(spark, sf):
    """Every conversation turn as a poster's transcription: its sentences as dated lines."""
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    day = F.lpad((F.length("text") % 33 + 1).cast("string"), 2, "0")
    line = F.concat(F.lit("\n2026-03-"), day, F.lit(" | "))
    return t.table(spark, sf, "conversations").select(
        F.concat(F.lit("https://img.example.org/flyer/"), key, F.lit(".jpg")).alias("image_url"),
        F.concat(F.lit("https://social.example.org/post/"), key).alias("source_url"),
        F.when(F.col("turn") % 2 == 0, "the-dev").otherwise("barfly").alias("venue_id"),
        F.concat(F.lit("Calendar:\n"), F.replace(F.replace("text", F.lit(" de "), F.lit(" Karaoke ")), F.lit(". "), line)).alias("reply"),
    )


@query("poster_rows", with_ctes(REPLIES_SQL, LISTED_SQL, "SELECT source_url, venue_id, line_no, date, title FROM poster"))
def poster_rows(spark, sf):
    return posters.poster_rows(poster_replies(spark, sf)).select("source_url", "venue_id", "line_no", "date", "title")


@query("poster_failures", with_ctes(REPLIES_SQL, LISTED_SQL, "SELECT source_url, venue_id FROM replies WHERE source_url NOT IN (SELECT source_url FROM readable)"))
def poster_failures(spark, sf):
    return posters.unread_replies(poster_replies(spark, sf)).select("source_url", "venue_id")


@query("title_exclude", with_ctes(REPLIES_SQL, LISTED_SQL, "SELECT source_url, venue_id, line_no, title FROM poster WHERE NOT (venue_id = 'the-dev' AND regexp_matches(title, '(?i)karaoke'))"))
def title_exclude(spark, sf):
    return posters.without_excluded(posters.poster_rows(poster_replies(spark, sf))).select("source_url", "venue_id", "line_no", "title")


@query("poster_key", with_ctes(REPLIES_SQL, LISTED_SQL, POSTER_GIGS_SQL, "SELECT venue_id, url, title FROM poster_gigs"))
def poster_key(spark, sf):
    return posters.poster_gigs(poster_replies(spark, sf)).select("venue_id", "url", "title")


@query("poster_ingest", with_ctes(REPLIES_SQL, LISTED_SQL, POSTER_GIGS_SQL, """seen AS (SELECT DISTINCT ON (url) url, CASE WHEN length(title) % 2 = 0 THEN title ELSE title || '!' END AS title, date, poster_url FROM poster_gigs ORDER BY url, line_no)
  SELECT 'observed' AS _type, g.venue_id, g.url, g.title, NULL AS genre FROM poster_gigs g LEFT JOIN seen s USING (url) WHERE s.url IS NULL OR s.title <> g.title
  UNION ALL SELECT 'classified', venue_id, url, NULL, 'Metal' FROM poster_gigs"""))
def poster_ingest(spark, sf):
    """All posters ingested into a log that already holds their gigs, some under another title."""
    gigs = durable(posters.poster_gigs(poster_replies(spark, sf)))
    held = (
        gigs.groupBy("venue_id", "url").agg(F.min_by(F.struct("title", "date", "poster_url"), "line_no").alias("g"))
        .select("venue_id", "url", F.when(F.length("g.title") % 2 == 0, F.col("g.title")).otherwise(F.concat("g.title", F.lit("!"))).alias("title"),
                "g.date", "g.poster_url", F.col("g.title").alias("description"))
    )
    held = held.withColumn("description", F.when(F.length("description") % 2 == 0, F.col("title")).otherwise(F.col("description")))
    entries = posters.ingest_entries(gigs, held, F.lit("2026-03-01 00:00:00").cast("timestamp_ntz"))
    return entries.select("_type", "venue_id", "url", "title", "genre")


@query("slug", with_ctes("titled AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS title FROM documents)", f"SELECT doc_id, {_SLUG} AS slug FROM titled"))
def slugs(spark, sf):
    lines = t.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", slug(F.col("line")).alias("slug"))


@query("size_cap", "SELECT page_id, octet_length(encode(html)) <= 7000000 AS fits FROM pages")
def size_cap(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", posters.within_size(F.col("html")).alias("fits"))


@query("images_too_large", """WITH images AS (SELECT url AS image_url, octet_length(encode(html)) + CASE page_id % 5 WHEN 0 THEN 7000000 WHEN 1 THEN 7000000 - octet_length(encode(html)) ELSE 0 END AS bytes FROM pages)
  SELECT image_url, CAST(bytes AS INTEGER) AS bytes, 'Image at ' || image_url || ' is ' || bytes || ' bytes, too large to send (limit ~7000000)' AS error FROM images WHERE bytes > 7000000""")
def images_too_large(spark, sf):
    """Pages as images, a fifth of them padded over the limit, a fifth exactly to it."""
    own, kind = F.octet_length("html"), F.col("page_id") % 5
    padding = F.when(kind == 0, posters.MAX_IMAGE_BYTES).when(kind == 1, posters.MAX_IMAGE_BYTES - own).otherwise(0)
    content = F.concat("html", F.repeat(F.lit("."), padding))
    return posters.too_large(t.table(spark, sf, "pages").select(F.col("url").alias("image_url"), content.alias("content")))


@query("image_mime", """WITH asked AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN ' image/avif; q=1' WHEN 1 THEN ' ' END AS header,
    url || CASE page_id % 5 WHEN 0 THEN '/a.PNG?x=1' WHEN 1 THEN '/a.gif' WHEN 2 THEN '/a.webp' WHEN 3 THEN '/noext' ELSE '/b.jpeg' END AS url FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages))
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'image/avif' ELSE CASE page_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/webp' ELSE 'image/jpeg' END END AS mime FROM asked""")
def image_mime(spark, sf):
    n = F.col("page_id")
    header = F.when(n % 3 == 0, " image/avif; q=1").when(n % 3 == 1, " ")
    name = F.when(n % 5 == 0, "/a.PNG?x=1").when(n % 5 == 1, "/a.gif").when(n % 5 == 2, "/a.webp").when(n % 5 == 3, "/noext").otherwise("/b.jpeg")
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), name)
    return t.table(spark, sf, "pages").select("page_id", urls.image_mime(header, url).alias("mime"))
