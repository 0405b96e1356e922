"""Queries over extraction: text, url and date rules, payloads, page nodes, listing order."""

from __future__ import annotations

from pyspark.sql import functions as F

from listinglake.catalog.quality import BLANK
from listinglake.catalog.registry import query, with_ctes
from listinglake.functions import dates as d
from listinglake.functions import text as x
from listinglake.functions import urls as u
from listinglake.operators import listings
from listinglake.sources import payloads
from listinglake.sources import testviews as t


def docs(spark, sf):
    return t.table(spark, sf, "documents")


def escaped_text():
    """The whole text as a page would hold it."""
    return F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


# every line of every text is a title
TITLED_SQL = "titled AS (SELECT doc_id, n_chars, unnest(string_split(text, chr(10))) AS line FROM documents)"


def titled(spark, sf):
    return docs(spark, sf).select("doc_id", "n_chars", F.explode(F.split("text", "\n")).alias("line"))


# --- text -------------------------------------------------------------------------------------


@query("title_norm", with_ctes(TITLED_SQL, r"SELECT doc_id, trim(regexp_replace(chr(8239) || replace(line, ' ', chr(160) || ' ') || chr(9) || ' ', '\p{Zs}+', ' ', 'g'), ' ') AS title FROM titled"))
def title_norm(spark, sf):
    """Titles with narrow and no-break spaces put in; the tab at the end has to survive."""
    messy = F.concat(F.lit(" "), F.replace(F.col("line"), F.lit(" "), F.lit("  ")), F.lit("\t "))
    return titled(spark, sf).select("doc_id", x.title_spacing(messy).alias("title"))


_SPOILT_SQL = """spoilt AS (SELECT doc_id, CASE n_chars % 6 WHEN 0 THEN line WHEN 1 THEN line || chr(8203) || chr(9) || 'x' || chr(9) WHEN 2 THEN ' ' || line
  WHEN 3 THEN chr(160) || ' ' WHEN 4 THEN chr(173) || line ELSE replace(line, ' ', '  ') END AS title FROM titled)"""


@query("title_valid", with_ctes(TITLED_SQL, _SPOILT_SQL, rf"""SELECT doc_id, CASE WHEN {BLANK.format('title')} THEN 'blank' WHEN contains(title, chr(8203)) THEN 'U+0009, U+200B' WHEN contains(title, chr(173)) THEN 'U+00AD'
    WHEN regexp_matches(title, '[\x00-\x1f\x7f-\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{200b}}-\x{{200d}}\x{{feff}}\x{{ad}}]') THEN 'odd'
    WHEN title <> trim(title, ' ') OR contains(title, '  ') THEN 'spacing' END AS problem FROM spoilt"""))
def title_valid(spark, sf):
    line, n = F.col("line"), F.col("n_chars") % 6
    title = (
        F.when(n == 0, line).when(n == 1, F.concat(line, F.lit("​\tx\t"))).when(n == 2, F.concat(F.lit(" "), line))
        .when(n == 3, F.lit("  ")).when(n == 4, F.concat(F.lit("­"), line)).otherwise(F.replace(line, F.lit(" "), F.lit("  ")))
    )
    return titled(spark, sf).select("doc_id", x.title_problem(title).alias("problem"))


@query("not_blank", f"SELECT conv_id, turn, NOT ({BLANK.format('shown')}) AS not_blank FROM (SELECT *, text AS shown FROM conversations UNION ALL SELECT *, chr(160) || chr(10) FROM conversations WHERE turn % 3 = 0)")
def not_blank(spark, sf):
    """Every turn's text, and a blank one more for every third turn."""
    said = t.table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("shown"))
    blank = said.where(F.col("turn") % 3 == 0).withColumn("shown", F.lit("\u00a0\n"))
    return said.unionByName(blank).select("conv_id", "turn", x.not_blank(F.col("shown")).alias("not_blank"))


@query("title_cancel", with_ctes(t.LOG_SQL, "SELECT seq, title || CASE WHEN description = '' THEN ' - CANCELLED' ELSE '' END AS title FROM log WHERE _type = 'observed'"))
def title_cancel(spark, sf):
    status = F.when(F.col("description") == "", "cancelled").otherwise("on-sale")
    observed = t.log(spark, sf).where(F.col("_type") == "observed")
    return observed.select("seq", payloads.cancelled_title(F.col("title"), status).alias("title"))


# --- urls -------------------------------------------------------------------------------------


def page_urls(spark, sf):
    return t.table(spark, sf, "pages").select("page_id", "url")


@query("url_allow", "SELECT page_id, starts_with(url, 'https://m.') OR starts_with(url, 'http://') AS allowed FROM pages")
def url_allow(spark, sf):
    prefixes = F.array(F.lit("https://m."), F.lit("http://"))
    return page_urls(spark, sf).select("page_id", u.is_under(F.col("url"), prefixes).alias("allowed"))


@query("url_cut", "SELECT page_id, split_part(url, '?', 1) AS url FROM pages")
def url_cut(spark, sf):
    return page_urls(spark, sf).select("page_id", u.without_query(F.col("url")).alias("url"))


@query("url_date_key", with_ctes(t.LOG_SQL, "SELECT seq, url || '#' || CAST(date AS VARCHAR) AS key FROM log WHERE _type = 'observed'"))
def url_date_key(spark, sf):
    observed = t.log(spark, sf).where(F.col("_type") == "observed")
    return observed.select("seq", u.dated_key(F.col("url"), F.col("date")).alias("key"))


_LINKS_SQL = """links AS (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN '/x' WHEN 1 THEN '//cdn.example.org/x' WHEN 2 THEN 'x?y=1' WHEN 3 THEN 'https://other.example.org/x' ELSE '?z=2' END AS link FROM pages)"""


@query("url_resolve", with_ctes(_LINKS_SQL, r"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN regexp_extract(url, '^(https?://[^/]+)', 1) || link WHEN 1 THEN regexp_extract(url, '^(https?:)', 1) || link
    WHEN 2 THEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || link WHEN 3 THEN link ELSE regexp_replace(url, '[?#].*$', '') || link END AS url FROM links"""))
def url_resolve(spark, sf):
    n = F.col("page_id") % 5
    link = F.when(n == 0, "/x").when(n == 1, "//cdn.example.org/x").when(n == 2, "x?y=1").when(n == 3, "https://other.example.org/x").otherwise("?z=2")
    return page_urls(spark, sf).select("page_id", u.resolved(link, F.col("url")).alias("url"))


@query("url_redirect", with_ctes(t.LISTING_SQL, t.URL_STATUS_SQL, """SELECT url AS listed, CASE WHEN status = 301 THEN CASE WHEN length(location) % 2 = 0 THEN 'https://tickets.example.org/event' || location END WHEN status = 200 THEN url END AS url FROM url_status"""))
def url_redirect(spark, sf):
    """Redirects inside the event pages and outside them, pages still served, and errors."""
    site = F.when(F.length("location") % 2 == 0, "https://tickets.example.org/event").otherwise("https://tickets.example.org")
    answered = t.url_status(spark, sf).withColumn("location", F.concat(site, "location"))
    key = payloads.redirected_key(F.col("url"), F.col("status"), F.col("location"), "https://tickets.example.org/event/")
    return answered.select(F.col("url").alias("listed"), key.alias("url"))


@query("url_fallback", "SELECT page_id, CASE WHEN contains(url, '?') THEN url ELSE 'https://fallback.example.org/' || page_id END AS url FROM pages")
def url_fallback(spark, sf):
    href = F.when(F.col("url").contains("?"), F.col("url")).otherwise(F.lit(" "))
    other = F.concat(F.lit("https://fallback.example.org/"), F.col("page_id").cast("string"))
    return page_urls(spark, sf).select("page_id", u.first_not_blank(href, other).alias("url"))


@query("url_drop_params", """WITH full_urls AS (SELECT page_id, split_part(url, '#', 1) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'mode=fit&&width=300' AS url FROM pages)
  SELECT page_id, split_part(url, '?', 1) || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url
  FROM (SELECT *, list_filter(string_split(split_part(url, '?', 2), '&'), lambda p: p <> '' AND NOT starts_with(p, 'mode=') AND NOT starts_with(p, 'width=')) AS kept FROM full_urls)""")
def url_drop_params(spark, sf):
    base = F.substring_index("url", "#", 1)
    full = F.concat(base, F.when(base.contains("?"), "&").otherwise("?"), F.lit("mode=fit&&width=300"))
    return page_urls(spark, sf).select("page_id", u.original_size(full).alias("url"))


@query("url_imgix", with_ctes(t.LOG_SQL, """SELECT DISTINCT poster_url AS given, CASE WHEN contains(poster_url, '-1') THEN replace(replace(poster_url, 'img.example.org', 'x.imgix.net'), '?w=300', '') ELSE poster_url END AS url FROM log WHERE _type = 'observed'"""))
def url_imgix(spark, sf):
    given = F.col("poster_url")
    host = F.when(given.contains("-1"), F.replace(given, F.lit("img.example.org"), F.lit("x.imgix.net"))).otherwise(given)
    observed = t.log(spark, sf).where(F.col("_type") == "observed").select("poster_url").distinct()
    return observed.select(given.alias("given"), u.imgix_full_width(host).alias("url"))


@query("poster_full", "SELECT doc_id, 'https://img.example.org/p' || doc_id || '.jpg' AS poster FROM documents")
def poster_full(spark, sf):
    size = F.concat_ws("x", F.col("n_chars").cast("string"), F.lit("40"))
    n = F.col("doc_id").cast("string")
    lbox = F.concat(F.lit("https://img.example.org/p"), n, F.lit("-lbox-"), size, F.lit("-FFF.jpg"))
    centred = F.concat(F.lit("https://img.example.org/p"), n, F.lit("-"), size, F.lit("-c-center.jpg"))
    return docs(spark, sf).select("doc_id", u.without_thumbnail_suffix(F.when(F.col("lang") == "en", lbox).otherwise(centred)).alias("poster"))


@query("poster_css", "SELECT page_id, CASE WHEN starts_with(url, 'https') THEN url END AS poster FROM pages")
def poster_css(spark, sf):
    quote = F.when(F.length("url") % 2 == 0, "'").otherwise('"')
    style = F.concat(F.lit("color:red;background-image: url("), quote, F.col("url"), quote, F.lit(");"))
    style = F.when(F.col("url").startswith("https"), style).otherwise(F.lit("background: none"))
    return page_urls(spark, sf).select("page_id", u.css_background(style).alias("poster"))


_SRCSET_SQL = "sets AS (SELECT doc_id, n_chars, 300 + n_chars % 500 AS a, 300 + (n_chars * 7) % 500 AS b FROM documents)"


@query("poster_srcset", with_ctes(_SRCSET_SQL, "SELECT doc_id, CASE WHEN n_chars % 4 = 0 THEN 'https://i.example.org/src.jpg' WHEN b > a THEN 'https://i.example.org/b.jpg' ELSE 'https://i.example.org/a.jpg' END AS poster FROM sets"))
def poster_srcset(spark, sf):
    n = F.col("n_chars")
    a, b = (300 + n % 500).cast("string"), (300 + (n * 7) % 500).cast("string")
    srcset = F.concat(F.lit("https://i.example.org/a.jpg "), a, F.lit("w, https://i.example.org/b.jpg "), b, F.lit("w, https://i.example.org/c.jpg"))
    srcset = F.when(n % 4 == 0, F.lit("https://i.example.org/c.jpg 2x")).otherwise(srcset)
    return docs(spark, sf).select("doc_id", F.coalesce(u.widest_of(srcset), F.lit("https://i.example.org/src.jpg")).alias("poster"))


@query("poster_fallback", "SELECT page_id, CASE WHEN contains(url, '#') THEN split_part(url, '#', 2) WHEN contains(url, '?') THEN 'page' WHEN starts_with(url, 'https') THEN 'house' END AS poster, NOT contains(url, '#') AND NOT contains(url, '?') AND NOT starts_with(url, 'https') AS failed FROM pages")
def poster_fallback(spark, sf):
    """The card's own picture, else the event page's, else the venue's, else a failure."""
    url = F.col("url")
    card = F.when(url.contains("#"), F.substring_index(url, "#", -1)).otherwise(F.lit(" "))
    page = F.when(url.contains("?"), "page").otherwise("")
    house = F.when(url.startswith("https"), "house")
    poster = u.first_not_blank(card, page, house)
    return page_urls(spark, sf).select("page_id", poster.alias("poster"), poster.isNull().alias("failed"))


@query("url_ext", r"""SELECT page_id, CASE WHEN contains(name, '.') THEN list_last(string_split(name, '.')) ELSE 'jpg' END AS ext
  FROM (SELECT page_id, list_last(string_split(split_part(url, '?', 1), '/')) AS name FROM pages)""")
def url_ext(spark, sf):
    return page_urls(spark, sf).select("page_id", u.file_extension(F.col("url")).alias("ext"))


@query("short_hash", "SELECT page_id, left(sha256(url), 8) AS hash FROM pages")
def short_hash(spark, sf):
    return page_urls(spark, sf).select("page_id", u.short_hash(F.col("url")).alias("hash"))


@query("image_name", with_ctes(t.LOG_SQL, "SELECT seq, CAST(date AS VARCHAR) || '-' || venue_id || '-' || left(sha256(poster_url), 8) || '.webp' AS published, left(sha256(poster_url), 8) || '.png' AS cached FROM log WHERE _type = 'observed'"))
def image_name(spark, sf):
    observed = t.log(spark, sf).where(F.col("_type") == "observed")
    return observed.select(
        "seq", u.published_image(F.col("date"), F.col("venue_id"), F.col("poster_url")).alias("published"),
        u.cached_image(F.col("poster_url")).alias("cached"),
    )


# --- dates ------------------------------------------------------------------------------------
# Every order date printed in one of the forms, then read back.


def order_days(spark, sf):
    return t.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("on"))


ORDER_DAYS_SQL = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders"


def _printed(name, form, read):
    @query(name, ORDER_DAYS_SQL)
    def run(spark, sf):
        return order_days(spark, sf).select("o_orderkey", read(form(F.col("on"))).alias("date"))

    return run


_printed("date_iso", lambda on: F.concat(F.lit("/events/"), on.cast("string"), F.lit("-a-gig T19:00")), d.iso_date)
_printed(
    "date_ordinal",
    lambda on: F.concat(F.date_format(on, "EEEE d"), F.lit("th "), F.date_format(on, "MMMM"), F.when(F.dayofmonth(on) > 15, ",").otherwise(""), F.lit(" "), F.date_format(on, "yyyy")),
    lambda text: d.printed_date(text, d.ORDINAL),
)
_printed("date_short", lambda on: F.concat(F.lit("on "), F.date_format(on, "dd MMM yyyy")), lambda text: d.printed_date(text, d.SHORT))


@query("date_short_year", """SELECT o_orderkey, CAST(year(o_orderdate) % 100 + 2000 || strftime(o_orderdate, '-%m-%d') AS DATE) AS date FROM orders""")
def date_short_year(spark, sf):
    """Two-digit years in both forms; the orders' years move to this century."""
    on = F.col("on")
    dotted = d.printed_date(F.date_format(on, "EEE.dd.MMM.yy"), d.DOTTED_YEAR, 2000)
    spaced = d.printed_date(F.date_format(on, "EEE d MMM yy"), d.SHORT_YEAR, 2000)
    return order_days(spark, sf).select("o_orderkey", F.when(F.dayofmonth(on) < 20, dotted).otherwise(spaced).alias("date"))


@query("date_tz", "SELECT event_id, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE CASE WHEN user_id % 2 = 0 THEN 'Europe/London' ELSE 'Asia/Tokyo' END AS DATE) AS date FROM events")
def date_tz(spark, sf):
    zone = F.when(F.col("user_id") % 2 == 0, "Europe/London").otherwise("Asia/Tokyo")
    instant = F.try_to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return t.table(spark, sf, "events").select("event_id", d.local_date(instant, zone).alias("date"))


@query("date_block", ORDER_DAYS_SQL)
def date_block(spark, sf):
    """A day number inside a block that is headed by its month and year."""
    on = F.col("on")
    return order_days(spark, sf).select("o_orderkey", d.block_date(F.date_format(on, "MMMM yyyy"), F.dayofmonth(on).cast("string")).alias("date"))


@query("date_range", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS date FROM lineitem")
def date_range(spark, sf):
    """Runs of up to fifty days from every ship date, printed day first or month first."""
    on = F.col("l_shipdate").cast("date")
    last = F.date_add(on, F.col("l_quantity").cast("int"))
    same_month = F.date_format(on, "yyyyMM") == F.date_format(last, "yyyyMM")
    day_first = F.when(F.col("l_quantity") == 1, F.date_format(on, "d MMM yyyy")).otherwise(
        F.concat(F.when(same_month, F.date_format(on, "d")).otherwise(F.date_format(on, "d MMM")), F.lit(" - "), F.date_format(last, "d MMM yyyy"))
    )
    month_first = F.concat(F.date_format(on, "MMMM d"), F.lit("th - "), F.date_format(last, "MMM d"), F.lit("th "), F.date_format(last, "yyyy"))
    parts = d.parts_start(
        F.concat(F.lit(" "), F.dayofmonth(on).cast("string")), F.date_format(on, "MMM"), F.date_format(last, "MMMM"), F.date_format(last, "yyyy")
    )
    start = (
        F.when(F.col("l_linenumber") % 3 == 0, d.range_start(day_first))
        .when(F.col("l_linenumber") % 3 == 1, d.month_first_range_start(month_first)).otherwise(parts)
    )
    return t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", start.alias("date"))


@query("month_num", "SELECT o_orderkey, month(o_orderdate) AS long_name, month(o_orderdate) AS short_name, NULL AS neither FROM orders")
def month_num(spark, sf):
    on = F.col("on")
    return order_days(spark, sf).select(
        "o_orderkey", d.month_number(F.date_format(on, "MMMM")).alias("long_name"), d.month_number(F.date_format(on, "MMM")).alias("short_name"),
        d.month_number(F.upper(F.concat(F.date_format(on, "MMM"), F.lit("x")))).alias("neither"),
    )


# --- order within a venue ---------------------------------------------------------------------


def monthly(spark, sf):
    """Every event as a listing row of its user's venue that prints a month and no year."""
    k = F.get_json_object("props", "$.k").cast("int")
    return t.table(spark, sf, "events").select(
        F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("venue_id"), F.col("event_id").alias("listing_pos"), (k % 12 + 1).alias("month")
    )


def _year_sql(turns: str) -> str:
    return f"""WITH rows_of AS (SELECT 'v' || user_id AS venue_id, event_id AS listing_pos, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 12 + 1 AS month FROM events),
  turned AS (SELECT *, lag(month) OVER (PARTITION BY venue_id ORDER BY listing_pos) AS previous FROM rows_of)
  SELECT venue_id, listing_pos, month, 2026 + sum(CASE WHEN {turns} THEN 1 ELSE 0 END) OVER (PARTITION BY venue_id ORDER BY listing_pos) AS year FROM turned"""


@query("year_rollover", _year_sql("month < previous"))
def year_rollover(spark, sf):
    return listings.running_year(monthly(spark, sf), 2026)


@query("year_rollover_jan", _year_sql("month = 1 AND previous <> 1"))
def year_rollover_jan(spark, sf):
    return listings.running_year(monthly(spark, sf), 2026, listings.january_after_another)


@query("year_rollover_pages", f"SELECT venue_id, ((listing_pos // 5) << 32) + listing_pos % 5 AS listing_pos, month, year FROM ({_year_sql('month < previous')})")
def year_rollover_pages(spark, sf):
    """The same rows as pages of five, so that positions leave gaps between pages."""
    at = listings.page_position(F.floor(F.col("listing_pos") / 5), F.col("listing_pos") % 5)
    return listings.running_year(monthly(spark, sf).withColumn("listing_pos", at), 2026)


@query("dedupe_first", with_ctes(t.LISTING_BY_LENGTH_SQL, "SELECT venue_id, url, listing_pos, title FROM listing QUALIFY row_number() OVER (PARTITION BY venue_id, url ORDER BY listing_pos) = 1"))
def dedupe_first(spark, sf):
    rows = t.listing_by_length(spark, sf)
    return listings.dedupe_first(rows, ["venue_id", "url"]).select("venue_id", "url", "listing_pos", "title")


FETCHED_SQL = r"""fetched AS (SELECT CAST(p_brand AS VARCHAR) AS venue_id, CAST(p_partkey // 25 AS INTEGER) AS page_no, sum(p_size) AS total, count(*) FILTER (p_size > 10) AS items FROM part GROUP BY 1, 2)"""


def fetched_pages(spark, sf):
    """Parts as pages of twenty-five numbers per brand, small parts not counting as items."""
    return (
        t.table(spark, sf, "part").groupBy(F.col("p_brand").alias("venue_id"), F.floor(F.col("p_partkey") / 25).cast("int").alias("page_no"))
        .agg(F.sum("p_size").alias("total"), F.count_if(F.col("p_size") > 10).alias("items"))
    )


@query("page_concat", with_ctes(FETCHED_SQL, """ends AS (SELECT venue_id, min(page_no) AS e FROM (
    SELECT venue_id, page_no FROM fetched WHERE items = 0
    ) GROUP BY 1),
  used AS (SELECT venue_id, page_no, items FROM fetched LEFT JOIN ends USING (venue_id) WHERE e IS NULL OR page_no < e)
  SELECT venue_id, page_no, items, NULL AS error FROM used
  UNION ALL SELECT venue_id, page_no - 1, NULL, 'Page ' || (page_no - 1) || ' is missing' FROM used u
    WHERE page_no > 0 AND NOT EXISTS (SELECT 1 FROM fetched g WHERE g.venue_id = u.venue_id AND g.page_no = u.page_no - 1)"""))
def page_concat(spark, sf):
    """Every page before its venue's first empty one, and the pages missing on the way."""
    used = listings.pages_in_use(fetched_pages(spark, sf))
    missing = listings.missing_pages(used).withColumn("items", F.lit(None).cast("bigint"))
    return used.select("venue_id", "page_no", "items", F.lit(None).cast("string").alias("error")).unionByName(missing)


GUIDE_SQL = with_ctes(FETCHED_SQL, "guide AS (SELECT venue_id, page_no, 202600 + total % 12 + page_no AS last_month FROM fetched)")


def guide_pages(spark, sf):
    """The same pages as a month guide, each stating the last month it shows."""
    return fetched_pages(spark, sf).select(
        "venue_id", "page_no", (202600 + F.col("total") % 12 + F.col("page_no")).alias("last_month"), F.lit(202612).alias("guide_end")
    )


@query("page_progress", GUIDE_SQL + """
  SELECT g.venue_id, g.page_no, g.last_month, p.last_month AS before FROM guide g JOIN guide p ON p.venue_id = g.venue_id AND p.page_no = g.page_no - 1 WHERE g.last_month <= p.last_month""")
def page_progress(spark, sf):
    return listings.stalled_pages(guide_pages(spark, sf)).select("venue_id", "page_no", "last_month", "before")


@query("page_continue", GUIDE_SQL + "\n  SELECT venue_id, page_no FROM guide WHERE last_month < 202612")
def page_continue(spark, sf):
    return listings.continued_pages(guide_pages(spark, sf)).select("venue_id", "page_no")


STATUS_OF_PAGE = "CASE WHEN length(html) % 23 = 0 THEN 500 WHEN length(html) % 29 = 0 THEN 404 ELSE 200 END"
HOST_SQL = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


def answered_pages(spark, sf):
    n = F.length("html")
    return t.table(spark, sf, "pages").select(
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("venue_id"), "url", F.col("page_id").alias("page_no"),
        F.when(n % 23 == 0, 500).when(n % 29 == 0, 404).otherwise(200).alias("status"), F.col("html").alias("body"),
    )


ANSWERED_SQL = f"answered AS (SELECT {HOST_SQL} AS venue_id, url, page_id AS page_no, {STATUS_OF_PAGE} AS status FROM pages)"


@query("fetch_failures", with_ctes(ANSWERED_SQL, "SELECT venue_id, count(*) AS failed_pages, 'Failed to fetch ' || arg_min(url, page_no) || ': ' || arg_min(status, page_no) AS error FROM answered WHERE status <> 200 GROUP BY venue_id"))
def fetch_failures(spark, sf):
    return listings.failed_fetches(answered_pages(spark, sf))


@query("venue_isolation", with_ctes(ANSWERED_SQL, "SELECT venue_id, url FROM answered WHERE venue_id NOT IN (SELECT venue_id FROM answered WHERE status <> 200)"))
def venue_isolation(spark, sf):
    rows = answered_pages(spark, sf).select(
        "venue_id", "url", F.col("page_no").alias("listing_pos"), F.when(F.col("status") != 200, F.col("status").cast("string")).alias("error")
    )
    intact, _ = listings.isolate_failures(rows)
    return intact.select("venue_id", "url")


@query("api_nonempty", with_ctes(ANSWERED_SQL, "SELECT DISTINCT venue_id FROM answered WHERE venue_id NOT IN (SELECT venue_id FROM answered WHERE status = 404)"))
def api_nonempty(spark, sf):
    """Hosts whose payloads held no event, taking a missing page as the only one that does."""
    rows = answered_pages(spark, sf)
    return listings.silent_venues(rows, rows.where(F.col("status") == 404))


# --- payloads ---------------------------------------------------------------------------------


def search_bodies(spark, sf):
    """Every document as one search answer of two events, the second without tickets in part."""
    n = F.col("n_chars")
    act = lambda i: F.struct(F.concat(F.lit(f"a{i}-"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit(f"Act {i} of "), F.col("source")).alias("name"))
    url = F.concat(F.lit("https://www.ticketmaster.co.uk/e/"), F.col("doc_id").cast("string"), F.lit("?ref=x"))
    ticket = F.array(F.struct(url.alias("ticketUrl")))
    none = F.slice(ticket, 1, 0)
    html = F.concat(F.lit("<p><b>Hi</b> &amp; "), escaped_text(), F.lit("</p>"))
    copy = F.when(n % 3 == 0, F.lit("<p>Sorry, this show has been cancelled.</p>")).when(n % 3 == 1, F.lit(" <br> ")).otherwise(html)

    def event(number, tickets, copies):
        return F.struct(
            F.concat(F.lit(f"Event {number} "), F.col("lang")).alias("name"), F.lit("event").alias("encodedName"),
            F.concat(F.date_add(F.lit("2026-01-01").cast("date"), (n % 300).cast("int")).cast("string"), F.lit("T19:00:00")).alias("eventDate"),
            F.when(n % 2 == 0, "https://img.example.org/x.jpg").otherwise("").alias("image"), tickets.alias("tickets"),
            copies.alias("localizations"), F.array(F.struct(F.col("lang").alias("name"))).alias("genres"), F.array(act(1), act(2)).alias("lineup"),
        )

    copies = F.array(F.struct(copy.alias("description")))
    events = F.array(event(1, ticket, copies), event(2, F.when(n % 4 == 0, none).otherwise(ticket), F.slice(copies, 1, 0)))
    return docs(spark, sf).select(F.col("source").alias("venue_id"), "doc_id", F.to_json(F.struct(events.alias("documents"))).alias("body"))


SEARCHED_SQL = """searched AS (SELECT source AS venue_id, doc_id, lang, source, n_chars, text, unnest([0, 1]) AS item_no FROM documents)"""


@query("json_listing", with_ctes(SEARCHED_SQL, """SELECT venue_id, doc_id, item_no, 'Event ' || (item_no + 1) || ' ' || lang AS title, 'https://www.ticketmaster.co.uk/e/' || doc_id AS url,
    DATE '2026-01-01' + CAST(n_chars % 300 AS INTEGER) AS date, CASE WHEN n_chars % 2 = 0 THEN 'https://img.example.org/x.jpg' END AS poster_url
  FROM searched WHERE item_no = 0 OR n_chars % 4 <> 0"""))
def json_listing(spark, sf):
    events = payloads.search_events(search_bodies(spark, sf), ["venue_id", "doc_id"])
    return payloads.search_listing(events).select(
        "venue_id", "doc_id", "item_no", "title", "url", "date", "poster_url"
    )


@query("desc_fallback", with_ctes(SEARCHED_SQL, r"""SELECT doc_id, item_no, CASE WHEN item_no = 1 OR n_chars % 3 <> 2 THEN 'Lineup: Act 1 of ' || source || ', Act 2 of ' || source || '. Genre: ' || lang || '.'
    ELSE trim(regexp_replace('Hi & ' || text, '[\s\x{a0}]+', ' ', 'g')) END AS description FROM searched WHERE (item_no = 0 OR n_chars % 4 <> 0)"""))
def desc_fallback(spark, sf):
    """Each event's copy, or its acts and genres."""
    bodies = search_bodies(spark, sf)
    listed = payloads.search_listing(payloads.search_events(bodies, ["venue_id", "doc_id"]))
    return listed.select("doc_id", "item_no", "description")


@query("ticketless", with_ctes(SEARCHED_SQL, "SELECT venue_id, count(*) AS skipped FROM searched WHERE item_no = 1 AND n_chars % 4 = 0 GROUP BY venue_id"))
def ticketless(spark, sf):
    return payloads.ticketless_report(payloads.search_events(search_bodies(spark, sf), ["venue_id"]))


@query("ticketless_names", with_ctes(SEARCHED_SQL, "SELECT venue_id, doc_id, 'Event' || chr(160) || '2 ' || lang AS name FROM searched WHERE item_no = 1 AND n_chars % 4 = 0"))
def ticketless_names(spark, sf):
    """Each event that has no ticket link, by name."""
    events = payloads.search_events(search_bodies(spark, sf), ["venue_id", "doc_id"])
    return payloads.ticketless(events).select("venue_id", "doc_id", F.col("event.name").alias("name"))


def partner_bodies(spark, sf, *keep):
    """Every event as one partner answer: a gig at its instant, in the zone its user names."""
    e = F.struct(
        F.concat(F.lit("Gig  "), F.col("event_type")).alias("name"), F.concat(F.lit("gig-"), F.col("event_id").cast("string")).alias("perm_name"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("date"),
        F.when(F.col("user_id") % 2 == 0, "Europe/London").otherwise("America/New_York").alias("timezone"),
        F.array(F.concat(F.lit("https://img.example.org/"), F.col("user_id").cast("string"))).alias("images"), F.lit("copy").alias("raw_description"),
        F.when(F.col("event_type") == "error", "cancelled").otherwise("on-sale").alias("status"),
    )
    return t.table(spark, sf, "events").select(
        *keep, F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("venue_id"), F.to_json(F.struct(F.array(e).alias("data"), F.struct(F.lit(None).cast("string").alias("next")).alias("links"))).alias("body")
    )


@query("json_partner", """SELECT 'v' || user_id AS venue_id, 'gig-' || event_id AS perm_name, 'Gig ' || event_type || CASE WHEN event_type = 'error' THEN ' - CANCELLED' ELSE '' END AS title,
    CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE CASE WHEN user_id % 2 = 0 THEN 'Europe/London' ELSE 'America/New_York' END AS DATE) AS date, 'https://img.example.org/' || user_id AS poster_url FROM events""")
def json_partner(spark, sf):
    return payloads.partner_listing(partner_bodies(spark, sf), ["venue_id"]).select("venue_id", "perm_name", "title", "date", "poster_url")


def calendar_bodies(spark, sf):
    """Every order as a month's calendar of two events, some with ``false`` for a picture."""
    key, on = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    picture = F.when(F.col("o_orderstatus") == "F", F.lit("false")).otherwise(F.concat(F.lit('"https://img.example.org/'), key, F.lit('.jpg"')))
    event = lambda hour, category: F.concat(
        F.lit('{"Title":"Order '), key, F.lit('","URL":"https://www.ovoarena.co.uk/events/detail/'), F.col("o_custkey").cast("string"),
        F.lit('","StartDateTime":"'), on, F.lit(f'T{hour}:00:00","Category":"'), category, F.lit('","ImageURL":'), picture, F.lit("}"),
    )
    category = F.when(F.col("o_orderpriority").startswith("1"), "3").otherwise("9")
    body = F.concat(F.lit('{"events":['), event("14", F.lit("3")), F.lit(","), event("19", category), F.lit("]}"))
    return t.table(spark, sf, "orders").select("o_orderkey", F.lit("ovo-arena").alias("venue_id"), body.alias("body"))


CALENDAR_SQL = "calendar AS (SELECT *, unnest([0, 1]) AS item_no FROM orders)"


@query("json_tolerant", with_ctes(CALENDAR_SQL, "SELECT o_orderkey, item_no, CASE WHEN o_orderstatus <> 'F' THEN 'https://img.example.org/' || o_orderkey || '.jpg' END AS poster_url FROM calendar"))
def json_tolerant(spark, sf):
    events = payloads.calendar_events(calendar_bodies(spark, sf), ["o_orderkey"])
    return events.select("o_orderkey", "item_no", payloads.text_or_null(F.col("event.ImageURL")).alias("poster_url"))


@query("category_filter", with_ctes(CALENDAR_SQL, """SELECT o_orderkey, item_no, 'https://www.ovoarena.co.uk/events/detail/' || o_custkey || '#' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS url, CAST(o_orderdate AS DATE) AS date
  FROM calendar WHERE item_no = 0 OR starts_with(o_orderpriority, '1')"""))
def category_filter(spark, sf):
    events = payloads.calendar_events(calendar_bodies(spark, sf), ["o_orderkey"])
    return payloads.music_listing(events, ["o_orderkey"]).select("o_orderkey", "item_no", "url", "date")


@query("json_unwrap_html", "SELECT page_id, CASE WHEN length(html) % 7 IN (0, 1) THEN '' ELSE md5(html) END AS html_md5 FROM pages")
def json_unwrap_html(spark, sf):
    """Pages wrapped as JSON strings; some bodies are empty, some hold another JSON value."""
    n = F.length("html") % 7
    quoted = F.substring(F.to_json(F.struct(F.col("html").alias("h"))), 6, 1 << 30)
    quoted = F.regexp_replace(quoted, r"\}$", "")
    body = F.when(n == 0, F.lit("  ")).when(n == 1, F.lit("false")).otherwise(F.concat(F.lit(" "), quoted))
    html = payloads.unwrapped_html(body)
    return t.table(spark, sf, "pages").select("page_id", F.when(html == "", "").otherwise(F.md5(html)).alias("html_md5"))
