"""Queries over the quality checks, the gate, and relisting."""

from __future__ import annotations

from pyspark.sql import functions as F

from listinglake.catalog.registry import query, with_ctes
from listinglake.model import KEY
from listinglake.operators import relisting
from listinglake.operators.quality import contamination, gate, group_checks
from listinglake.operators.quality.batch import Batch, gig_print
from listinglake.sources import testviews as t

TODAY = "2026-01-03"

# One row per listing row with what the text checks read, in SQL.
BLANK = r"NOT regexp_matches({0}, '[^\s\x0b\p{{Z}}\x1c-\x1f\x{{85}}]')"
STRIPPED = r"regexp_replace({0}, '^[\s\x0b\p{{Z}}\x1c-\x1f\x{{85}}]+|[\s\x0b\p{{Z}}\x1c-\x1f\x{{85}}]+$', '', 'g')"
WORDS = "list_filter(string_split_regex(" + STRIPPED + r", '[\s\x0b]+'), lambda w: w <> '')"
UNITS = r"(length({0}) + length(regexp_replace({0}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def sql_marker(text: str) -> str:
    return (
        rf"CASE WHEN regexp_matches({text}, '(?i)</?(?:a|p|br|div|span|img|li|ul|ol|em|strong|b|i|h[1-6]|iframe|script|table|tr|td|figure|blockquote)\b[^<>]*>') THEN 'unparsed markup'"
        rf" WHEN regexp_matches({text}, '&(?:[a-zA-Z][a-zA-Z0-9]{{1,31}}|#\d{{1,7}}|#[xX][0-9a-fA-F]{{1,6}});') THEN 'an html entity'"
        rf" WHEN regexp_matches({text}, '[\x{{c3}}\x{{c2}}][\x{{80}}-\x{{bf}}]|\x{{e2}}\x{{20ac}}.') THEN 'mis-decoded characters' END"
    )


REASON = (
    f"CASE WHEN {UNITS.format('title')} > 200 THEN 'title of ' || {UNITS.format('title')} || ' chars'"
    f" WHEN {BLANK.format('description')} THEN 'no description'"
    r" WHEN starts_with(description, '{') OR regexp_matches(description, '(?i)we use cookies|allow the use of cookies|enable j(ava)?s(cript)?\b') THEN 'description is a cookie or bot wall, not gig copy'"
    f" WHEN {UNITS.format('description')} > 10000 THEN 'description of ' || {UNITS.format('description')} || ' chars' END"
)
FACTS_SQL = f"""facts AS (SELECT *, row(url, title, date, poster_url, description) AS gig, {REASON} AS reason,
    {sql_marker('title')} AS title_marker, {sql_marker('description')} AS copy_marker, {BLANK.format('description')} AS blank FROM listing)"""

EMPTY_SQL = """c1 AS (SELECT s.venue_id, 'empty' AS problem,
    CASE WHEN h.n IS NULL THEN 'listed nothing, and the log holds no gigs for it either' ELSE 'listed nothing, though the log holds ' || h.n || ' gig(s) for it' END AS detail
  FROM scraped_venues s LEFT JOIN (SELECT venue_id, count(*) AS n FROM previous GROUP BY 1) h USING (venue_id)
  WHERE s.venue_id NOT IN (SELECT venue_id FROM listing))"""
MISSHAPEN_SQL = "c2 AS (SELECT venue_id, reason AS problem, reason AS detail, gig, listing_pos, url FROM facts WHERE reason IS NOT NULL)"
UNPARSED_SQL = """c3 AS (SELECT venue_id, 'title holds ' || title_marker AS problem, 'title holds ' || title_marker AS detail, gig, listing_pos, url FROM facts WHERE title_marker IS NOT NULL),
c3d AS (SELECT venue_id, 'description holds ' || copy_marker AS problem,
    count(*) || ' description(s) hold ' || copy_marker || ', e.g. ' || arg_min(url, listing_pos) AS detail FROM facts WHERE copy_marker IS NOT NULL GROUP BY venue_id, copy_marker)"""
DUPLICATE_SQL = """c4 AS (SELECT f.venue_id, f.url AS problem, g.detail, gig, listing_pos, f.url FROM facts f JOIN (
    SELECT venue_id, url, 'listed ' || count(*) || ' times' || CASE WHEN count(DISTINCT gig) > 1 THEN ', and not identically' ELSE '' END AS detail
    FROM facts GROUP BY 1, 2 HAVING count(*) > 1) g USING (venue_id, url))"""
CROWDED_SQL = """c5 AS (SELECT f.venue_id, CAST(f.date AS VARCHAR) AS problem, g.n || ' gig(s) on ' || CAST(f.date AS VARCHAR) AS detail, gig, listing_pos, url
  FROM facts f JOIN (SELECT venue_id, date, count(*) AS n FROM facts GROUP BY 1, 2 HAVING count(*) > 5) g USING (venue_id, date))"""
POSTER_SQL = """c6 AS (SELECT f.venue_id, f.poster_url AS problem, g.n || ' gig(s) share ' || list_last(string_split(split_part(f.poster_url, '?', 1), '/')) AS detail, gig, listing_pos, url
  FROM facts f JOIN (SELECT venue_id, poster_url, count(*) AS n FROM facts GROUP BY 1, 2 HAVING count(*) > 20) g USING (venue_id, poster_url))"""
_TITLE_WORDS = "list_distinct(list_filter(list_transform(" + WORDS.format("lower(title)") + r", lambda w: regexp_replace(w, '[^\p{L}\p{Nd}]', '', 'g')), lambda w: w <> ''))"
_QUOTED = "array_to_string(" + WORDS.format("any_value(description)") + ", ' ')"
_SHORTENED = f"""CASE WHEN {UNITS.format(_QUOTED)} <= 60 THEN '"' || {_QUOTED} || '"'
      ELSE '"' || list_last(list_filter(list_transform(range(0, 61), lambda i: left({_QUOTED}, i)), lambda part: {UNITS.format('part')} <= 60)) || '..."' END"""
COPY_SQL = f"""same_copy AS (SELECT venue_id, description, count(*) AS n,
    {_SHORTENED} AS detail
  FROM facts WHERE NOT blank GROUP BY venue_id, description HAVING count(*) > 1),
common AS (SELECT DISTINCT venue_id, description FROM (
    SELECT f.venue_id, f.description, unnest({_TITLE_WORDS}) AS word FROM facts f WHERE NOT blank)
  GROUP BY venue_id, description, word HAVING count(*) = (SELECT n FROM same_copy s WHERE s.venue_id = any_value(venue_id) AND s.description = any_value(description))),
c7 AS (SELECT f.venue_id, md5(f.description) AS problem, s.detail, gig, listing_pos, url FROM facts f JOIN same_copy s USING (venue_id, description)
  WHERE NOT EXISTS (SELECT 1 FROM common c WHERE c.venue_id = f.venue_id AND c.description = f.description))"""
COPY_SQL = COPY_SQL.replace(
    """  GROUP BY venue_id, description, word HAVING count(*) = (SELECT n FROM same_copy s WHERE s.venue_id = any_value(venue_id) AND s.description = any_value(description))),""",
    """  JOIN same_copy s USING (venue_id, description) GROUP BY venue_id, description, word, s.n HAVING count(*) = s.n),""",
)
CONTAMINATION_SQL = f"""rows_of AS (SELECT venue_id, count(*) AS n FROM facts WHERE NOT blank GROUP BY 1 HAVING count(*) >= 3),
texts AS (SELECT venue_id, gig, n, min(listing_pos) AS listing_pos, {WORDS.format('any_value(description)')} AS w FROM facts JOIN rows_of USING (venue_id) WHERE NOT blank GROUP BY venue_id, gig, n),
grams AS (SELECT venue_id, listing_pos, n, len(w) AS n_words, unnest(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i+5], ' '))) AS gram FROM texts WHERE len(w) >= 6),
shared AS (SELECT venue_id, gram FROM (SELECT DISTINCT venue_id, listing_pos, n, gram FROM grams) GROUP BY venue_id, n, gram HAVING count(*) >= greatest(2, ceil(n / 2.0))),
marked AS (SELECT venue_id, listing_pos, n_words, count(*) AS times FROM grams SEMI JOIN shared USING (venue_id, gram) GROUP BY 1, 2, 3 HAVING least(count(*) * 6, n_words) / n_words >= 0.5),
c8 AS (SELECT f.venue_id, 'shared text' AS problem, m.affected || ' of ' || s.n || ' gig(s) mostly shared text' AS detail, gig, listing_pos, url
  FROM facts f JOIN (SELECT venue_id, count(*) AS affected FROM marked GROUP BY 1) m USING (venue_id) JOIN (SELECT venue_id, count(*) AS n FROM facts GROUP BY 1) s USING (venue_id))"""


def summed(claims: str) -> str:
    return f"SELECT venue_id, detail, count(DISTINCT gig) AS n_gigs, arg_min(url, listing_pos) AS first_url FROM {claims} GROUP BY venue_id, problem, detail"


def batch_of(spark, sf, view=t.listing):
    return Batch.of(view(spark, sf), t.scraped_venues(spark, sf), t.previous(spark, sf))


def checked(spark, sf, order: int, view=t.listing):
    claims = gate.claims_of(batch_of(spark, sf, view), [c for c in gate.CHECKS if c.order == order])
    return gate.problems_of(claims).select("venue_id", "detail", "n_gigs", "first_url")


BATCH_SQL = [t.LISTING_SQL, t.SCRAPED_VENUES_SQL, t.PREVIOUS_SQL]


@query("chk_empty", with_ctes(*BATCH_SQL, EMPTY_SQL, "SELECT venue_id, detail, 0 AS n_gigs, NULL AS first_url FROM c1"))
def chk_empty(spark, sf):
    return checked(spark, sf, 1)


@query("chk_misshapen", with_ctes(t.LISTING_SQL, FACTS_SQL, MISSHAPEN_SQL, summed("c2")))
def chk_misshapen(spark, sf):
    return checked(spark, sf, 2)


@query("chk_unparsed", with_ctes(t.LISTING_OF_PAGES_SQL, FACTS_SQL, UNPARSED_SQL, summed("c3") + " UNION ALL SELECT venue_id, detail, 0, NULL FROM c3d"))
def chk_unparsed(spark, sf):
    return checked(spark, sf, 3, t.listing_of_pages)


@query("chk_duplicate", with_ctes(t.LISTING_BY_LENGTH_SQL, FACTS_SQL, DUPLICATE_SQL, summed("c4")))
def chk_duplicate(spark, sf):
    return checked(spark, sf, 4, t.listing_by_length)


@query("chk_crowded", with_ctes(t.LISTING_SQL, FACTS_SQL, CROWDED_SQL, summed("c5")))
def chk_crowded(spark, sf):
    return checked(spark, sf, 5)


@query("chk_shared_poster", with_ctes(t.LISTING_SQL, FACTS_SQL, POSTER_SQL, summed("c6")))
def chk_shared_poster(spark, sf):
    return checked(spark, sf, 6)


@query("chk_shared_desc", with_ctes(t.LISTING_BY_LANG_SQL, FACTS_SQL, COPY_SQL, summed("c7")))
def chk_shared_desc(spark, sf):
    return checked(spark, sf, 7, t.listing_by_lang)


@query("chk_contamination", with_ctes(t.LISTING_OF_PAGES_SQL, FACTS_SQL, CONTAMINATION_SQL, summed("c8")))
def chk_contamination(spark, sf):
    return checked(spark, sf, 8, t.listing_of_pages)


@query("contaminated_gigs", with_ctes(t.LISTING_OF_PAGES_SQL, FACTS_SQL, CONTAMINATION_SQL, "SELECT venue_id, listing_pos, n_words, times FROM marked"))
def contaminated_gigs(spark, sf):
    listing = t.listing_of_pages(spark, sf).withColumn("gig", gig_print())
    return contamination.contaminated(listing).select("venue_id", "listing_pos", "n_words", "times")


BULK_SQL = """listing AS (SELECT n_name AS venue_id, CAST(l_shipdate AS DATE) AS date FROM lineitem
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""


@query("crowded_bulk", with_ctes(BULK_SQL, "SELECT venue_id, date, count(*) AS n FROM listing GROUP BY 1, 2 HAVING count(*) > 5"))
def crowded_bulk(spark, sf):
    """The crowded-day rule over the largest table, its suppliers' nations as venues.

    Lines are counted per supplier and day before they meet the supplier's nation.
    """
    lines = t.table(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    nations = t.table(spark, sf, "supplier").join(t.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    placed = lines.join(nations.select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("venue_id")), "l_suppkey")
    return placed.groupBy("venue_id", "date").agg(F.sum("n").alias("n")).where(F.col("n") > group_checks.MAX_ON_A_DAY)


def _claims_sql() -> str:
    parts = ["SELECT 1 AS ord, venue_id, problem, detail, NULL AS gig, NULL AS listing_pos, NULL AS url FROM c1",
             "SELECT 3, venue_id, problem, detail, NULL, NULL, NULL FROM c3d"]
    parts += [f"SELECT {n}, venue_id, problem, detail, gig, listing_pos, url FROM c{n}" for n in range(2, 9)]
    return "claims AS (" + " UNION ALL ".join(parts) + ")"


GATE_SQL = [*BATCH_SQL, FACTS_SQL, EMPTY_SQL, MISSHAPEN_SQL, UNPARSED_SQL, DUPLICATE_SQL, CROWDED_SQL, POSTER_SQL, COPY_SQL, CONTAMINATION_SQL, _claims_sql()]


@query("quality_report", with_ctes(*GATE_SQL, """spoken AS (SELECT *, CASE WHEN gig IS NULL THEN ord ELSE min(ord) OVER (PARTITION BY venue_id, gig) END AS first_ord FROM claims)
  SELECT ord AS check_ord, venue_id, detail, count(DISTINCT gig) AS n_gigs, arg_min(url, listing_pos) AS first_url
  FROM spoken GROUP BY ord, venue_id, problem, detail HAVING bool_or(first_ord >= ord)"""))
def quality_report(spark, sf):
    claims = gate.claims_of(batch_of(spark, sf))
    return gate.report(claims).select("check_ord", "venue_id", "detail", "n_gigs", "first_url")


@query("withheld", with_ctes(*GATE_SQL, "SELECT venue_id, url, listing_pos FROM listing WHERE venue_id IN (SELECT venue_id FROM claims WHERE gig IS NOT NULL)"))
def withheld(spark, sf):
    batch = batch_of(spark, sf)
    failed = gate.failing(batch)
    return gate.withheld(batch.listing, failed).select(*KEY, "listing_pos")


@query("problem_valid", with_ctes(*GATE_SQL, "SELECT venue_id, detail FROM claims WHERE gig IS NOT NULL AND length(url) % 3 = 0"))
def problem_valid(spark, sf):
    """Problems naming a gig that the venue did not list; a third of the claims are spoilt so, the others are not."""
    batch = batch_of(spark, sf)
    spoilt = F.when(F.length("url") % 3 == 0, F.concat("gig", F.lit("x"))).otherwise(F.col("gig"))
    claims = gate.claims_of(batch).withColumn("gig", spoilt)
    return gate.misplaced_claims(claims, batch.facts).select("venue_id", "detail")


MISSING_SQL = f"missing AS (SELECT p.* FROM previous p WHERE date >= DATE '{TODAY}' AND NOT EXISTS (SELECT 1 FROM listing l WHERE l.venue_id = p.venue_id AND l.url = p.url))"
_SIM_WORDS = r"list_distinct(list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 2))"
ALIKE_SQL = f"""sides AS (SELECT m.venue_id, m.url, m.date, l.url AS by_url, l.listing_pos, m.poster_url = l.poster_url AS same_poster,
    {_SIM_WORDS.format('m.title')} AS mw, {_SIM_WORDS.format('l.title')} AS lw
  FROM missing m JOIN listing l ON l.venue_id = m.venue_id AND l.date = m.date),
scored AS (SELECT *, CASE WHEN len(mw) = 0 OR len(lw) = 0 THEN 0.0 ELSE len(list_intersect(mw, lw)) / CAST(len(list_distinct(list_concat(mw, lw))) AS DOUBLE) END AS similarity FROM sides),
alike AS (SELECT venue_id, url, date, by_url, similarity FROM scored WHERE similarity >= 0.4 OR same_poster
  QUALIFY row_number() OVER (PARTITION BY venue_id, url ORDER BY similarity DESC, listing_pos) = 1)"""
VERDICT_SQL = """verdict AS (SELECT url, CASE WHEN status BETWEEN 300 AND 399 AND location IS NOT NULL THEN 'moved' WHEN status IN (404, 410) THEN 'gone' ELSE 'live' END AS verdict,
    CASE WHEN status BETWEEN 300 AND 399 AND location IS NOT NULL THEN regexp_extract(url, '^(https?://[^/]+)', 1) || location END AS moved_to FROM url_status)"""


@query("missing_gigs", with_ctes(*BATCH_SQL, MISSING_SQL, "SELECT venue_id, url, date FROM missing"))
def missing_gigs(spark, sf):
    today = F.lit(TODAY).cast("date")
    return relisting.missing_gigs(t.listing(spark, sf), t.previous(spark, sf), today).select(*KEY, "date")


@query("lookalikes", with_ctes(*BATCH_SQL, MISSING_SQL, ALIKE_SQL, "SELECT venue_id, url, date, by_url, round(similarity, 6) AS similarity FROM alike"))
def lookalikes(spark, sf):
    listing = t.listing(spark, sf)
    missing = relisting.missing_gigs(listing, t.previous(spark, sf), F.lit(TODAY).cast("date"))
    return relisting.lookalikes(listing, missing).withColumn("similarity", F.round("similarity", 6))


@query("url_verdict", with_ctes(t.LISTING_SQL, t.URL_STATUS_SQL, VERDICT_SQL, "SELECT * FROM verdict"))
def url_verdict(spark, sf):
    return relisting.url_verdict(t.url_status(spark, sf))


@query("replacements", with_ctes(*GATE_SQL, t.URL_STATUS_SQL, VERDICT_SQL, """failed AS (SELECT DISTINCT venue_id FROM claims WHERE gig IS NOT NULL)""",
    MISSING_SQL, ALIKE_SQL, """settled AS (SELECT a.venue_id, a.url, CASE v.verdict WHEN 'gone' THEN a.by_url
      WHEN 'moved' THEN (SELECT max(l.url) FROM listing l WHERE l.venue_id = a.venue_id AND l.url = v.moved_to) END AS by_url
    FROM alike a JOIN verdict v USING (url) WHERE a.venue_id NOT IN (SELECT venue_id FROM failed))
  SELECT venue_id, url, venue_id AS by_venue_id, by_url FROM settled WHERE by_url IS NOT NULL"""))
def replacements(spark, sf):
    """Relisting over the venues that passed the gate."""
    batch = batch_of(spark, sf)
    failed = gate.failing(batch)
    return relisting.replacements(
        gate.passed(batch.listing, failed), gate.passed(batch.previous, failed),
        t.url_status(spark, sf), F.lit(TODAY).cast("date"),
    )


