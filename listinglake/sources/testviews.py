"""The driver's tables read as a log, a listing, fetched pages and verdicts.

Every row of the source table becomes a row of the view, so work grows with the tables. Each view
has a twin in SQL (the ``*_SQL`` texts, one common table expression each) that the checks run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listinglake.classify_rates import TEXT_MODEL, VISION_MODEL
from listinglake.model import LOG_COLUMNS
from listinglake.venues import VENUE_IDS


# The largest tables, with the key their rows are spread by on a local master.
_LARGE = {"documents": "doc_id", "pages": "page_id", "lineitem": "l_orderkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables.

    They are single files of one row group, which a local run would read and parse in one task, so
    there the large ones are dealt out to the cores first. A cluster reads many files as they are.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    context = spark.sparkContext
    if name in _LARGE and context.master.startswith("local"):
        return df.repartition(context.defaultParallelism, _LARGE[name])
    return df


def _venue_of(number: Column) -> Column:
    ids = F.array(*[F.lit(v) for v in VENUE_IDS])
    return F.element_at(ids, (number % len(VENUE_IDS) + 1).cast("int"))


_VENUE_LIST_SQL = "[" + ", ".join(f"'{v}'" for v in VENUE_IDS) + "]"


def _gig_url(user: Column, k: Column) -> Column:
    return F.concat(F.lit("https://gigs.example.org/u"), user.cast("string"), F.lit("/"), k.cast("string"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log: every event is one entry, its kind set by event type and value."""
    v, user = F.col("v"), F.col("user_id")
    k = F.col("k")
    kind, is_kind = F.col("_type"), lambda name: F.col("_type") == name
    llm = is_kind("classified") & (F.col("event_type") == "purchase")
    base = (
        table(spark, sf_dir, "events")
        .withColumn("k", F.get_json_object("props", "$.k").cast("int") % 30)
        .withColumn("v", F.floor("value").cast("bigint"))
        .withColumn(
            "_type",
            F.when(F.col("event_type") == "purchase", "classified")
            .when((F.col("event_type") == "signup") & (v < 6), "classified")
            .when((F.col("event_type") == "error") & (v < 9) & (k == 29), "rendered")
            .when((F.col("event_type") == "error") & (v < 9), "replaced")
            .otherwise("observed"),
        )
    )
    has_key, observed = kind != "rendered", is_kind("observed")
    return base.select(
        kind,
        F.col("event_id").alias("seq"),
        F.col("ts").alias("recorded_at"),
        F.when(has_key, _venue_of(user)).alias("venue_id"),
        F.when(has_key, _gig_url(user, k)).alias("url"),
        F.when(observed, F.concat(F.lit("Show "), k.cast("string"), F.lit(" part "), (v % 40).cast("string"))).alias("title"),
        F.when(
            observed,
            F.date_add(F.lit("2024-01-01").cast("date"), ((user * 7 + k * 13 + v % 3) % 700).cast("int")),
        ).alias("date"),
        F.when(
            observed,
            F.concat(
                F.lit("https://img.example.org/"), (user % 50).cast("string"), F.lit("-"),
                (k % 4).cast("string"), F.lit(".png?w=300"),
            ),
        ).alias("poster_url"),
        F.when(
            observed,
            F.when(v < 2, F.lit("")).otherwise(F.concat(F.lit("Doors at "), (v % 12).cast("string"))),
        ).alias("description"),
        F.when(is_kind("classified"), F.when(v % 2 == 0, "Metal").otherwise("Other")).alias("genre"),
        F.when(is_kind("classified"), F.when(llm, "LLM").otherwise("User")).alias("source"),
        F.when(llm, F.when(v < 5, VISION_MODEL).otherwise(TEXT_MODEL)).alias("llm_model"),
        F.when(llm, v < 5).alias("use_vision"),
        F.when(llm & (v < 60), (v * 10 + 100).cast("int")).alias("input_tokens"),
        F.when(llm & (v < 60), F.lit(5)).alias("output_tokens"),
        F.when(is_kind("replaced"), _venue_of(user)).alias("by_venue_id"),
        F.when(is_kind("replaced"), _gig_url(user, k + 1)).alias("by_url"),
        F.when(is_kind("rendered"), F.concat(F.lit("render-"), F.col("event_id").cast("string"), F.lit(".html"))).alias("file"),
        F.when(is_kind("rendered"), v.cast("int")).alias("gig_count"),
        F.when(is_kind("rendered"), F.col("ts").cast("date")).alias("logical_date"),
    ).select(*LOG_COLUMNS)


LOG_SQL = f"""log AS (
  SELECT _type, event_id AS seq, ts AS recorded_at,
    CASE WHEN _type <> 'rendered' THEN ({_VENUE_LIST_SQL})[CAST(user_id % {len(VENUE_IDS)} AS INTEGER) + 1] END AS venue_id,
    CASE WHEN _type <> 'rendered' THEN 'https://gigs.example.org/u' || user_id || '/' || k END AS url,
    CASE WHEN _type = 'observed' THEN 'Show ' || k || ' part ' || (v % 40) END AS title,
    CASE WHEN _type = 'observed' THEN DATE '2024-01-01' + CAST((user_id * 7 + k * 13 + v % 3) % 700 AS INTEGER) END AS date,
    CASE WHEN _type = 'observed' THEN 'https://img.example.org/' || (user_id % 50) || '-' || (k % 4) || '.png?w=300' END AS poster_url,
    CASE WHEN _type = 'observed' THEN CASE WHEN v < 2 THEN '' ELSE 'Doors at ' || (v % 12) END END AS description,
    CASE WHEN _type = 'classified' THEN CASE WHEN v % 2 = 0 THEN 'Metal' ELSE 'Other' END END AS genre,
    CASE WHEN _type = 'classified' THEN CASE WHEN event_type = 'purchase' THEN 'LLM' ELSE 'User' END END AS source,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN v < 5 THEN '{VISION_MODEL}' ELSE '{TEXT_MODEL}' END END AS llm_model,
    CASE WHEN event_type = 'purchase' THEN v < 5 END AS use_vision,
    CASE WHEN event_type = 'purchase' AND v < 60 THEN v * 10 + 100 END AS input_tokens,
    CASE WHEN event_type = 'purchase' AND v < 60 THEN 5 END AS output_tokens,
    CASE WHEN _type = 'replaced' THEN ({_VENUE_LIST_SQL})[CAST(user_id % {len(VENUE_IDS)} AS INTEGER) + 1] END AS by_venue_id,
    CASE WHEN _type = 'replaced' THEN 'https://gigs.example.org/u' || user_id || '/' || (k + 1) END AS by_url,
    CASE WHEN _type = 'rendered' THEN 'render-' || event_id || '.html' END AS file,
    CASE WHEN _type = 'rendered' THEN v END AS gig_count,
    CASE WHEN _type = 'rendered' THEN CAST(ts AS DATE) END AS logical_date
  FROM (
    SELECT *, CASE WHEN event_type = 'purchase' THEN 'classified'
        WHEN event_type = 'signup' AND v < 6 THEN 'classified'
        WHEN event_type = 'error' AND v < 9 AND k = 29 THEN 'rendered'
        WHEN event_type = 'error' AND v < 9 THEN 'replaced'
        ELSE 'observed' END AS _type
    FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 30 AS k,
                 CAST(floor(value) AS BIGINT) AS v FROM events)))"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as one scrape's listing: English sources make large venues, others small ones."""
    n = F.col("n_chars")
    block = F.when(F.col("lang") == "en", F.floor(F.col("doc_id") / 1000)).otherwise(F.floor(F.col("doc_id") / 200))
    return table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "lang", "source", block.cast("string")).alias("venue_id"),
        F.col("doc_id").alias("listing_pos"),
        F.concat(F.lit("https://listings.example.org/doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.element_at(F.split("text", "\n"), 1).alias("title"),
        F.date_add(F.lit("2026-01-01").cast("date"), (n % 10).cast("int")).alias("date"),
        F.concat(
            F.lit("https://img.example.org/art/p"),
            F.when(n % 4 < 3, F.lit(0)).otherwise(n % 7).cast("string"),
            F.lit(".jpg?w=300"),
        ).alias("poster_url"),
        F.col("text").alias("description"),
    )


LISTING_SQL = """listing AS (
  SELECT lang || '/' || source || '/' || (doc_id // CASE WHEN lang = 'en' THEN 1000 ELSE 200 END) AS venue_id,
    doc_id AS listing_pos, 'https://listings.example.org/doc/' || doc_id AS url,
    split_part(text, chr(10), 1) AS title,
    DATE '2026-01-01' + CAST(n_chars % 10 AS INTEGER) AS date,
    'https://img.example.org/art/p' || (CASE WHEN n_chars % 4 < 3 THEN 0 ELSE n_chars % 7 END) || '.jpg?w=300' AS poster_url,
    text AS description
  FROM documents)"""


def listing_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` under venues that are whole languages, every title without a shared word."""
    base = listing(spark, sf_dir)
    return base.withColumn("venue_id", F.substring_index("venue_id", "/", 1)).withColumn(
        "title", F.concat(F.lit("t"), F.col("listing_pos").cast("string"))
    )


LISTING_BY_LANG_SQL = """listing AS (
  SELECT lang AS venue_id, doc_id AS listing_pos, 'https://listings.example.org/doc/' || doc_id AS url,
    't' || doc_id AS title, DATE '2026-01-01' + CAST(n_chars % 10 AS INTEGER) AS date,
    'https://img.example.org/art/p' || (CASE WHEN n_chars % 4 < 3 THEN 0 ELSE n_chars % 7 END) || '.jpg?w=300' AS poster_url,
    text AS description
  FROM documents)"""

# Tags, comments and script/style bodies, for text read from a page without building its tree.
NON_TEXT = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<[^>]*>"


def listing_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as a listing: the host is the venue, the raw title the title, the text the copy."""
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("venue_id"),
        F.col("page_id").alias("listing_pos"),
        "url",
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        F.date_add(F.lit("2026-01-01").cast("date"), (F.length("html") % 10).cast("int")).alias("date"),
        F.lit("https://img.example.org/page.jpg").alias("poster_url"),
        F.regexp_replace("html", NON_TEXT, " ").alias("description"),
    )


LISTING_OF_PAGES_SQL = r"""listing AS (
  SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS venue_id, page_id AS listing_pos, url,
    regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
    DATE '2026-01-01' + CAST(length(html) % 10 AS INTEGER) AS date,
    'https://img.example.org/page.jpg' AS poster_url,
    regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<[^>]*>', ' ', 'g') AS description
  FROM pages)"""


def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log held before: some gigs under the same url, the rest under one since dropped."""
    base = listing(spark, sf_dir)
    n = F.length("description")
    return base.select(
        F.when(F.col("venue_id").startswith("es/"), F.concat(F.lit("quiet/"), F.substring_index("venue_id", "/", 2)))
        .otherwise(F.col("venue_id")).alias("venue_id"),
        "listing_pos",
        F.when(n % 3 == 0, F.col("url")).otherwise(F.concat(F.col("url"), F.lit("-old"))).alias("url"),
        F.concat(F.col("title"), F.lit(" Revisited")).alias("title"),
        "date",
        F.when(n % 5 == 0, F.lit("https://img.example.org/art/new.jpg")).otherwise(F.col("poster_url")).alias("poster_url"),
        "description",
    )


PREVIOUS_SQL = """previous AS (
  SELECT CASE WHEN starts_with(venue_id, 'es/') THEN 'quiet/' || split_part(venue_id, '/', 1) || '/' || split_part(venue_id, '/', 2) ELSE venue_id END AS venue_id,
    listing_pos, CASE WHEN length(description) % 3 = 0 THEN url ELSE url || '-old' END AS url,
    title || ' Revisited' AS title, date,
    CASE WHEN length(description) % 5 = 0 THEN 'https://img.example.org/art/new.jpg' ELSE poster_url END AS poster_url,
    description
  FROM listing)"""


def scraped_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every venue asked: those with listings, and one per language and source that listed none."""
    docs = table(spark, sf_dir, "documents")
    quiet = docs.select(F.concat_ws("/", F.lit("quiet"), "lang", "source").alias("venue_id"))
    return listing(spark, sf_dir).select("venue_id").union(quiet).distinct()


SCRAPED_VENUES_SQL = """scraped_venues AS (
  SELECT venue_id FROM listing UNION SELECT 'quiet/' || lang || '/' || source FROM documents)"""


def url_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each dropped url answered: redirects with and without a target, gone, or still served."""
    n = F.length("description")
    base = listing(spark, sf_dir)
    return base.select(
        F.concat(F.col("url"), F.lit("-old")).alias("url"),
        F.when(n % 4 == 0, 301).when(n % 4 == 1, 404).when(n % 4 == 2, 410)
        .when(n % 8 == 3, 302).otherwise(200).alias("status"),
        F.when(n % 4 == 0, F.concat(F.lit("/doc/"), F.col("listing_pos").cast("string"))).alias("location"),
    )


URL_STATUS_SQL = """url_status AS (
  SELECT url || '-old' AS url,
    CASE WHEN length(description) % 4 = 0 THEN 301 WHEN length(description) % 4 = 1 THEN 404
         WHEN length(description) % 4 = 2 THEN 410 WHEN length(description) % 8 = 3 THEN 302 ELSE 200 END AS status,
    CASE WHEN length(description) % 4 = 0 THEN '/doc/' || listing_pos END AS location
  FROM listing)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` with ``documents`` as one run's classifications, model and user verdicts alike."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "n_chars",
        F.when(F.length("text") < 80, True).when(F.length("text") < 1000, False).alias("use_vision"),
    )
    user = F.col("toxic") == 1
    return (
        table(spark, sf_dir, "labels").join(docs, "doc_id")
        .select(
            F.col("doc_id").alias("seq"),
            F.concat(F.lit("https://listings.example.org/doc/"), F.col("doc_id").cast("string")).alias("url"),
            F.when(F.col("quality") == 1, "Metal").otherwise("Other").alias("genre"),
            F.when(user, "User").otherwise("LLM").alias("source"),
            F.when(~user, F.when(F.col("n_chars") % 2 == 0, VISION_MODEL).otherwise(TEXT_MODEL)).alias("llm_model"),
            F.when(~user, F.col("use_vision")).alias("use_vision"),
            F.when(~user & (F.col("n_chars") < 5000), F.col("n_chars").cast("int")).alias("input_tokens"),
            F.when(~user, F.lit(7)).alias("output_tokens"),
            F.when(F.col("n_chars") % 3 == 0, F.lit("2026-08-31 23:59:59"))
            .otherwise(F.lit("2026-09-01 00:00:00")).cast("timestamp_ntz").alias("recorded_at"),
        )
    )


VERDICTS_SQL = f"""verdicts AS (
  SELECT doc_id AS seq, 'https://listings.example.org/doc/' || doc_id AS url,
    CASE WHEN quality = 1 THEN 'Metal' ELSE 'Other' END AS genre,
    CASE WHEN toxic = 1 THEN 'User' ELSE 'LLM' END AS source,
    CASE WHEN toxic <> 1 THEN CASE WHEN n_chars % 2 = 0 THEN '{VISION_MODEL}' ELSE '{TEXT_MODEL}' END END AS llm_model,
    CASE WHEN toxic <> 1 THEN CASE WHEN length(text) < 80 THEN true WHEN length(text) < 1000 THEN false END END AS use_vision,
    CASE WHEN toxic <> 1 AND n_chars < 5000 THEN n_chars END AS input_tokens,
    CASE WHEN toxic <> 1 THEN 7 END AS output_tokens,
    CASE WHEN n_chars % 3 = 0 THEN TIMESTAMP '2026-08-31 23:59:59' ELSE TIMESTAMP '2026-09-01 00:00:00' END AS recorded_at
  FROM labels JOIN documents USING (doc_id))"""


def listing_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` keyed by language and length, so copies and chance matches share a key."""
    base = listing_by_lang(spark, sf_dir)
    return base.withColumn(
        "url", F.concat(F.lit("https://listings.example.org/len/"), F.length("description").cast("string"))
    ).withColumn("title", F.element_at(F.split("description", "\n"), 1))


LISTING_BY_LENGTH_SQL = LISTING_BY_LANG_SQL.replace(
    "'https://listings.example.org/doc/' || doc_id AS url", "'https://listings.example.org/len/' || length(text) AS url"
).replace("'t' || doc_id AS title", "split_part(text, chr(10), 1) AS title")
