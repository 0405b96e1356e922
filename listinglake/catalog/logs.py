"""Queries over the log: reading, projecting, sequencing, compacting."""

from __future__ import annotations

import re
import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from listinglake.catalog.registry import query, with_ctes
from listinglake.model import CLASSIFIED, GIG_FIELDS, KEY, KINDS, LOG_COLUMNS, OBSERVED, RENDERED, REPLACED
from listinglake.operators import compaction, projections as p
from listinglake.operators.sequencing import assign_sequence
from listinglake.session import durable, side_by_side, working_folder
from listinglake.sources import commits
from listinglake.sources import log as log_source
from listinglake.sources.testviews import LOG_SQL, log, table
from listinglake.venues import VENUES, unknown_venues, venues, with_venue_name

KEYS = "venue_id, url"
GIG = "venue_id, url, title, date, poster_url, description"

OBS_SQL = f"""newest AS (SELECT * FROM log WHERE _type = 'observed'
  QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY seq DESC) = 1)"""
CURRENT_SQL = OBS_SQL + f""",
current AS (SELECT {GIG}, seq FROM newest n WHERE NOT EXISTS (
  SELECT 1 FROM log r WHERE r._type = 'replaced' AND r.venue_id = n.venue_id AND r.url = n.url))"""
OWN_SQL = """own AS (SELECT venue_id, url, genre FROM log WHERE _type = 'classified'
  QUALIFY row_number() OVER (PARTITION BY venue_id, url ORDER BY source = 'User' DESC, seq DESC) = 1)"""
EDGES_SQL = """edges AS (SELECT by_venue_id AS venue_id, by_url AS url, venue_id AS old_venue, url AS old_url
  FROM log WHERE _type = 'replaced'
  QUALIFY row_number() OVER (PARTITION BY by_venue_id, by_url ORDER BY seq DESC) = 1)"""
USERS_SQL = "users AS (SELECT DISTINCT venue_id, url FROM log WHERE _type = 'classified' AND source = 'User')"


def walk_sql(known: str, name: str) -> str:
    """Recursive walk from each replacing key outside ``known`` to the first member of it.

    UNION drops what a walk has met before, so a cycle ends it.
    """
    return f"""{name}_walk(venue_id, url, old_venue, old_url) AS (
  SELECT venue_id, url, old_venue, old_url FROM edges
  WHERE NOT EXISTS (SELECT 1 FROM {known} k WHERE k.venue_id = edges.venue_id AND k.url = edges.url)
  UNION
  SELECT w.venue_id, w.url, e.old_venue, e.old_url FROM {name}_walk w
  JOIN edges e ON e.venue_id = w.old_venue AND e.url = w.old_url
  WHERE NOT EXISTS (SELECT 1 FROM {known} k WHERE k.venue_id = w.old_venue AND k.url = w.old_url)),
{name} AS (SELECT w.venue_id, w.url, w.old_venue AS from_venue_id, w.old_url AS from_url FROM {name}_walk w
  WHERE EXISTS (SELECT 1 FROM {known} k WHERE k.venue_id = w.old_venue AND k.url = w.old_url))"""


STATUS_SQL = ",\n".join([
    OWN_SQL, EDGES_SQL, walk_sql("own", "taken"),
    """status AS (SELECT * FROM own UNION ALL SELECT t.venue_id, t.url, o.genre FROM taken t
  JOIN own o ON o.venue_id = t.from_venue_id AND o.url = t.from_url)""",
])


def _rec(*parts: str) -> str:
    return with_ctes(*parts, recursive=True)


ALL = ", ".join(LOG_COLUMNS)


@query("log_read", with_ctes(LOG_SQL, f"SELECT {ALL} FROM log"))
def log_read(spark, sf):
    """The whole log written as JSON lines, read back with the explicit schema."""
    path = f"{working_folder(spark)}/log-json-{uuid.uuid4().hex}"
    log_source.as_json_text(log(spark, sf)).write.text(path)
    return log_source.read_json_log(spark, path).select(*LOG_COLUMNS)


VIEW_COLUMNS = {
    OBSERVED: ["seq", "recorded_at", *KEY, *GIG_FIELDS],
    CLASSIFIED: ["seq", "recorded_at", *KEY, "genre", "source", "llm_model", "use_vision", "input_tokens", "output_tokens"],
    REPLACED: ["seq", "recorded_at", *KEY, "by_venue_id", "by_url"],
    RENDERED: ["seq", "recorded_at", "file", "gig_count", "logical_date"],
}


def _view(kind):
    def run(spark, sf):
        return log_source.entries_of(log(spark, sf), kind).select(*VIEW_COLUMNS[kind])

    return run


for _kind in KINDS:
    query(
        f"log_view_{_kind}",
        with_ctes(LOG_SQL, f"SELECT {', '.join(VIEW_COLUMNS[_kind])} FROM log WHERE _type = '{_kind}'"),
    )(_view(_kind))


# every entry without its number gets the next one
APPENDED_SQL = f"SELECT * REPLACE (row_number() OVER (ORDER BY seq) - 1 AS seq) FROM (SELECT {ALL} FROM log)"


def _appended(spark, sf, read, append):
    """The log appended in two batches, the second numbered after the first, then read back."""
    path = f"{working_folder(spark)}/log-{uuid.uuid4().hex}"
    entries = durable(log(spark, sf).withColumn("position", F.col("seq")))
    half = entries.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    for part in (F.col("seq") <= half, F.col("seq") > half):
        append(read(spark, path), entries.where(part).withColumn("seq", F.lit(None).cast("bigint")), path)
    return read(spark, path).select(*LOG_COLUMNS)


@query("log_append", with_ctes(LOG_SQL, APPENDED_SQL))
def log_append(spark, sf):
    return _appended(spark, sf, log_source.read_log, log_source.append)


@query("log_append_json", with_ctes(LOG_SQL, APPENDED_SQL))
def log_append_json(spark, sf):
    """The same as JSON lines."""
    return _appended(spark, sf, log_source.read_json_log, log_source.append_json)


@query("append_concurrent", with_ctes(LOG_SQL, """numbered AS (SELECT * FROM log)
  SELECT _type, count(*) AS n, count(*) AS numbers, count(DISTINCT (venue_id, url)) AS keys, sum(length(title)) AS letters, true AS gapless, 3 AS commits FROM numbered GROUP BY _type"""))
def append_concurrent(spark, sf):
    """The log appended by three writers at once that all start from the same state; all land, and no number is taken twice."""
    path = f"{working_folder(spark)}/log-{uuid.uuid4().hex}"
    entries = durable(log(spark, sf).withColumn("position", F.col("seq")))
    part = lambda i: entries.where(F.col("seq") % 3 == i).withColumn("seq", F.lit(None).cast("bigint"))
    side_by_side([lambda i=i: commits.append_committed(spark, path, part(i)) for i in range(3)])
    whole = commits.snapshot(spark, path)
    landed = commits.read(spark, whole)
    ends = landed.agg(F.countDistinct("seq").alias("numbers"), F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    gapless = ends.numbers == whole.next_seq and (ends.low or 0) == 0 and (ends.high or 0) == max(whole.next_seq - 1, 0)
    return landed.groupBy("_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("numbers"), F.count_distinct(F.struct("venue_id", "url")).alias("keys"),
        F.sum(F.length("title")).alias("letters"),
    ).select("*", F.lit(gapless).alias("gapless"), F.lit(len(whole.batches)).alias("commits"))


@query("compact_swap", with_ctes(LOG_SQL, f"""numbered AS (SELECT * REPLACE (row_number() OVER (ORDER BY seq % 5 = 0, seq) - 1 AS seq), seq % 5 = 0 AS late FROM (SELECT {ALL} FROM log)),
early AS (SELECT * FROM numbered WHERE NOT late)
  SELECT {ALL} FROM numbered WHERE late OR _type IN ('rendered', 'replaced')
  UNION ALL SELECT {ALL} FROM early WHERE _type = 'observed' QUALIFY row_number() OVER (PARTITION BY venue_id, url ORDER BY seq DESC) = 1
  UNION ALL SELECT {ALL} FROM early WHERE _type = 'classified' QUALIFY row_number() OVER (PARTITION BY venue_id, url ORDER BY source = 'User' DESC, seq DESC) = 1"""))
def compact_swap(spark, sf):
    """A log whose files are swapped for their compaction, while a fifth of its entries is appended; read afterwards."""
    path = f"{working_folder(spark)}/log-{uuid.uuid4().hex}"
    entries = durable(log(spark, sf).withColumn("position", F.col("seq")))
    part = lambda late: entries.where((F.col("seq") % 5 == 0) == F.lit(late)).withColumn("seq", F.lit(None).cast("bigint"))
    commits.append_committed(spark, path, part(False))
    seen = commits.snapshot(spark, path)
    commits.append_committed(spark, path, part(True))
    commits.swap(spark, seen, compaction.compact(commits.read(spark, seen)))
    return commits.read_committed(spark, path)


@query("append_refused", with_ctes(LOG_SQL, r"""bad AS (SELECT * REPLACE (
    CASE WHEN seq % 7 = 0 AND venue_id IS NOT NULL THEN ' ' ELSE venue_id END AS venue_id,
    CASE WHEN seq % 7 = 1 AND url IS NOT NULL THEN '' ELSE url END AS url,
    CASE WHEN seq % 7 = 2 THEN title || ' ' ELSE title END AS title,
    CASE WHEN seq % 7 = 3 AND by_url IS NOT NULL THEN venue_id ELSE by_venue_id END AS by_venue_id,
    CASE WHEN seq % 7 = 3 AND by_url IS NOT NULL THEN url ELSE by_url END AS by_url) FROM log)
  SELECT seq, CASE WHEN seq % 7 = 0 THEN 'blank venue' WHEN seq % 7 = 1 THEN 'blank url'
    WHEN seq % 7 = 2 THEN 'title: spacing' ELSE 'replaced by itself' END AS problem
  FROM bad WHERE (seq % 7 IN (0, 1) AND _type <> 'rendered') OR (seq % 7 = 2 AND _type = 'observed') OR (seq % 7 = 3 AND _type = 'replaced')"""))
def append_refused(spark, sf):
    """Entries that a write refuses, and why; some of every kind are spoilt first."""
    entries, nth = log(spark, sf), F.col("seq") % 7
    own = (nth == 3) & F.col("by_url").isNotNull()
    bad = entries.select(
        "_type", "seq", "poster_url", F.when((nth == 0) & F.col("venue_id").isNotNull(), " ").otherwise(F.col("venue_id")).alias("venue_id"),
        F.when((nth == 1) & F.col("url").isNotNull(), "").otherwise(F.col("url")).alias("url"),
        F.when(nth == 2, F.concat("title", F.lit(" "))).otherwise(F.col("title")).alias("title"),
        F.when(own, F.col("venue_id")).otherwise(F.col("by_venue_id")).alias("by_venue_id"),
        F.when(own, F.col("url")).otherwise(F.col("by_url")).alias("by_url"),
    )
    return bad.select("seq", log_source.entry_problem().alias("problem")).where("problem IS NOT NULL")


@query("current_gigs", with_ctes(LOG_SQL, CURRENT_SQL, f"SELECT {GIG} FROM current"))
def current_gigs(spark, sf):
    return p.current_gigs(log(spark, sf)).select(*KEY, *GIG_FIELDS)


@query("latest_observation", with_ctes(LOG_SQL, OBS_SQL, f"SELECT {GIG}, seq FROM newest"))
def latest_observation(spark, sf):
    return p.latest_observations(log(spark, sf)).select(*KEY, *GIG_FIELDS, "seq")


def scraped_again(spark, sf):
    """Every observation of the log offered as a fresh scrape of its gig."""
    return log_source.entries_of(log(spark, sf), OBSERVED).select(*KEY, *GIG_FIELDS, "seq")


@query(
    "new_or_changed",
    with_ctes(LOG_SQL, CURRENT_SQL, """SELECT s.venue_id, s.url, s.title, s.date, s.seq FROM log s
  LEFT JOIN current c ON c.venue_id = s.venue_id AND c.url = s.url
  WHERE s._type = 'observed' AND (c.url IS NULL OR (s.title, s.date, s.poster_url, s.description)
    IS DISTINCT FROM (c.title, c.date, c.poster_url, c.description))"""),
)
def new_or_changed(spark, sf):
    changed = p.new_or_changed(scraped_again(spark, sf), p.current_gigs(log(spark, sf)))
    return changed.select(*KEY, "title", "date", "seq")


@query("last_scraped", with_ctes(LOG_SQL, "SELECT venue_id, max(recorded_at) AS last_scraped FROM log WHERE _type = 'observed' GROUP BY venue_id"))
def last_scraped(spark, sf):
    return p.last_scraped(log(spark, sf))


@query("effective_class", with_ctes(LOG_SQL, OWN_SQL, "SELECT * FROM own"))
def effective_class(spark, sf):
    return p.effective_verdicts(log(spark, sf))


@query("inherited", _rec(LOG_SQL, OWN_SQL, EDGES_SQL, walk_sql("own", "taken"), "SELECT * FROM taken"))
def inherited(spark, sf):
    entries = log(spark, sf)
    return p.inherited(entries, p.classified_keys(entries))


@query("class_status", _rec(LOG_SQL, STATUS_SQL, "SELECT venue_id, url, genre FROM status"))
def class_status(spark, sf):
    return p.class_status(log(spark, sf))


@query("metal_gigs", _rec(LOG_SQL, CURRENT_SQL, STATUS_SQL, f"SELECT {GIG} FROM current SEMI JOIN (SELECT venue_id, url FROM status WHERE genre = 'Metal') s USING (venue_id, url)"))
def metal_gigs(spark, sf):
    return p.metal_gigs(log(spark, sf)).select(*KEY, *GIG_FIELDS)


@query("already_classified", _rec(LOG_SQL, OWN_SQL, EDGES_SQL, walk_sql("own", "taken"), "SELECT venue_id, url FROM own UNION SELECT venue_id, url FROM taken"))
def already_classified(spark, sf):
    return p.already_classified(log(spark, sf))


@query("overridden", _rec(LOG_SQL, USERS_SQL, EDGES_SQL, walk_sql("users", "taken"), "SELECT * FROM users UNION SELECT venue_id, url FROM taken"))
def overridden(spark, sf):
    return p.overridden(log(spark, sf))


@query("gig_status", _rec(LOG_SQL, CURRENT_SQL, STATUS_SQL, "SELECT c.venue_id, c.url, c.date, coalesce(s.genre, 'Pending') AS status FROM current c LEFT JOIN status s USING (venue_id, url)"))
def gig_status(spark, sf):
    entries = log(spark, sf)
    return p.with_status(p.current_gigs(entries), p.class_status(entries)).select(*KEY, "date", "status")


@query("already_ingested", with_ctes(LOG_SQL, """posters AS (SELECT DISTINCT file AS source_url FROM (
    SELECT 'https://gigs.example.org/u' || user_id || '/' || (CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 30) AS file FROM events)),
  seen AS (SELECT DISTINCT url || '#gig-' || title AS url FROM log WHERE _type = 'observed')
  SELECT source_url FROM posters WHERE source_url IN (SELECT split_part(url, '#', 1) FROM seen)"""))
def already_ingested(spark, sf):
    """Which urls of the log were ingested as poster sources, every observation being one's gig."""
    entries = log(spark, sf)
    posters = table(spark, sf, "events").select(
        F.concat(F.lit("https://gigs.example.org/u"), F.col("user_id").cast("string"), F.lit("/"),
                 (F.get_json_object("props", "$.k").cast("int") % 30).cast("string")).alias("source_url")
    ).distinct()
    ingested = entries.withColumn("url", F.concat("url", F.lit("#gig-"), "title"))
    return p.already_ingested(ingested, posters)


@query("already_rendered", with_ctes(LOG_SQL, "SELECT DISTINCT CAST(ts AS DATE) AS logical_date FROM events WHERE CAST(ts AS DATE) IN (SELECT logical_date FROM log WHERE _type = 'rendered')"))
def already_rendered(spark, sf):
    days = table(spark, sf, "events").select(F.col("ts").cast("date").alias("logical_date")).distinct()
    return p.already_rendered(log(spark, sf), days)


@query("due_venues", with_ctes(LOG_SQL, """last AS (SELECT venue_id, max(recorded_at) AS seen FROM log WHERE _type = 'observed' GROUP BY venue_id),
  clock AS (SELECT make_timestamp(epoch_us(min(seen)) + (epoch_us(max(seen)) - epoch_us(min(seen))) // 2) + INTERVAL 1 DAY AS now FROM last)
  SELECT v.venue_id FROM (SELECT DISTINCT venue_id FROM log WHERE venue_id IS NOT NULL) v LEFT JOIN last l USING (venue_id), clock
  WHERE l.seen IS NULL OR NOT l.seen > clock.now - INTERVAL 1 DAY"""))
def due_venues(spark, sf):
    """Venues due a day after the middle between the first and the last venue's newest observation."""
    entries = log(spark, sf)
    seen = durable(p.last_scraped(entries))
    first, last = seen.agg(F.min("last_scraped"), F.max("last_scraped")).first()
    now = first + (last - first) // 2 + timedelta(days=1)
    asked = entries.where(F.col("venue_id").isNotNull()).select("venue_id").distinct()
    return p.due_venues(asked, seen, F.lit(now).cast("timestamp_ntz"))


_VENUE_VALUES = ", ".join("('{}', '{}')".format(v, n.replace("'", "''")) for v, n in VENUES)
VENUES_SQL = f"venues(venue_id, venue) AS (VALUES {_VENUE_VALUES})"


@query("venue_lookup", with_ctes(LOG_SQL, VENUES_SQL, "SELECT venue_id, venue, count(*) AS n FROM log JOIN venues USING (venue_id) GROUP BY ALL"))
def venue_lookup(spark, sf):
    named = with_venue_name(log(spark, sf).where(F.col("venue_id").isNotNull()))
    return named.groupBy("venue_id", "venue").agg(F.count(F.lit(1)).alias("n"))


@query("unknown_venues", with_ctes(LOG_SQL, VENUES_SQL, """asked AS (SELECT venue_id FROM log WHERE venue_id IS NOT NULL UNION SELECT source FROM documents)
  SELECT venue_id FROM asked WHERE venue_id NOT IN (SELECT venue_id FROM venues)"""))
def unknown(spark, sf):
    asked = log(spark, sf).where(F.col("venue_id").isNotNull()).select("venue_id").union(
        table(spark, sf, "documents").select("source")
    )
    return unknown_venues(asked, venues(spark))


@query("override_batch", with_ctes(LOG_SQL, CURRENT_SQL, """shared AS (SELECT * REPLACE (CASE WHEN seq % 5 = 0 THEN 'https://shared.example.org/' || (seq % 50) ELSE url END AS url) FROM log WHERE _type = 'observed'),
  gone AS (SELECT venue_id, url FROM log WHERE _type = 'replaced'),
  held AS (SELECT venue_id, url, min(seq) AS first_seq FROM shared s WHERE NOT EXISTS (SELECT 1 FROM gone r WHERE r.venue_id = s.venue_id AND r.url = s.url) GROUP BY 1, 2),
  firsts AS (SELECT url, arg_min(venue_id, first_seq) AS venue_id FROM held GROUP BY url)
  SELECT a.url, f.venue_id, 'Metal' AS genre, f.url IS NOT NULL AS applied FROM (SELECT DISTINCT url FROM shared) a LEFT JOIN firsts f ON a.url = f.url"""))
def override_batch(spark, sf):
    """Every url ever observed overridden to Metal; those no longer current are the rejects.

    A fifth of the observations are put under urls that several venues share.
    """
    entries = log(spark, sf)
    shared = (F.col("_type") == OBSERVED) & (F.col("seq") % 5 == 0)
    entries = entries.withColumn("url", F.when(shared, F.concat(F.lit("https://shared.example.org/"), (F.col("seq") % 50).cast("string"))).otherwise(F.col("url")))
    asked = log_source.entries_of(entries, OBSERVED).select("url").distinct().withColumn("genre", F.lit("Metal"))
    verdicts, rejects = p.override_batch(p.current_gigs(entries), asked)
    return verdicts.select("url", "venue_id", "genre", F.lit(True).alias("applied")).unionByName(
        rejects.select("url", F.lit(None).cast("string").alias("venue_id"), "genre", F.lit(False).alias("applied"))
    )


@query("seq_assign", """WITH batch AS (SELECT event_id AS position, CASE WHEN event_type = 'signup' THEN event_id * 2 + 10 END AS seq FROM events),
  bases AS (SELECT *, max(CASE WHEN seq IS NOT NULL THEN position END) OVER (ORDER BY position) AS at,
    sum(CASE WHEN seq IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY position) AS n FROM batch)
  SELECT b.position, CASE WHEN b.seq IS NOT NULL THEN b.seq WHEN b.at IS NULL THEN 4 + b.n
    ELSE f.seq + b.n - f.n END AS seq, true AS in_order
  FROM bases b LEFT JOIN bases f ON f.position = b.at""")
def seq_assign(spark, sf):
    """Every event numbered after entry 4; sign-ups bring a number of their own."""
    batch = table(spark, sf, "events").select(
        F.col("event_id").alias("position"),
        F.when(F.col("event_type") == "signup", F.col("event_id") * 2 + 10).alias("seq"),
    )
    return assign_sequence(batch, "position", 4)


@query("replace_valid", with_ctes(LOG_SQL, """turned AS (SELECT seq, venue_id, url, _type, CASE WHEN seq % 3 = 0 THEN venue_id ELSE by_venue_id END AS by_venue_id,
    CASE WHEN seq % 3 = 0 THEN url ELSE by_url END AS by_url FROM log)
  SELECT seq, venue_id, url FROM turned WHERE _type = 'replaced' AND venue_id = by_venue_id AND url = by_url"""))
def replace_valid(spark, sf):
    """Replacements of a key by itself, which a log must not hold; every third one is turned into one."""
    own = lambda name: F.when(F.col("seq") % 3 == 0, F.col(name)).otherwise(F.col(f"by_{name}"))
    turned = log(spark, sf).withColumns({"by_venue_id": own("venue_id"), "by_url": own("url")})
    return self_replacements(turned).select("seq", *KEY)


def self_replacements(entries):
    return log_source.entries_of(entries, REPLACED).where(log_source.replaces_itself())


COMPACT_SQL = """verdicts_kept AS (SELECT * FROM log WHERE _type = 'classified'
  QUALIFY row_number() OVER (PARTITION BY venue_id, url ORDER BY source = 'User' DESC, seq DESC) = 1),
compacted AS (SELECT * FROM newest UNION ALL SELECT * FROM verdicts_kept
  UNION ALL SELECT * FROM log WHERE _type IN ('rendered', 'replaced'))"""


@query("compact", with_ctes(LOG_SQL, OBS_SQL, COMPACT_SQL, f"SELECT {ALL} FROM compacted"))
def compact(spark, sf):
    return compaction.compact(log(spark, sf)).orderBy("seq").select(*LOG_COLUMNS)


@query("compact_summary", with_ctes(LOG_SQL, OBS_SQL, COMPACT_SQL, """SELECT _type, b.n AS before, coalesce(a.n, 0) AS after, b.n - coalesce(a.n, 0) AS dropped
  FROM (SELECT _type, count(*) AS n FROM log GROUP BY 1) b LEFT JOIN (SELECT _type, count(*) AS n FROM compacted GROUP BY 1) a USING (_type)"""))
def compact_summary(spark, sf):
    entries = log(spark, sf)
    return compaction.compact_summary(entries, compaction.compact(entries))




def over_compacted(sql: str) -> str:
    """The same projections with the compacted entries as their log."""
    names = ["newest", "current", "own", "edges", "taken_walk", "taken", "status"]
    return re.sub(rf"\b({'|'.join(names)})\b", r"\1_2", sql.replace("FROM log", "FROM compacted"))


_BOTH = [
    ("current_gigs", GIG, "current"), ("class_status", "venue_id, url, genre", "status"),
    ("metal_gigs", GIG, "current SEMI JOIN (SELECT venue_id, url FROM status WHERE genre = 'Metal') m USING (venue_id, url)"),
    ("already_classified", "venue_id, url", "status"),
]


def _verify_sql() -> str:
    tables = [(n, f"SELECT {c} FROM {t}") for n, c, t in _BOTH]
    tables.append(("last_scraped", "SELECT venue_id, max(recorded_at) FROM log WHERE _type = 'observed' GROUP BY venue_id"))
    rows = [
        f"SELECT '{name}' AS projection, (SELECT count(*) FROM ({sql} EXCEPT ALL {over_compacted(sql)})) AS missing,"
        f" (SELECT count(*) FROM ({over_compacted(sql)} EXCEPT ALL {sql})) AS extra"
        for name, sql in tables
    ]
    body = "SELECT *, missing = 0 AND extra = 0 AS equal FROM (" + " UNION ALL ".join(rows) + ")"
    return _rec(LOG_SQL, CURRENT_SQL, STATUS_SQL, COMPACT_SQL, over_compacted(CURRENT_SQL), over_compacted(STATUS_SQL), body)


@query("compact_verify", _verify_sql())
def compact_verify(spark, sf):
    entries = durable(log(spark, sf))
    return compaction.compact_verify(entries, compaction.compacted_log(entries))
