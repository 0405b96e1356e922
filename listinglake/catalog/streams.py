"""Queries that run the log as a stream; each must agree with its batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from listinglake.catalog.logs import CURRENT_SQL, OBS_SQL, OWN_SQL, STATUS_SQL
from listinglake.catalog.registry import query, with_ctes
from listinglake.model import GIG_FIELDS, KEY, LOG_COLUMNS, OBSERVED
from listinglake.session import working_folder
from listinglake.sources.log import as_json_text
from listinglake.sources.testviews import LOG_SQL, log
from listinglake.streaming import current, forest, rows, state
from listinglake.streaming.ingest import stream_log


def arrive(spark, sf, start, turns=2, files_per_batch=2):
    """Let the log's JSON files arrive in ``turns``, and start a stream over them after each.

    Entries are dealt to files by a hash, so they arrive out of order.
    """
    folder = f"{working_folder(spark)}/arriving-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64("seq"), F.lit(turns))
    for turn in range(turns):
        as_json_text(log(spark, sf).where(part == turn)).repartition(4).write.mode("append").text(folder)
        start(stream_log(spark, folder, files_per_batch=files_per_batch)).awaitTermination()


def ran_twice(spark, sf, build, merge=None, turns=2):
    """Run a stream with a restart, or with more; where its results are."""
    out = f"{working_folder(spark)}/state-{uuid.uuid4().hex}"
    began = []

    def start(stream):
        if merge and began:
            state.merge(spark, out, merge)
        began.append(out)
        return state.keep_up(build(stream), out, f"{out}-checkpoint")

    arrive(spark, sf, start, turns)
    return out


def kept_up(spark, sf, build, key):
    return state.current_state(spark, ran_twice(spark, sf, build, key), key)


@query("stream_ingest", with_ctes(LOG_SQL, f"SELECT {', '.join(LOG_COLUMNS)} FROM log"))
def stream_ingest(spark, sf):
    """Every entry as it arrived, batch after batch."""
    out = ran_twice(spark, sf, lambda stream: stream)
    return spark.read.parquet(out).select(*LOG_COLUMNS)


NEWEST = "venue_id string, url string, title string, date date, poster_url string, description string, seq bigint"


@query("stream_latest", with_ctes(LOG_SQL, OBS_SQL, "SELECT venue_id, url, title, date, poster_url, description, seq FROM newest"))
def stream_latest(spark, sf):
    """Each gig's newest observation, from a table that is merged as it is read; the log isn't read again."""
    folder = f"{working_folder(spark)}/newest-{uuid.uuid4().hex}"
    newest = rows.Rows(folder, NEWEST, tuple(KEY), "seq", buckets=8)
    arrive(spark, sf, lambda stream: rows.keep_rows(stream.where(F.col("_type") == OBSERVED).select(*newest.columns), newest, f"{folder}-checkpoint"))
    return newest.read(spark)


@query("stream_class_status", with_ctes(LOG_SQL, STATUS_SQL, "SELECT venue_id, url, genre FROM status", recursive=True))
def stream_class_status(spark, sf):
    """Own and inherited genres, from trees of replacements that batches read and write back in part."""
    grown = forest.Forest.at(f"{working_folder(spark)}/forest-{uuid.uuid4().hex}", buckets=8)
    arrive(spark, sf, lambda stream: forest.keep_forest(stream, grown, f"{grown.index.path}-checkpoint"), turns=2, files_per_batch=4)
    return forest.class_status(spark, grown)


@query("stream_current", with_ctes(LOG_SQL, CURRENT_SQL, "SELECT venue_id, url, title, date, poster_url, description, seq FROM current"))
def stream_current(spark, sf):
    """Gigs that are on, over two restarts; replacements come before and after what they are about."""
    out = ran_twice(spark, sf, current.current, KEY, turns=3)
    return current.still_on(state.current_state(spark, out, KEY)).select(*KEY, *GIG_FIELDS, "seq")


@query("stream_status", with_ctes(LOG_SQL, OWN_SQL, "SELECT * FROM own"))
def stream_status(spark, sf):
    return kept_up(spark, sf, state.verdicts, KEY)


@query("stream_last_scraped", with_ctes(LOG_SQL, "SELECT venue_id, max(recorded_at) AS last_scraped FROM log WHERE _type = 'observed' GROUP BY venue_id"))
def stream_last_scraped(spark, sf):
    return kept_up(spark, sf, state.last_scraped, ["venue_id"])
