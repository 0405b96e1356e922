"""The published page, one folder per day and content.

A day's cards are written once under a print of what they say. An index names each day's print and when
it last changed, and a version file names the index that counts; readers go by the newest version, so
they see the page before a publication or the one after it. Publishing writes the days that changed and
a new index: folders of other days keep their files byte for byte, a day that has gone is in the index
no longer, and where nothing changed nothing is written at all.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listinglake.operators.publishing import day_prints
from listinglake.session import durable
from listinglake.skew import attach
from listinglake.sources import files

CARDS = "date date, display_date string, position bigint, title string, venue string, url string, image_url string"
COLUMNS = [field.split()[0] for field in CARDS.split(", ")]
INDEX = "date date, print string, n_gigs bigint, lastmod timestamp"


class Conflict(Exception):
    """Another publication came first."""


def _newest(spark: SparkSession, path: str) -> dict:
    versions = files.names(spark, f"{path}/versions")
    if not versions:
        return {"version": -1, "index": None, "lastmod": None}
    return {"version": int(versions[-1]), **json.loads(files.read_text(spark, f"{path}/versions/{versions[-1]}"))}


def _index(spark: SparkSession, path: str, newest: dict) -> DataFrame:
    if newest["index"] is None:
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).parquet(f"{path}/index/{newest['index']}")


def days(spark: SparkSession, path: str) -> DataFrame:
    """(date, print, n_gigs, lastmod) of the days on the page."""
    return _index(spark, path, _newest(spark, path))


def lastmod(spark: SparkSession, path: str) -> str | None:
    """When the page last changed, a day's leaving included; none before the first publication."""
    return _newest(spark, path)["lastmod"]


def read_page(spark: SparkSession, path: str) -> DataFrame:
    """The cards on the page with their day's ``lastmod``; only folders that the index names are read."""
    newest = _newest(spark, path)
    if newest["index"] is None:
        return spark.createDataFrame([], f"{CARDS}, lastmod timestamp")
    stored = spark.read.schema(f"{CARDS}, print string").parquet(f"{path}/cards")
    named = _index(spark, path, newest).select("date", "print", "lastmod")
    return attach(stored, named, ["date", "print"], "inner").select(*COLUMNS, "lastmod")


def _prints(page: DataFrame) -> DataFrame:
    """One print per day over all a card shows, its place included."""
    told = day_prints(page, COLUMNS)
    return told.select("date", F.concat_ws("-", F.col("n").cast("string"), F.hex("x"), F.col("s").cast("string")).alias("print"), F.col("n").alias("n_gigs"))


def publish(page: DataFrame, path: str, at: Column) -> DataFrame:
    """Publish ``page`` (a stored table of placed cards) as of the instant ``at``; (date, change) per day that changed.

    Null fields are told from empty ones. A publication that fails half-way leaves the page as it was;
    tried again, it replaces what the first try wrote.
    """
    spark, path = page.sparkSession, path.rstrip("/")
    newest = _newest(spark, path)
    was = _index(spark, path, newest)
    both = _prints(page).join(was.select("date", F.col("print").alias("was"), F.col("lastmod").alias("since")), "date", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("print").isNull(), "removed").when(F.col("print") != F.col("was"), "changed")
    told = durable(both.select("date", "print", "n_gigs", "since", change.alias("change")))
    changes = told.where("change IS NOT NULL").select("date", "change")
    if changes.isEmpty() and newest["index"] is not None:
        return changes
    new = told.where("change IN ('added', 'changed')").select("date", "print")
    dated = attach(page.select(*COLUMNS), durable(new), ["date"], "inner").hint("rebalance", "date", "print")
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "print").parquet(f"{path}/cards")
    index, stamp = uuid.uuid4().hex, at.cast("timestamp")
    kept = told.where("print IS NOT NULL").select("date", "print", "n_gigs", F.when(F.col("change").isNull(), F.col("since")).otherwise(stamp).alias("lastmod"))
    kept.write.parquet(f"{path}/index/{index}")
    when = spark.range(1).select(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0]
    if not files.publish(spark, f"{path}/versions/{newest['version'] + 1:012d}", json.dumps({"index": index, "lastmod": when})):
        raise Conflict(f"version {newest['version'] + 1} of {path} is published already")
    return changes


def unread(spark: SparkSession, path: str) -> DataFrame:
    """(date, print) of stored days that the page doesn't show; they may expire once nobody reads an earlier version."""
    found = [(d.partition("=")[2], p.partition("=")[2]) for d in files.names(spark, f"{path}/cards") for p in files.names(spark, f"{path}/cards/{d}")]
    stored = spark.createDataFrame(found, "date string, print string").select(F.col("date").cast("date").alias("date"), "print")
    return stored.join(days(spark, path).select("date", "print"), ["date", "print"], "left_anti")
