"""One key with a large share of the rows: same results, and its rows spread."""

import random
import re

import pytest
from pyspark.sql import functions as F

from listinglake.operators import listings, projections
from listinglake.operators.quality import gate
from listinglake.session import durable
from listinglake.skew import attach, attach_counted, salted_join, with_position
from tests.conftest import rows


@pytest.fixture(scope="module")
def lopsided(spark):
    """2,000 rows, two thirds of them under one key."""
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.66 else f"k{rng.randrange(50)}", i, rng.randrange(1, 13)) for i in range(2000)]
    return spark.createDataFrame(data, "venue_id string, listing_pos bigint, month int"), data


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salting_equals_broadcast(spark, lopsided, how):
    table, _ = lopsided
    summary = durable(table.where("venue_id <> 'k1'").groupBy("venue_id").agg(F.count(F.lit(1)).alias("n")))
    assert rows(attach(table, summary, ["venue_id"], how, broadcast_rows=0)) == rows(attach(table, summary, ["venue_id"], how))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_only_hot_keys_are_repeated(spark, lopsided, how, monkeypatch):
    table, _ = lopsided
    monkeypatch.setattr("listinglake.skew.HEAVY", 10)
    summary = durable(table.where("venue_id <> 'k1'").groupBy("venue_id").agg(F.count(F.lit(1)).alias("n")))
    joined = attach_counted(table, summary, ["venue_id"], "n", how)
    assert rows(joined, "venue_id", "listing_pos", "n") == rows(table.join(summary, "venue_id", how), "venue_id", "listing_pos", "n")
    sent = re.search(r"Generate explode\(CASE WHEN", joined._jdf.queryExecution().analyzed().toString())
    assert sent and summary.where("n * 10 >= 2000").count() == 1
    assert rows(attach(table, summary, ["venue_id"], how, broadcast_rows=0, size="n"), "venue_id", "listing_pos", "n") == rows(joined, "venue_id", "listing_pos", "n")


def test_salting_spreads_a_hot_key(spark, lopsided):
    table, _ = lopsided
    summary = table.groupBy("venue_id").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_join(table, summary, ["venue_id"]).where("venue_id = 'hot'")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) > 1 and max(sizes) < 0.7 * sum(sizes)


def years(data, turns):
    out, state = {}, {}
    for venue, pos, month in sorted(data, key=lambda r: r[1]):
        year, previous = state.get(venue, (2026, None))
        if previous is not None and turns(month, previous):
            year += 1
        state[venue] = (year, month)
        out[venue, pos] = year
    return out


@pytest.mark.parametrize("block", [1, 7, 100_000])
def test_running_year_in_blocks_of_any_size(spark, lopsided, block):
    table, data = lopsided
    found = {(r.venue_id, r.listing_pos): r.year for r in listings.running_year(table, 2026, block_rows=block).collect()}
    assert found == years(data, lambda m, p: m < p)
    found = {(r.venue_id, r.listing_pos): r.year for r in listings.running_year(table, 2026, listings.january_after_another, block).collect()}
    assert found == years(data, lambda m, p: m == 1 and p != 1)


def test_positions_of_a_hot_group(spark, lopsided):
    table, data = lopsided
    placed = with_position(table, ["venue_id"], [F.col("month"), F.col("listing_pos")])
    expected, seen = {}, {}
    for venue, pos, _ in sorted(data, key=lambda r: (r[0], r[2], r[1])):
        seen[venue] = expected[venue, pos] = seen.get(venue, 0) + 1
    assert {(r.venue_id, r.listing_pos): r.position for r in placed.collect()} == expected


def test_first_copy_wins(spark):
    table = spark.createDataFrame([("v", "a", 3, "late"), ("v", "a", 1, "first"), ("v", "b", 2, "only"), ("w", "a", 9, "other")], "venue_id string, url string, listing_pos bigint, title string")
    assert rows(listings.dedupe_first(table, ["venue_id", "url"]), "title") == [("first",), ("only",), ("other",)]


def test_pages_end_at_an_empty_page_alone(spark):
    pages = [("a", i, 1) for i in range(15)] + [("b", 0, 2), ("b", 1, 0), ("b", 2, 5)] + [("c", 0, 1), ("c", 2, 1)] + [("d", 1, 1)]
    table = spark.createDataFrame(pages, "venue_id string, page_no int, items int")
    used = listings.pages_in_use(table)
    assert rows(used, "venue_id", "page_no") == sorted([("a", i) for i in range(15)] + [("b", 0), ("c", 0), ("c", 2), ("d", 1)], key=str)
    assert rows(listings.missing_pages(used)) == [("c", 1, "Page 1 is missing"), ("d", 0, "Page 0 is missing")]


def test_rows_with_maps_can_be_salted(spark):
    table = spark.createDataFrame([("a", {"x": 1}), ("a", {"x": 2}), ("b", {})], "k string, m map<string, int>")
    names = spark.createDataFrame([("a", "A")], "k string, name string")
    found = salted_join(table, names, ["k"])
    assert sorted((r.k, sorted(r.m.items()), r.name) for r in found.collect()) == [("a", [("x", 1)], "A"), ("a", [("x", 2)], "A"), ("b", [], None)]


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_keys_of_stored_rows_tell_what_is_repeated(spark, lopsided, how, monkeypatch):
    table, _ = lopsided
    monkeypatch.setattr("listinglake.skew.HEAVY", 10)
    table = durable(table.unionByName(spark.createDataFrame([(None, 9999, 1)], table.schema)))
    summary = durable(table.where("venue_id <> 'k1'").select("venue_id", F.lit("s").alias("said")).distinct())
    joined = attach(table, summary, ["venue_id"], how, broadcast_rows=0, stored=True)
    assert rows(joined) == rows(table.join(summary, "venue_id", how)) and joined.columns == table.join(summary, "venue_id", how).columns
    assert re.search(r"Generate explode\(CASE WHEN", planned(joined)) and "SortMergeJoin" in planned(joined)


def test_long_summaries_stay_off_the_driver(spark, lopsided):
    table, _ = lopsided
    summary = durable(table.groupBy("venue_id").agg(F.count(F.lit(1)).alias("n")))
    assert "Broadcast" not in planned(attach(table, summary, ["venue_id"], broadcast_rows=0))
    # of a counted summary only the hot keys are sent to every task
    assert "SortMergeJoin" in planned(attach(table, summary, ["venue_id"], broadcast_rows=0, size="n"))


def test_many_failed_venues_stay_off_the_driver(spark):
    failed = durable(spark.range(200_001).select(F.concat(F.lit("v"), "id").alias("venue_id")))
    listing = spark.createDataFrame([("v7", "a"), ("w", "b"), (None, "c")], "venue_id string, url string")
    for found, urls in ((gate.withheld(listing, failed), ["a"]), (gate.passed(listing, failed), ["b", "c"])):
        assert "Broadcast" not in planned(found)
        assert sorted(r.url for r in found.collect()) == urls


def test_pages_stay_off_the_driver(spark):
    pages = durable(spark.createDataFrame([("a", i, 1) for i in range(9)], "venue_id string, page_no int, items int"))
    assert "SortMergeJoin" in planned(listings.pages_in_use(pages))


def test_keys_of_a_log_stay_off_the_driver(spark):
    entries = "_type string, seq bigint, venue_id string, url string, by_venue_id string, by_url string, title string, date date, poster_url string, description string, recorded_at timestamp_ntz, genre string, source string"
    log = durable(spark.createDataFrame([("observed", 1, "v", "a") + (None,) * 9, ("replaced", 2, "v", "a", "v", "b") + (None,) * 7], entries))
    current, status = projections.current_gigs(log), spark.createDataFrame([("v", "b", "Metal")], "venue_id string, url string, genre string")
    for found in (current, projections.metal_of(current, status), projections.new_or_changed(current, current)):
        assert "Broadcast" not in planned(found) and found.count() == 0
