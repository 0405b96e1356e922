"""Days as bounded lists, which hold the placed cards."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from listinglake.operators.publishing import day_pages
from tests.conftest import rows

SHAPE = "date date, title string, url string, display_date string, position long"


@pytest.mark.parametrize("size", [1, 4, 500])
def test_lists_hold_the_cards(spark, size):
    days = {1: 9, 2: 4, 3: 1}
    made = [(dt.date(2026, 9, d), None if i == 2 else f"t{i % 3}", f"u{i}", f"day {d}", i) for d, n in days.items() for i in range(1, n + 1)]
    placed = spark.createDataFrame(made, SHAPE).repartition(3)
    pages = day_pages(placed, size)
    assert rows(pages.select("date", "display_date", F.explode("cards").alias("c")).select("date", "c.title", "c.url", "display_date", "c.position")) == rows(placed)
    for d, n in days.items():
        lists = sorted((r.page, [c.position for c in r.cards]) for r in pages.where(F.dayofmonth("date") == d).collect())
        assert [x for x, _ in lists] == list(range(1, -(-n // size) + 1))
        assert [p for _, ps in lists for p in ps] == list(range(1, n + 1)) and all(len(ps) == size for _, ps in lists[:-1])
    assert day_pages(placed.limit(0)).count() == 0


def test_half_of_all_cards_on_one_day_stay_spread(spark):
    cards = spark.range(1, 20_001).select(
        F.expr("case when id <= 10000 then date'2026-09-01' else date_add(date'2026-10-01', int(id % 500)) end").alias("date"),
        F.lit("t").alias("title"), F.col("id").cast("string").alias("url"), F.lit("d").alias("display_date"),
        F.expr("case when id <= 10000 then id else div(id - 10001, 500) + 1 end").alias("position"),
    )
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = day_pages(cards, 100).groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.size("cards")).alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    assert sum(r.n for r in held) == 20_000 and max(r.n for r in held) < 10_000


def test_a_list_holds_something(spark):
    with pytest.raises(ValueError):
        day_pages(spark.createDataFrame([], SHAPE), 0)
