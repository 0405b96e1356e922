"""The last row known at a moment, against a loop over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from listinglake.operators import classification
from listinglake.operators.as_of import last_known
from tests.conftest import rows

ROWS, KNOWN = "id int, k string, j int, t int", "key string, j2 int, s int, v int, w string"


def slow(asked, known, before):
    out = []
    for i, k, j, t in asked:
        fit = [(s, (v is not None, v, w is not None, w)) for key, j2, s, v, w in known
               if None not in (k, j, t, key, j2, s) and (key, j2) == (k, j) and (s < t if before else s <= t)]
        if fit:
            newest = max(s for s, _ in fit)
            _, v, _, w = max((x for s, x in fit if s == newest), key=lambda x: (x[0], x[1] or 0, x[2], x[3] or ""))
            out.append((i, k, j, t, v, w))
        else:
            out.append((i, k, j, t, None, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("before", [False, True])
def test_equals_a_loop(spark, before):
    draw = random.Random(5)
    some = lambda *values: draw.choice([*values, None])
    # one key holds most rows
    asked = [(i, "hot" if i % 3 else some("a", "b"), 1 if i % 5 else some(1, 2), draw.randrange(60) if i % 17 else None) for i in range(600)]
    asked += asked[:20]
    known = [("hot" if i % 2 else some("a", "c"), some(1, 2), draw.randrange(60) if i % 11 else None, some(1, 2, 3), some("x", "y")) for i in range(90)]
    left = spark.createDataFrame(asked, ROWS).repartition(3)
    right = spark.createDataFrame(known, KNOWN).repartition(2)
    got = last_known(left, right, [("k", "key"), ("j", "j2")], "t", "s", ["v", "w"], before)
    assert rows(got) == slow(asked, known, before)
    assert rows(last_known(left, right.limit(0), [("k", "key"), ("j", "j2")], "t", "s", ["v", "w"], before)) == slow(asked, [], before)
    assert last_known(left.limit(0), right, [("k", "key"), ("j", "j2")], "t", "s", ["v", "w"], before).count() == 0


def test_one_key_is_spread_and_carried(spark):
    """All rows have one key; what is known long before reaches every task."""
    asked = spark.range(100_000, numPartitions=8).select(F.lit("m").alias("k"), F.col("id").alias("t"), F.lit("y" * 50).alias("pad"))
    known = spark.createDataFrame([("m", 10, 1), ("m", 60_000, 2)], "key string, s long, v int")
    adaptive = "spark.sql.adaptive.enabled"
    was = spark.conf.get(adaptive)
    spark.conf.set(adaptive, "false")
    try:
        got = last_known(asked, known, [("k", "key")], "t", "s", ["v"])
        assert {r.v: r["count"] for r in got.groupBy("v").count().collect()} == {None: 10, 1: 59_990, 2: 40_000}
        tasks = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert len(tasks) > 1 and max(tasks) <= 80_000
    finally:
        spark.conf.set(adaptive, was)


def test_clashing_names_are_refused(spark):
    left = spark.createDataFrame([(1, "a", 1, 1)], ROWS)
    with pytest.raises(ValueError, match="v"):
        last_known(left.withColumn("V", F.lit(1)), spark.createDataFrame([], KNOWN), [("k", "key")], "t", "s", ["v"])


def test_costs_by_a_table_equal_costs_by_the_fixed_rates(spark, sf):
    from listinglake.classify_rates import rates
    from listinglake.sources import testviews as t

    verdicts = t.verdicts(spark, sf)
    assert rows(classification.with_cost_as_of(verdicts, rates(spark)), "seq", "cost") == rows(classification.with_cost(verdicts), "seq", "cost")
