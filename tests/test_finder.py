"""The search index gives what a scan gives, and reads less for rare words."""

import pytest
from pyspark.sql import functions as F

from listinglake.operators import finder
from listinglake.operators.publishing import search
from tests.conftest import rows

SHAPE = "title string, venue string, url string"
WORDS = ["Cave", "ice", "Ünder", "World", "𝔐etal", "a", "tHe", "of", "İstanbul", "x", "%_", "iron\nmaid"]


def cards(spark, n=400):
    made = [(" ".join(WORDS[(i * k + k) % len(WORDS)] for k in range(1, 2 + i % 4)), f"Room {i % 7}", f"u{i}") for i in range(n)]
    odd = [(None, "only venue", "n1"), ("only title", None, "n2"), (None, None, "n3"), ("", "", "n4"), ("same", "same", "s"), ("same", "same", "s")]
    return spark.createDataFrame(made + odd + [("the " * 20_000 + "end of a long one", "v", "long"), ("zyzzyva", "v", "rare")], SHAPE)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    finder.build(cards(spark), ["title", "venue"], path, shelves=8, buckets=8)
    return finder.open_index(spark, path)


def test_equals_a_scan(spark, indexed):
    page = cards(spark)
    whole = "the end of a long one"
    asked = [whole[:n] for n in range(0, 21, 4)] + ["  CAVE ", "𝔐", "𝔐e", "İ", "ü", "%_", "\n", "n\nm", "room 3", "same\nsame", "zyz", "absent", "qqq", "e", " of "]
    for query in asked:
        assert rows(finder.find(spark, indexed, query)) == rows(search(page, query)), query


def test_rare_words_open_few_shelves(spark, indexed):
    opened = lambda q: {f.split("at_shelf=")[1].split("/")[0] for f in finder.find(spark, indexed, q).inputFiles() if "at_shelf=" in f}
    assert len(opened("zyzzyva")) == 1 and len(opened("room")) > 4 and not opened("qqq")
    postings = lambda q: [r.n for r in finder.rarest(spark, indexed, F.lit(q))]
    assert postings("zyzzyva") == [1, 1, 1] and postings("room")[0] == 400


def test_empty_table_and_refusals(spark, tmp_path):
    path = str(tmp_path / "i")
    index = finder.build(cards(spark).limit(0), ["title"], path, shelves=2, buckets=2)
    assert [finder.find(spark, index, q).count() for q in ("", "a", "absent")] == [0, 0, 0]
    with pytest.raises(ValueError, match="_row"):
        finder.build(cards(spark).withColumn("_row", F.lit(1)), ["title"], str(tmp_path / "j"))


def test_a_common_run_is_spread(spark, tmp_path):
    many = spark.range(20_000).select(F.lit("common").alias("title"), F.col("id").cast("string").alias("url"))
    index = finder.build(many, ["title"], str(tmp_path / "i"), shelves=4, buckets=4)
    assert finder.find(spark, index, "common").count() == 20_000
    sizes = [r["count"] for r in spark.read.parquet(f"{index.path}/rows").groupBy("at_shelf").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 8_000
    held = spark.read.parquet(f"{index.path}/postings").where("run = 'com'").groupBy(F.input_file_name()).count().collect()
    assert len(held) == finder.SPREAD
