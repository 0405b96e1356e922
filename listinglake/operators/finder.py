"""Substring search by an index: postings of one to three characters, the rarest read first.

Whatever holds a query holds each of its runs of three characters (of fewer, if it is that short).
``build`` writes every row's runs as postings, one row each, cut into folders by a hash of the run and
sorted, with a count per run. A search reads the counts of its own runs, meets the postings of the rarest few,
and opens only the shelves that the rows left over lie on; there the predicate of ``publishing.search``
decides, so results are those of a scan. A run that many rows hold is many postings in several
files, never a list.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listinglake.functions.text import stripped
from listinglake.sources import files

LONGEST = 3
# Postings lists a search meets; more of them would leave fewer rows to check, never other results.
MET = 3
# Tasks that write one folder of postings.
SPREAD = 4
_OWN = ("_row", "at_shelf")


@dataclass(frozen=True)
class Index:
    path: str
    schema: StructType
    text: tuple[str, ...]
    shelves: int
    buckets: int

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("run"), F.lit(self.buckets)).cast("int")


def searched(columns: Sequence[str]) -> Column:
    """What a query is looked for in: the columns' text, case aside."""
    return F.lower(F.concat_ws("\n", *columns))


def runs(text: Column, sizes: Sequence[int] = range(1, LONGEST + 1)) -> Column:
    """The distinct runs of these many characters, in time proportional to the text."""
    # an empty separator cuts between code points; the empty piece of an empty text is no character
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def of(size: int) -> Column:
        if size == 1:
            return chars
        shifted = of(size - 1)
        # a run is a character and the shorter run that starts at the next one
        tails = F.slice(shifted, F.lit(2), F.greatest(F.size(shifted) - 1, F.lit(0)))
        return F.filter(F.zip_with(chars, tails, lambda first, rest: F.concat(first, rest)), lambda r: r.isNotNull())

    return F.array_distinct(F.concat(*[of(size) for size in sizes]))


def build(rows: DataFrame, text: Sequence[str], path: str, shelves: int = 64, buckets: int = 64) -> Index:
    """Write ``rows`` and the postings of their ``text`` columns under ``path``, which must not be in use.

    Null columns are left out of a row's text, as ``concat_ws`` does; equal rows stay as often as they
    are there. The index can be opened only once all of it is written.
    """
    clash = {c.lower() for c in rows.columns} & set(_OWN)
    if clash:
        raise ValueError(f"rows already have columns {sorted(clash)}")
    spark = rows.sparkSession
    index = Index(path.rstrip("/"), rows.schema, tuple(text), shelves, buckets)
    said = searched(text)
    plain = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    # like texts share a shelf; the hash lets a text that very many rows share go on several
    shelved = rows.repartitionByRange(shelves, said, F.xxhash64(*plain))
    numbered = shelved.withColumn("_row", F.monotonically_increasing_id()).withColumn("at_shelf", F.shiftright("_row", 33).cast("int"))
    numbered.write.partitionBy("at_shelf").parquet(f"{index.path}/rows")
    kept = _rows_of(spark, index, None).withColumn("_run", F.explode(runs(said)))
    postings = kept.select(F.col("_run").alias("run"), F.col("_row").alias("row"), F.col("at_shelf").alias("shelf")).withColumn("bucket", index.bucket())
    spread = postings.repartition(buckets * SPREAD, "bucket", F.pmod(F.xxhash64("row"), F.lit(SPREAD)))
    spread.sortWithinPartitions("bucket", "run", "row").write.partitionBy("bucket").parquet(f"{index.path}/postings")
    counts = _postings(spark, index, None).groupBy("run").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", index.bucket())
    counts.repartition(buckets, "bucket").sortWithinPartitions("bucket", "run").write.partitionBy("bucket").parquet(f"{index.path}/counts")
    about = {"schema": json.loads(rows.schema.json()), "text": list(text), "shelves": shelves, "buckets": buckets}
    if not files.publish(spark, f"{index.path}/index.json", json.dumps(about)):
        raise ValueError(f"another index was written to {index.path}")
    return index


def open_index(spark: SparkSession, path: str) -> Index:
    about = json.loads(files.read_text(spark, f"{path.rstrip('/')}/index.json"))
    return Index(path.rstrip("/"), StructType.fromJson(about["schema"]), tuple(about["text"]), about["shelves"], about["buckets"])


def _folder(spark: SparkSession, folder: str, cut: str, wanted: Sequence[int] | None, schema: str) -> DataFrame:
    """The table in ``folder``, or just the parts of it named; parts nobody wrote hold no rows."""
    reader = spark.read.schema(schema).option("basePath", folder)
    if wanted is None:
        return reader.parquet(folder)
    there = set(files.names(spark, folder))
    paths = [f"{folder}/{cut}={w}" for w in sorted(set(wanted)) if f"{cut}={w}" in there]
    return reader.parquet(*paths) if paths else spark.createDataFrame([], schema)


def _rows_of(spark: SparkSession, index: Index, shelves: Sequence[int] | None) -> DataFrame:
    schema = StructType([*index.schema.fields]).add("_row", "long").add("at_shelf", "integer")
    return _folder(spark, f"{index.path}/rows", "at_shelf", shelves, schema)


def _postings(spark: SparkSession, index: Index, buckets: Sequence[int] | None) -> DataFrame:
    return _folder(spark, f"{index.path}/postings", "bucket", buckets, "run string, row long, shelf int, bucket int")


def rarest(spark: SparkSession, index: Index, wanted: Column) -> list | None:
    """The query's runs with their counts, rarest first, at most ``MET``; none if some run is nowhere."""
    longest = F.least(F.char_length(wanted), F.lit(LONGEST))
    by_size = [F.when(longest == size, runs(wanted, [size])) for size in range(1, LONGEST + 1)]
    asked = spark.range(1).select(F.explode(F.coalesce(*by_size)).alias("run")).withColumn("bucket", index.bucket())
    asked_buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]
    counts = _folder(spark, f"{index.path}/counts", "bucket", asked_buckets, "run string, n long, bucket int")
    met = asked.join(counts, ["run", "bucket"], "left")
    if not met.where(F.col("n").isNull()).isEmpty():
        return None
    return met.orderBy("n", "run").limit(MET).collect()


def find(spark: SparkSession, index: Index, query: str) -> DataFrame:
    """The indexed rows that ``publishing.search`` gives for ``query``; a blank one gives all."""
    wanted = F.lower(stripped(F.lit(query)))
    columns = index.schema.fieldNames()
    if spark.range(1).select(wanted == "").first()[0]:
        return _rows_of(spark, index, None).select(*columns)
    met = rarest(spark, index, wanted)
    if not met:
        return _rows_of(spark, index, []).select(*columns)

    def of(posting) -> DataFrame:
        return _postings(spark, index, [posting.bucket]).where(F.col("run") == posting.run).select("row", "shelf")

    left = of(met[0])
    for posting in met[1:]:
        left = left.join(of(posting).select("row"), "row", "left_semi")
    # at most one number per shelf
    shelves = [r.shelf for r in left.select("shelf").distinct().collect()]
    on_them = _rows_of(spark, index, shelves)
    candidates = on_them.join(left.select(F.col("row").alias("_row")), "_row", "left_semi")
    return candidates.where(F.contains(searched(index.text), wanted)).select(*columns)
