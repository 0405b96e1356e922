"""What several operators of this package share: stored tables, labels, hot keys, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listinglake.session import working_folder

# A key is heavy if it holds at least one row in so many; there are at most so many of them.
HEAVY = 1000
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that a lost executor costs a read."""
    spark = df.sparkSession
    path = f"{working_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row(docs: DataFrame, name: str = "_row") -> DataFrame:
    """A stored copy of ``docs`` whose rows carry a number of their own, equal rows too."""
    return stored(docs.withColumn(name, F.monotonically_increasing_id()))


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``docs`` (doc_id, text, ...) joined with at most ``most`` labels that may be learned from.

    The labels are picked in the order of a hash of their ids, so the sample is the same each run
    and a fair one; its size is the bound that allows the broadcast.
    """
    sample = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return docs.join(F.broadcast(sample), "doc_id")


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left-join stored ``rows`` to stored ``groups``, which holds one row per ``key`` and its ``size``.

    A key with a thousandth of the rows is heavy. There are at most a thousand of those whatever
    the input, so their list is broadcast: a heavy key's rows are dealt over salts, and its group
    row is repeated once per salt. All other keys are joined as they are.
    """
    is_heavy = F.col(size) * HEAVY >= F.lit(total)
    heavy = groups.where(is_heavy).select(F.col(key), F.lit(True).alias("_heavy"))
    left = rows.join(F.broadcast(heavy), key, "left").withColumn(
        "_salt", F.when(F.col("_heavy"), (F.rand(7) * SALTS).cast("int")).otherwise(0)
    )
    salts = F.when(is_heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = groups.withColumn("_salt", F.explode(salts))
    return left.join(right, [key, "_salt"], "left").drop("_salt", "_heavy")


def meet(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner-join ``rows`` to stored ``groups`` like ``attach``; the salt is a hash of the row, so it survives a task that runs again."""
    is_heavy = F.col(size) * HEAVY >= F.lit(total)
    heavy = groups.where(is_heavy).select(F.col(key), F.lit(True).alias("_heavy"))
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    left = rows.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.when(F.col("_heavy"), salt).otherwise(0))
    salts = F.when(is_heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(groups.withColumn("_salt", F.explode(salts)), [key, "_salt"]).drop("_salt", "_heavy")


def settled(df: DataFrame) -> DataFrame:
    """``stored``, and Spark drops the shuffle files of that write as soon as it has ended."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(name)
    conf.set(name, "true")
    try:
        return stored(df)
    finally:
        conf.set(name, was)


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """A number from 0 for every row of a range-sorted ``ordered``, without a sort in one task.

    The sorted rows are stored with their partition and their place in it; one count per partition
    gives each its start.
    """
    at = stored(ordered.withColumn("_at", F.monotonically_increasing_id())).withColumn(
        "_part", F.shiftright("_at", 33)
    )
    # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        at.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return at.join(F.broadcast(starts), "_part").withColumn(name, place).drop("_at", "_part", "_start")


def components(pairs: DataFrame) -> DataFrame:
    """(node, label) for every node of ``pairs`` (a, b longs): label is the smallest node reachable.

    Labels spread along links and then jump to their label's label, so rounds grow with the
    logarithm of a chain's length. Every round is stored; both sides of each join are plain shuffles,
    which adaptive execution may split where a hub holds many links.
    """
    links = stored(
        pairs.where("a <> b").select("a", "b").union(pairs.where("a <> b").select("b", "a")).distinct()
    )
    labels = stored(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        jumped = (
            labels.alias("x").join(labels.alias("y"), F.col("x.label") == F.col("y.node"))
            .select(F.col("x.node").alias("node"), F.col("y.label").alias("label"))
        )
        offered = links.join(jumped, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "label")
        was = labels.select("node", "label", F.col("label").alias("was"))
        mine = jumped.unionByName(offered).withColumn("was", F.lit(None).cast("long")).unionByName(was)
        now = stored(mine.groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was")))
        settled = now.where("label <> was").isEmpty()
        labels = now.select("node", "label")
        if settled:
            return labels
