"""State of the log kept up as it grows.

``seq`` decides what is newest, so entries that arrive late or out of order do no harm and no
watermark is needed: every key keeps one row of state for as long as the log does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from listinglake.model import CLASSIFIED, KEY, METAL, OBSERVED, OTHER, USER
from listinglake.sources.files import numbers

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest(stream: DataFrame) -> DataFrame:
    """The number of each gig's newest observation so far; ``rows_of`` fetches what it says.

    Numbers alone are kept as state, so texts neither fill it nor are written again with each change.
    """
    observed = stream.where(F.col("_type") == OBSERVED)
    return observed.groupBy(*KEY).agg(F.max("seq").alias("seq"))


def rows_of(log: DataFrame, newest: DataFrame) -> DataFrame:
    """The observations that ``newest`` numbers."""
    return log.where(F.col("_type") == OBSERVED).join(newest.select("seq"), "seq", "left_semi")


def verdicts(stream: DataFrame) -> DataFrame:
    """The effective verdict per key so far; genre and ``seq`` share one long of state."""
    coded = F.col("seq") * 2 + (F.col("genre") == METAL).cast("bigint")
    by_user = F.col("source") == USER
    return (
        stream.where(F.col("_type") == CLASSIFIED).groupBy(*KEY)
        .agg(F.max(F.when(by_user, coded)).alias("u"), F.max(F.when(~by_user, coded)).alias("m"))
        .select(*KEY, F.when(F.coalesce("u", "m") % 2 == 1, METAL).otherwise(OTHER).alias("genre"))
    )


def last_scraped(stream: DataFrame) -> DataFrame:
    observed = stream.where(F.col("_type") == OBSERVED)
    return observed.groupBy("venue_id").agg(F.max("recorded_at").alias("last_scraped"))


def keep_up(state: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and write each batch's changed rows to a folder of its own.

    A batch that is run again after a failure replaces its own folder, so none counts twice. State
    is held by RocksDB, off the heap.
    """
    state.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def store(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        state.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(store).start()
    )


def current_state(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The table the batches add up to: each key's row from the newest batch that changed it.

    Reads the newest merged table and the batches after it.
    """
    merged = numbers(spark, _merged(path), "upto")
    batches = spark.read.parquet(path)
    if not merged:
        return _newest(batches, key)
    before = spark.read.parquet(f"{_merged(path)}/upto={merged[-1]}")
    return _newest(before.unionByName(batches.where(F.col("batch") > merged[-1])), key)


def merge(spark: SparkSession, path: str, key: list[str]) -> None:
    """Fold all batches so far into one table next to them, which later reads start from.

    Batch folders up to it are needed no more and may expire.
    """
    batches = numbers(spark, path, "batch")
    merged = numbers(spark, _merged(path), "upto")
    if batches and batches[-1:] != merged[-1:]:
        rows = current_state(spark, path, key).withColumn("batch", F.lit(batches[-1]))
        rows.write.mode("overwrite").parquet(f"{_merged(path)}/upto={batches[-1]}")


def _merged(path: str) -> str:
    return f"{path.rstrip('/')}-merged"


def _newest(stored: DataFrame, key: list[str]) -> DataFrame:
    rest = [c for c in stored.columns if c not in (*key, "batch")]
    return stored.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")
