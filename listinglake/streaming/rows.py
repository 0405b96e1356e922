"""A table of each key's newest row, written batch by batch and merged as it is read.

A batch writes its rows as one run, cut into folders by a hash of the key. What is newest is decided by
a column of the rows, so reading a row twice does no harm, and runs may overlap. Runs are merged in
levels: ``fanout`` neighbours of one size become one, so a row is written again about log(batches) times
and a reader opens about fanout x log(batches) runs. A run's name says which batches it covers; a run
without its success mark doesn't count, and readers take the widest runs.

A lookup reads the folders that its keys fall into, in those runs, and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from listinglake.sources import files


@dataclass(frozen=True)
class Rows:
    path: str
    schema: str
    key: tuple[str, ...]
    order: str
    by: tuple[str, ...] = ()  # what folders are cut by; the key unless said
    buckets: int = 64
    fanout: int = 8

    @property
    def columns(self) -> list[str]:
        return [field.split()[0] for field in self.schema.split(", ")]

    def bucket(self, columns: Sequence[str] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(columns or self.by or self.key)), F.lit(self.buckets)).cast("int")

    def _run(self, first: int, last: int) -> str:
        return f"{self.path.rstrip('/')}/run={first:012d}-{last:012d}"

    def newest(self, rows: DataFrame) -> DataFrame:
        """One row per key, the last in order. Combined before the shuffle."""
        rest = [c for c in self.columns if c not in self.key]
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), self.order).alias("_r")).select(*self.key, "_r.*").select(*self.columns)

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        # a folder's rows come from one task, unless adaptive execution finds them too many
        cut = self.newest(rows).withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        cut.write.mode("overwrite").partitionBy("bucket").parquet(self._run(first, last))

    def write(self, rows: DataFrame, batch: int) -> None:
        """One batch's rows, in place of what an earlier try of it left; then merge what is due."""
        self._write(rows, batch, batch)
        self._merge(rows.sparkSession, batch)

    def _runs(self, spark: SparkSession) -> list[tuple[int, int]]:
        """Finished runs, those of an earlier start first, the wider of them first."""
        found = [n.partition("=")[2] for n in files.names(spark, self.path) if n.startswith("run=")]
        pairs = [(int(a), int(b)) for a, b in (n.split("-") for n in found)]
        return sorted((p for p in pairs if files.exists(spark, f"{self._run(*p)}/_SUCCESS")), key=lambda p: (p[0], -p[1]))

    def covering(self, spark: SparkSession, before: int | None = None) -> list[tuple[int, int]]:
        """The widest runs over all batches, or over those before one."""
        out: list[tuple[int, int]] = []
        for first, last in self._runs(spark):
            if (before is None or last < before) and (not out or first > out[-1][1]):
                out.append((first, last))
        return out

    def _merge(self, spark: SparkSession, batch: int) -> None:
        size = self.fanout
        while (batch + 1) % size == 0:
            first = batch + 1 - size
            parts = [r for r in self.covering(spark) if first <= r[0] and r[1] <= batch]
            if len(parts) > 1:
                self._write(self._read(spark, parts), first, batch)
            size *= self.fanout

    def _read(self, spark: SparkSession, runs: list[tuple[int, int]], buckets: Sequence[int] | None = None) -> DataFrame:
        if not runs:
            return spark.createDataFrame([], self.schema)
        read = spark.read.schema(f"{self.schema}, run string, bucket int").option("basePath", self.path).parquet(*[self._run(*r) for r in runs])
        return (read if buckets is None else read.where(F.col("bucket").isin(list(buckets)))).select(*self.columns)

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """Each key's newest row, as of now or as of before a batch."""
        return self.newest(self._read(spark, self.covering(spark, before)))

    def lookup(self, wanted: DataFrame, before: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """The newest rows whose ``columns`` (what folders are cut by) are among ``wanted``; reads their folders only."""
        spark, on = wanted.sparkSession, list(columns or self.by or self.key)
        # at most as many numbers as there are folders
        buckets = sorted(r[0] for r in wanted.select(self.bucket(on)).distinct().collect())
        runs = self.covering(spark, before) if buckets else []
        return self.newest(self._read(spark, runs, buckets).join(wanted.select(*on).distinct(), on, "left_semi"))


def keep_rows(stream: DataFrame, rows: Rows, checkpoint: str) -> StreamingQuery:
    """Write what has arrived to the table, batch by batch; a batch that is run again replaces itself."""
    return (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda arrived, batch: rows.write(arrived, batch)).start()
    )
