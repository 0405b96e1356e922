"""The log as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listinglake.model import LOG_JSON_SCHEMA
from listinglake.sources.log import from_json_rows


def stream_log(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Log entries as files of JSON lines arrive, by the explicit schema; a malformed line fails."""
    reader = spark.readStream.schema(LOG_JSON_SCHEMA).option("mode", "FAILFAST")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return from_json_rows(reader.json(folder))
