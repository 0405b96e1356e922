"""The event log on disk: newline-delimited JSON lines, or Parquet partitioned by entry kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listinglake.functions.text import not_blank, title_problem
from listinglake.model import CLASSIFIED, LOG_COLUMNS, LOG_JSON_SCHEMA, LOG_SCHEMA, OBSERVED, RENDERED, REPLACED
from listinglake.operators.sequencing import assign_sequence
from listinglake.session import durable


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOG_SCHEMA)


def from_json_rows(raw: DataFrame) -> DataFrame:
    """Rows read with ``LOG_JSON_SCHEMA`` as log entries."""
    observed = F.col("_type") == OBSERVED
    gig = lambda name: F.col(f"gig.{name}")
    return raw.select(
        "_type",
        "seq",
        F.to_timestamp_ntz(F.regexp_replace("recordedAt", "Z$", "")).alias("recorded_at"),
        F.when(observed, gig("venue")).otherwise(F.col("venue")).alias("venue_id"),
        F.when(observed, gig("url")).otherwise(F.col("url")).alias("url"),
        gig("title").alias("title"),
        gig("date").cast("date").alias("date"),
        gig("posterUrl").alias("poster_url"),
        gig("description").alias("description"),
        "genre",
        "source",
        F.col("llmModel").alias("llm_model"),
        F.col("useVision").alias("use_vision"),
        F.col("inputTokens").alias("input_tokens"),
        F.col("outputTokens").alias("output_tokens"),
        F.col("byVenue").alias("by_venue_id"),
        F.col("byUrl").alias("by_url"),
        "file",
        F.col("gigCount").alias("gig_count"),
        F.col("logicalDate").cast("date").alias("logical_date"),
    )


def as_json_text(entries: DataFrame) -> DataFrame:
    """Log entries as one ``value`` column of JSON lines; a null field is left out of its object."""
    observed, classified, replaced = (F.col("_type") == kind for kind in (OBSERVED, CLASSIFIED, REPLACED))
    keyed = classified | replaced
    gig = F.struct(
        "title", F.col("venue_id").alias("venue"), F.col("date").cast("string").alias("date"), "url",
        F.col("poster_url").alias("posterUrl"), "description",
    )
    return entries.select(
        F.to_json(
            F.struct(
                "_type", "seq", F.when(observed, gig).alias("gig"),
                F.when(keyed, F.col("venue_id")).alias("venue"), F.when(keyed, F.col("url")).alias("url"),
                F.col("by_venue_id").alias("byVenue"), F.col("by_url").alias("byUrl"),
                _instant(F.col("recorded_at")).alias("recordedAt"), "genre", "source",
                F.col("llm_model").alias("llmModel"), F.col("use_vision").alias("useVision"),
                F.col("input_tokens").alias("inputTokens"), F.col("output_tokens").alias("outputTokens"),
                "file", F.col("gig_count").alias("gigCount"),
                F.col("logical_date").cast("string").alias("logicalDate"),
            )
        ).alias("value")
    )


def _instant(at: Column) -> Column:
    return F.concat(F.regexp_replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", ""), F.lit("Z"))


def read_json_log(spark: SparkSession, path: str) -> DataFrame:
    """Read JSON lines; a malformed line fails the job, a path that is not there is an empty log."""
    try:
        raw = spark.read.schema(LOG_JSON_SCHEMA).option("mode", "FAILFAST").json(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return empty_log(spark)
        raise
    return from_json_rows(raw)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Read the Parquet log; a filter on ``_type`` prunes to that kind's folder."""
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(path).select(*LOG_COLUMNS)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return empty_log(spark)
        raise


def entries_of(log: DataFrame, kind: str) -> DataFrame:
    """The entries of one kind."""
    return log.where(F.col("_type") == kind)


def as_entries(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows with every column of the log, those they lack null, and the columns in ``keep``."""
    fields = StructType.fromDDL(LOG_SCHEMA).fields
    column = lambda f: F.col(f.name) if f.name in rows.columns else F.lit(None)
    return rows.select(*[column(f).cast(f.dataType).alias(f.name) for f in fields], *keep)


def write_log(entries: DataFrame, path: str, mode: str = "append") -> None:
    entries.select(*LOG_COLUMNS).write.mode(mode).partitionBy("_type").parquet(path)


def replaces_itself() -> Column:
    return F.col("venue_id").eqNullSafe(F.col("by_venue_id")) & F.col("url").eqNullSafe(F.col("by_url"))


def entry_problem() -> Column:
    """Why an entry may not be written, null where it may: blank keys or poster, its title, a key replacing itself."""
    kind = F.col("_type")
    blank = lambda name: ~F.coalesce(not_blank(F.col(name)), F.lit(False))
    return (
        F.when((kind != RENDERED) & blank("venue_id"), F.lit("blank venue"))
        .when((kind != RENDERED) & blank("url"), F.lit("blank url"))
        .when((kind == OBSERVED) & F.col("poster_url").isNotNull() & blank("poster_url"), F.lit("blank poster"))
        .when((kind == OBSERVED) & title_problem(F.col("title")).isNotNull(), F.concat(F.lit("title: "), title_problem(F.col("title"))))
        .when((kind == REPLACED) & replaces_itself(), F.lit("replaced by itself"))
    )


def numbered_from(batch: DataFrame, last: int, position: str = "position") -> tuple[DataFrame, int | None]:
    """``batch`` numbered after entry ``last`` in ``position`` order, stored, and its largest number; or refused as a whole.

    It is refused when a number it brings along does not follow the one before it, or when an entry
    has an ``entry_problem``. An empty batch has no largest number.
    """
    numbered = durable(assign_sequence(as_entries(batch, [position]), position, last))
    first = lambda where, *columns: F.min(F.when(where, F.struct("seq", *columns)))
    told = numbered.withColumn("_problem", entry_problem()).agg(
        F.max("seq").alias("last"), first(~F.col("in_order")).alias("unordered"), first(F.col("_problem").isNotNull(), "_problem").alias("refused")
    ).first()
    if told.unordered:
        raise ValueError(f"entry seq {told.unordered.seq} does not follow the entry before it")
    if told.refused:
        raise ValueError(f"entry seq {told.refused.seq} is refused: {told.refused._problem}")
    return numbered, told.last


def numbered_after(log: DataFrame, batch: DataFrame, position: str = "position") -> DataFrame:
    """``batch`` numbered after ``log``, or refused as a whole, for a log without commits.

    One writer at a time: two that read the same log take the same numbers. ``sources.commits`` has a
    log for several writers, which isn't read to find its last number either.
    """
    last = log.agg(F.max("seq")).first()[0]
    return numbered_from(batch, -1 if last is None else last, position)[0]


def append(log: DataFrame, batch: DataFrame, path: str, position: str = "position") -> None:
    """Number ``batch`` after ``log`` and append it to the Parquet log."""
    write_log(numbered_after(log, batch, position), path)


def append_json(log: DataFrame, batch: DataFrame, path: str, position: str = "position") -> None:
    """Number ``batch`` after ``log`` and append it as JSON lines."""
    as_json_text(numbered_after(log, batch, position)).write.mode("append").text(path)
