"""Rewriting a log's files without what no projection reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listinglake.operators import compaction
from listinglake.sources.log import read_log, write_log


def compact_log(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Write the compacted log to ``target`` and prove that it reads the same as ``path``.

    The log at ``path`` stays; readers move to ``target`` once this returns. A difference raises
    before anyone could. Returns entries per kind before and after.
    """
    log = read_log(spark, path)
    entries = compaction.compact(log)
    write_log(entries.repartitionByRange("_type", "seq").sortWithinPartitions("_type", "seq"), target, mode="error")
    stored = read_log(spark, target)
    differing = [r.projection for r in compaction.compact_verify(log, stored).collect() if not r.equal]
    if differing:
        raise ValueError(f"the compacted log reads differently: {', '.join(differing)}")
    return compaction.compact_summary(log, stored)
