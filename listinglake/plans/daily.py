"""The daily chain: scrape, classify, render, unless the day is already rendered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglake.operators.projections import already_rendered

Step = Callable[[], object]


def is_done(log: DataFrame, day: str) -> bool:
    days = log.sparkSession.range(1).select(F.lit(day).cast("date").alias("logical_date"))
    return not already_rendered(log, days).isEmpty()


def daily(log: DataFrame, day: str, steps: list[Step], force: bool = False) -> bool:
    """Run the steps in order unless the page was rendered for ``day``; says whether they ran.

    Each step reads the log afresh, since the one before it appended to it.
    """
    if not force and is_done(log, day):
        return False
    for step in steps:
        step()
    return True
