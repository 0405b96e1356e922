"""The gigs that are on, kept up as the log grows.

Per gig the state is one row of a streaming aggregation: the newest observation with its number, the
first one's number, and whether the gig was ever replaced. A replacement that arrives before the
observation it is about leaves its mark all the same, and nothing brings the gig back. A batch's entries
are folded per gig before they are shuffled or meet the state, all of it without a Python worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglake.model import GIG_FIELDS, KEY, OBSERVED, REPLACED


def current(stream: DataFrame) -> DataFrame:
    """Every gig's row with each batch that names it; once it is replaced, ``gone`` and without what it said.

    A batch that changes nothing about a gig tells the same row again.
    """
    observed, gone = F.col("_type") == OBSERVED, F.col("gone")
    seq = F.when(observed, F.col("seq"))
    folded = stream.where(F.col("_type").isin(OBSERVED, REPLACED)).groupBy(*KEY).agg(
        F.max_by(F.struct(*GIG_FIELDS), seq).alias("said"), F.max(seq).alias("seq"), F.min(seq).alias("first_seq"),
        F.bool_or(F.col("_type") == REPLACED).alias("gone"),
    )
    return folded.select(*KEY, *[F.when(~gone, F.col("said")[c]).alias(c) for c in GIG_FIELDS], "seq", "first_seq", "gone")


def still_on(state: DataFrame) -> DataFrame:
    """The current gigs, from the newest row of each."""
    return state.where(~F.col("gone")).drop("gone")
