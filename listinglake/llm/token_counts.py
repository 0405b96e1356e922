"""Token counts from the exact histogram of encoded lengths.

Documents are reduced to how many have each length; sums over all longer lengths then answer, for
every context limit, how many documents fit, how many tokens there are and how many a cut to that
limit would keep.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listinglake.llm.common import stored
from listinglake.llm.tokens import Encoder

# Neighbouring lengths that one window task sums.
BLOCK = 4096


def lengths(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """(by..., length, docs): how many documents have each encoded length, null texts as empty ones."""
    picked = docs.select(*by, F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, pattern)
        for batch in batches:
            counts = pa.array([len(encoder.ids(x.as_py())) // 4 for x in batch.column(len(by))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], [*by, "length"])

    schema = picked.select(*by, F.lit(0).cast("long").alias("length")).schema
    return picked.mapInArrow(run, schema).groupBy(*by, "length").agg(F.count(F.lit(1)).alias("docs"))


def answers(histogram: DataFrame, by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """For every length that occurs, taken as a context limit: (by..., length, docs, tokens,
    docs_longer, tokens_longer, docs_within, tokens_within, truncated_tokens, cut_tokens, quantile).

    ``truncated_tokens`` is what remains when every document is cut to the limit, ``cut_tokens`` what
    is lost, ``quantile`` the share of documents within the limit. A limit between two lengths
    follows from the next lower row: the documents longer than it are the same. Sums run within
    blocks of lengths, and over the blocks' totals, which are ``block`` times fewer.
    """
    h = stored(histogram.withColumn("tokens", F.col("length") * F.col("docs")).withColumn("_block", F.floor(F.col("length") / block)))
    keys = [*by, "_block"]
    totals = h.groupBy(*keys).agg(F.sum("docs").alias("_d"), F.sum("tokens").alias("_t"))
    later = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("_block"))
    before = later.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    totals = totals.select(
        *keys, F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_later_d"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_later_t"),
        F.sum("_d").over(whole).alias("_all_d"), F.sum("_t").over(whole).alias("_all_t"),
    )
    longer = Window.partitionBy(*keys).orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    inner = h.select(
        *by, "_block", "length", "docs", "tokens",
        F.coalesce(F.sum("docs").over(longer), F.lit(0)).alias("_in_d"), F.coalesce(F.sum("tokens").over(longer), F.lit(0)).alias("_in_t"),
    )
    same = [h_key.eqNullSafe(t_key) for h_key, t_key in ((F.col(f"i.{k}"), F.col(f"t.{k}")) for k in keys)]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    joined = inner.alias("i").join(totals.alias("t"), condition).select("i.*", "_later_d", "_later_t", "_all_d", "_all_t")
    docs_longer, tokens_longer = F.col("_in_d") + F.col("_later_d"), F.col("_in_t") + F.col("_later_t")
    return joined.select(
        *by, "length", "docs", "tokens", docs_longer.alias("docs_longer"), tokens_longer.alias("tokens_longer"),
        (F.col("_all_d") - docs_longer).alias("docs_within"), (F.col("_all_t") - tokens_longer).alias("tokens_within"),
        (F.col("_all_t") - tokens_longer + docs_longer * F.col("length")).alias("truncated_tokens"),
        (tokens_longer - docs_longer * F.col("length")).alias("cut_tokens"),
        ((F.col("_all_d") - docs_longer) / F.col("_all_d")).alias("quantile"),
    )


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """``answers`` over whole ``docs``; a null group value is a group, an empty table has no rows."""
    return answers(lengths(docs, vocabulary, pattern, text, by), by)
