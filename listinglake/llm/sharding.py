"""Shards cut from a Hilbert curve through the documents' metadata.

Language, source and size are quantised to cells in their own order, each of about equally many
rows, the cells numbered along a Hilbert curve, and the rows, sorted by that number, cut into runs of
equal length. Neighbours on the curve are near in every dimension, so a shard spans few languages,
sources and sizes, and a reader that filters on any of them skips files by their minima and maxima.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listinglake.llm.common import numbered, stored

BITS = 5
# Accuracy of the size quantiles: they place cells, whatever they are every row gets its shard.
ACCURACY = 10_000


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of ``cells`` (rows x dimensions), each below 2**bits.

    Coordinates are turned, from the highest bit down, into the frame of the sub-cube they lie in;
    their bits, interleaved and undone of the Gray code, are the index.
    """
    x = cells.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        below = bit - one
        for d in range(dims):
            set_ = (x[d] & bit) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[d]) & below)
            x[0] ^= np.where(set_, below, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    fold = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        fold ^= np.where((x[-1] & bit) != 0, bit - one, np.uint64(0))
    x ^= fold
    index = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << one) | ((x[d] >> np.uint64(level)) & one)
    return index.astype(np.int64)


def _name_edges(rows: DataFrame, name: str, cells: int) -> list[str]:
    """The first name of each of at most ``cells`` runs of names in order, of about equally many rows each.

    Names are counted, sorted and added up where they lie; one row per run comes to the driver.
    """
    counted = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    ordered = stored(counted.orderBy("name").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    total = ordered.agg(F.sum("n")).first()[0]
    if not total:
        return []
    # one row per task of the sort
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ordered.groupBy("_part").agg(F.sum("n").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    upto = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    # by the middle of its rows, so that a name with more rows than a run holds has one to itself
    middle = 2 * (F.col("_start") + F.sum("n").over(upto)) - F.col("n")
    run = F.floor(middle.cast("decimal(38,0)") * cells / (2 * total))
    return sorted(r.first for r in ordered.join(F.broadcast(sums), "_part").withColumn("_run", run).groupBy("_run").agg(F.min("name").alias("first")).collect())


def _name_cells(values: pd.Series, edges: list[str], cells: int) -> np.ndarray:
    """0 for null, else 1 and up by the run that a name falls into, spread over all cells."""
    codes, distinct = pd.factorize(values)
    step = max(1, (cells - 1) // max(1, len(edges)))
    ranks = np.array([1 + step * max(bisect_right(edges, name) - 1, 0) for name in distinct] + [0], dtype=np.int64)
    return ranks[codes]  # null has the code -1, the last rank


def shards(
    docs: DataFrame, n: int, id_col: str = "doc_id", text: str = "text", names: tuple[str, ...] = ("lang", "source"), bits: int = BITS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """A row per row of ``docs``: id, keep columns, size, text_crc32, cell, shard (0 to n - 1), slot.

    Sizes are the text's UTF-8 bytes plus 8, a null text has none. Counts of shards differ by one at
    most. Null names form a cell of their own, other names share one with neighbours in order, ties on the curve follow id, size and text checksum
    with nulls first, and rows equal in all of these are interchangeable; an empty table gives an
    empty result.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    named = F.array(*[F.col(c).cast("string") for c in names])
    meta = stored(docs.select(F.col(id_col).alias("id"), *keep, size.alias("size"), crc.alias("text_crc32"), named.alias("_named")))
    cells = 1 << bits
    firsts = [_name_edges(meta.select(F.col("_named")[i].alias("_name")), "_name", cells - 1) for i in range(len(names))]
    inner = [i / (1 << bits) for i in range(1, 1 << bits)]
    bounds = meta.agg(F.percentile_approx("size", inner, ACCURACY)).first()[0] or [0]
    edges = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("long")
    def curve(named: pd.Series, size: pd.Series) -> pd.Series:
        if not len(named):
            return pd.Series([], dtype="int64")
        sized = np.searchsorted(edges, size.to_numpy(), "left")
        rows = named.to_numpy()
        of_names = [_name_cells(pd.Series([row[i] for row in rows], dtype=object), firsts[i], cells) for i in range(len(firsts))]
        return pd.Series(hilbert(np.column_stack((*of_names, sized)), bits))

    celled = stored(meta.select("id", *keep, "size", "text_crc32", curve("_named", "size").alias("cell")))
    total = celled.count()
    each, extra = divmod(total, n)
    placed = numbered(celled.orderBy("cell", "id", "size", "text_crc32"), "_place")
    # the first ``extra`` shards hold one row more
    long_end = extra * (each + 1)
    place = F.col("_place")
    in_long = place < long_end
    shard = F.when(in_long, F.floor(place / (each + 1))).otherwise(extra + F.floor((place - long_end) / max(each, 1))).cast("int")
    slot = F.when(in_long, place % (each + 1)).otherwise((place - long_end) % max(each, 1)).cast("long")
    return placed.select("id", *keep, "size", "text_crc32", "cell", shard.alias("shard"), slot.alias("slot"))


def write(docs: DataFrame, placed: DataFrame, path: str, row: str = "_row", files_per_shard: int = 1) -> None:
    """Write ``docs`` into a folder per shard; ``placed`` comes from ``shards`` with ``keep=(row,)``.

    A shard's rows are dealt over ``files_per_shard`` ranges of slots, each sorted, so that files keep
    narrow minima and maxima. Columns of ``docs`` that are called shard, slot or cell in any spelling are
    written as ``<name>_given``.
    """
    taken = {c.lower() for c in docs.columns}
    for c in docs.columns:
        if c.lower() in ("shard", "slot", "cell"):
            free = next(n for n in (f"{c}_given" + "_" * i for i in range(len(taken) + 1)) if n.lower() not in taken)
            docs = docs.withColumnRenamed(c, free)
    parts = docs.join(placed.select(row, "shard", "slot", "cell"), row)
    (
        parts.repartitionByRange(max(1, files_per_shard) * 24, "shard", "slot").sortWithinPartitions("shard", "slot")
        .drop(row).write.partitionBy("shard").parquet(path)
    )
