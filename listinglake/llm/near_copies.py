"""Near copies by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Each text is filed under ``BANDS`` keys, each made of ``ROWS`` minima of its shingles under
different permutations; a pair of similarity s shares a key but for a chance of (1 - s^5)^30, which
is 7 in a million at 0.8 and less above. Sharing a key decides nothing: texts that do are compared
by their whole shingle sets.

A text is a near copy if a text before it is similar, whether or not that one is a near copy too, so
the answer doesn't depend on the order of comparison. Every text is compared with the first of each
of its keys before anything else. A large group of copies is settled by that, and only texts that no
first one resembles meet the others of their keys, at most ``BLOCK`` in one group.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglake.llm.common import attach, stored

WORDS_EACH = 5
SIMILAR = 0.8
BANDS, ROWS = 30, 5
BLOCK = 4096
SEED = 42
# Shingles whose minima are taken at once.
CHUNK = 1024
# Odd multipliers permute the 64-bit hashes; a fixed draw.
PERMUTED = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words_each: int = WORDS_EACH) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, an empty one too."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # on bytes: A-Z and the six ASCII spaces only
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[words_each - 1:].tolist() if len(words) >= words_each else [len(joined)]
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)), "<u8", len(ends)))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed long per band."""
    from xxhash import xxh64_intdigest

    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, (PERMUTED * hashes[at:at + CHUNK]).min(axis=1), out=least)
    bands = least.astype("<u8").reshape(BANDS, ROWS)
    return [xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(bands)]


def _keys(rows: DataFrame, id_col: str, row: str, text: str) -> DataFrame:
    """(id, row, keys) of every row."""
    picked = rows.select(F.col(id_col).alias("id"), F.col(row).alias("row"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([band_keys(shingles(x.as_py())) for x in batch.column(2)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], keys], ["id", "row", "keys"])

    return picked.mapInArrow(run, picked.select("id", "row", F.lit(None).cast("array<long>").alias("keys")).schema)


def _sets(rows: DataFrame, row: str, text: str) -> DataFrame:
    """(row, hashes) of every row, the shingles' hashes as bytes."""
    picked = rows.select(F.col(row).alias("row"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingles(x.as_py()).tobytes() for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["row", "hashes"])

    return picked.mapInArrow(run, "row long, hashes binary")


def _alike(common, a, b):
    return common >= SIMILAR * (a + b - common) - 1e-9


def _first_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (row, mine, theirs), the row of those whose two sets are similar."""
    for batch in batches:
        found = []
        for row, mine, theirs in zip(*batch.columns):
            a, b = (np.frombuffer(x.as_py(), "<u8") for x in (mine, theirs))
            if min(len(a), len(b)) >= SIMILAR * max(len(a), len(b)) - 1e-9:
                common = len(np.intersect1d(a, b, assume_unique=True))
                if _alike(common, len(a), len(b)):
                    found.append(row.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["row"])


class _Group:
    """The texts of one key and block that others are compared with, in their order."""

    def __init__(self):
        self.ranks: list[tuple] = []
        self.sets: list[np.ndarray] = []
        self.hashes = None

    def add(self, rank: tuple, hashes: np.ndarray) -> None:
        self.ranks.append(rank)
        self.sets.append(hashes)

    def before(self, rank: tuple, hashes: np.ndarray) -> bool:
        """Whether a text of the group that comes before ``rank`` is similar."""
        until = bisect.bisect_left(self.ranks, rank)
        if not until:
            return False
        if self.hashes is None:
            self.sizes = np.array([len(s) for s in self.sets])
            every, owners = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.sizes)
            order = np.argsort(every, kind="stable")
            self.hashes, self.owners, self.sets = every[order], owners[order], []
        start, end = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        some = end > start
        start, counts = start[some], (end - start)[some]
        places = np.arange(counts.sum()) + np.repeat(start - np.cumsum(counts) + counts, counts)
        common = np.bincount(self.owners[places], minlength=len(self.sizes))
        return bool(_alike(common[:until], self.sizes[:until], len(hashes)).any())


def _others_alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, asks, last, id, row, hashes) sorted by the first six in; rows with a similar one before them out.

    In each group those that are compared with come first, then those that ask.
    """
    now, group = None, _Group()
    for batch in batches:
        found = []
        for key, block, asks, last, name, row, hashes in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, block) != now:
                now, group = (key, block), _Group()
            rank, values = (last, 0 if last else name, row), np.frombuffer(hashes, "<u8")
            if not asks:
                group.add(rank, values)
            elif group.ranks and group.before(rank, values):
                found.append(row)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["row"])


def near_copies(rows: DataFrame, id_col: str = "doc_id", row: str = "_row", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(row) of each of the stored ``rows`` that has a similar text before it, in the order of ids, then of ``row``.

    Null ids come last. Null and empty texts and texts of spaces are similar to each other and to
    nothing else; ``row`` is a long that differs in each row; an empty table gives an empty result.
    """
    keyed = stored(_keys(rows, id_col, row, text))
    total = keyed.count() * BANDS
    filed = keyed.select("id", "row", F.explode("keys").alias("key"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"]
    shared = stored(filed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).where("n > 1"))
    members = stored(attach(filed, shared, "key", "n", total).where("n is not null"))
    sets = stored(_sets(rows.join(members.select(F.col("row").alias(row)).distinct(), row, "left_semi"), row, text))

    asked = members.where("row <> first").select("row", "first").distinct()
    asking = stored(asked.join(sets, "row").select("row", "first", F.col("hashes").alias("mine")))
    often = asking.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    firsts = stored(often.join(sets, F.col("first") == F.col("row")).select("first", "n", F.col("hashes").alias("theirs")))
    met = attach(asking, firsts, "first", "n", asking.count()).select("row", "mine", "theirs")
    copies = stored(met.mapInArrow(_first_alike, "row long").distinct())

    left = stored(members.where("n > 2 and row <> first").join(copies, "row", "left_anti"))
    size = F.ceil(F.col("n") / F.lit(block)).cast("int")
    open_keys = stored(left.groupBy("key").agg(F.max("n").alias("size")))
    # the first of a key has met all the others
    others = attach(members.where("n > 2 and row <> first"), open_keys, "key", "size", total).where("size is not null")
    shape = ["key", "block", "asks", "id", "row"]
    there = others.withColumn("block", F.pmod(F.xxhash64("row"), size).cast("int")).withColumn("asks", F.lit(False)).select(*shape)
    ask = left.withColumn("block", F.explode(F.sequence(F.lit(0), size - 1))).withColumn("asks", F.lit(True)).select(*shape)
    groups = there.unionByName(ask).join(sets, "row").select("key", "block", "asks", F.col("id").isNull().alias("last"), "id", "row", "hashes")
    dealt = groups.repartition("key", "block").sortWithinPartitions("key", "block", "asks", "last", "id", "row")
    more = dealt.mapInArrow(_others_alike, "row long").distinct()
    return stored(copies.unionByName(more).distinct())
