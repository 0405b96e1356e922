"""Near duplicates by SimHash fingerprints, found through deletion-variant signatures.

Two 64-bit fingerprints that differ in at most three bits have a half that differs in at most one.
So each distinct fingerprint is filed under both halves whole, and under each half with one bit
position left out: fingerprints with a near half share one of these 66 signatures. Fingerprints
meet by equality of signature and are verified bit by bit.

A signature shared by more than ``BLOCK`` fingerprints is not compared as it stands: its members are
filed again by the half of what is still free, with the differences that are still allowed. After
two such steps eight bits are free and a signature holds at most 2,048 fingerprints, so the search
is exact and no comparison group exceeds ``BLOCK``. Within a signature, members are linked to the
smallest of those they reach; pairs are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglake.llm.common import attach, components, stored

BITS = 64
MOST_BITS = 3
BLOCK = 4096
SEED = 42
# Shingles whose bits are counted at once.
CHUNK = 65_536


def fingerprint(text: bytes, words_each: int) -> int:
    """The SimHash of one text: a bit is set if over half of the shingles' hashes have it."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # on bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[words_each - 1:].tolist() if len(words) >= words_each else [len(joined)]
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)), "<u8", len(ends))
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", words_each: int = 3) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long; a null text counts as empty."""
    picked = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py(), words_each) for x in batch.column(len(keep))]
            column = pa.array(np.array(values, dtype="<u8").view("<i8"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], [*keep, "fp"])

    schema = picked.select(*keep, F.lit(0).cast("long").alias("fp")).schema
    return picked.mapInArrow(run, schema)


def signatures(free: DataFrame) -> DataFrame:
    """Signatures of ``free`` (key, fp, lo, width, most): one half of the free bits, whole or without one bit.

    ``lo`` and ``width`` name the bits in which members of ``key`` may still differ, ``most`` in how
    many. With fewer than two allowed differences a half must be equal, so only whole halves count.
    ``side`` is the left-out bit: only fingerprints with different sides are new to each other.
    """
    half = F.expr("width div 2")
    each = F.when(F.col("most") >= 2, half + 1).otherwise(F.lit(1))
    lots = free.withColumn("_v", F.explode(F.sequence(F.lit(0), 2 * each - 1))).withColumn("_each", each)
    at = F.expr("_v % _each")  # 0: whole; i: without bit i - 1 of the half
    upper = F.expr("_v div _each")
    low = F.col("lo") + upper * half.cast("int")
    bits = F.expr("shiftrightunsigned(fp, cast(lo + (_v div _each) * (width div 2) as int))")
    value = F.when(half == 32, bits.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(
        bits.bitwiseAND(F.expr("shiftleft(1L, cast(width div 2 as int)) - 1"))
    )
    lots = lots.select("key", "fp", "lo", "width", "most", at.alias("_at"), upper.alias("_up"), low.alias("_low"), value.alias("_value"))
    mask = F.expr("shiftleft(1L, cast(_at - 1 as int))")
    return lots.select(
        F.xxhash64("key", "_up", "_at", F.when(F.col("_at") == 0, F.col("_value")).otherwise(F.expr("_value & ~shiftleft(1L, cast(_at - 1 as int))"))).alias("key"),
        "fp",
        F.when(F.col("_at") == 0, 2).otherwise((F.col("_value").bitwiseAND(mask) != 0).cast("int")).alias("side"),
        (F.col("lo") + (1 - F.col("_up")) * F.expr("width div 2")).cast("int").alias("lo"),
        F.expr("cast(width div 2 as int)").alias("width"),
        F.when(F.col("_at") == 0, F.col("most")).otherwise(F.col("most") - 1).cast("int").alias("most"),
    )


def _reached(members: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each member to the smallest member it reaches, by a search that shrinks as it finds."""
    members = np.unique(members)
    a, b = [], []
    left = members
    while len(left):
        root, left, queue = left[0], left[1:], [left[0]]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= most
            if near.any():
                found, left = left[near], left[~near]
                queue.extend(found)
                a.append(found)
                b.append(np.full(len(found), root))
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def _links(most: int, block: int):
    """Rows sorted by key in; links (width 0: a, b) and members of crowded keys (key, fp, ...) out."""
    names = ["a", "b", "lo", "width", "most"]

    def out(a, b, lo, width, allowed):
        arrays = [pa.array(np.asarray(a).astype(np.int64)), pa.array(np.asarray(b).astype(np.int64))]
        return pa.RecordBatch.from_arrays(arrays + [pa.array(np.asarray(x).astype(np.int32)) for x in (lo, width, allowed)], names)

    def complete(key, fp, side):
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        mixed = (np.minimum.reduceat(side, starts) != np.maximum.reduceat(side, starts)) | (side[starts] == 2)
        twos = starts[(sizes == 2) & mixed]
        near = twos[np.bitwise_count(fp[twos] ^ fp[twos + 1]) <= most]
        a, b = [fp[near]], [fp[near + 1]]
        for at, size in zip(*(x[(sizes > 2) & mixed] for x in (starts, sizes))):
            for into, x in zip((a, b), _reached(fp[at:at + size], most)):
                into.append(x)
        return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, crowded = None, None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            if waiting is not None:
                now = [np.concatenate(x) for x in zip(waiting, now)]
            if not len(now[0]):
                continue
            if crowded is not None:  # the rest of a key that was found crowded before
                rest = now[0] == crowded
                yield out(*(x[rest] for x in (now[0], now[1], now[3], now[4], now[5])))
                now = [x[~rest] for x in now]
                waiting = None
                if not len(now[0]):
                    continue
                crowded = None
            last = np.searchsorted(now[0], now[0][-1])
            done = [x[:last] for x in now]
            waiting = [x[last:] for x in now]
            if len(waiting[0]) > block and waiting[4][0] >= 16:
                crowded = waiting[0][0]
                yield out(*(waiting[i] for i in (0, 1, 3, 4, 5)))
                waiting = None
            yield from parts(done)
        if waiting is not None:
            yield from parts(waiting)

    def parts(rows):
        """Whole keys: the crowded ones are passed on, the others compared."""
        if not len(rows[0]):
            return
        _, where, sizes = np.unique(rows[0], return_inverse=True, return_counts=True)
        over = (sizes[where] > block) & (rows[4] >= 16)
        if over.any():
            yield out(*(rows[i][over] for i in (0, 1, 3, 4, 5)))
            rows = [x[~over] for x in rows]
        if len(rows[0]):
            a, b = complete(rows[0], rows[1].view(np.uint64), rows[2])
            none = np.zeros(len(a))
            yield out(a, b, none, none, none)

    return run


def near_links(fps: DataFrame, most: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fps`` (fp) that join all within ``most`` bits of each other.

    Not every pair is listed, but whatever a chain of near pairs connects, the links connect.
    """
    if not 0 <= most <= 3:
        raise ValueError("halves differ in at most one bit only up to three differing bits")
    schema = "a long, b long, lo int, width int, most int"
    free = fps.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(0).alias("lo"), F.lit(BITS).alias("width"), F.lit(most).alias("most"))
    found = []
    while True:
        filed = signatures(free).repartition("key").sortWithinPartitions("key")
        out = stored(filed.select("key", "fp", "side", "lo", "width", "most").mapInArrow(_links(most, block), schema))
        found.append(out.where("width = 0").select("a", "b"))
        crowded = out.where("width > 0")
        if crowded.isEmpty():
            break
        free = crowded.select(F.col("a").alias("key"), F.col("b").alias("fp"), "lo", "width", "most")
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", words_each: int = 3, most: int = MOST_BITS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``keep`` columns, fp, component_id, component_rows.

    ``component_id`` is the smallest id among all rows whose fingerprints are linked, directly or
    through others. Null and empty texts and texts of spaces have fingerprint 0 and link like any
    other; a null id gets its group's smallest id and is null only if no row of the group has one;
    repeated rows stay repeated; other columns are ignored; an empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, [id_col, *keep], text, words_each))
    nodes = stored(rows.groupBy("fp").agg(F.min(id_col).alias("_least"), F.count(F.lit(1)).alias("_size")))
    labels = components(near_links(nodes.select("fp"), most))
    rooted = stored(
        nodes.join(labels, nodes.fp == labels.node, "left")
        .select("fp", "_least", "_size", F.coalesce("label", "fp").alias("_root"))
    )
    roots = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"), F.sum("_size").alias("component_rows"))
    groups = stored(rooted.join(roots, "_root").select("fp", "_size", "component_id", "component_rows"))
    return attach(rows, groups, "fp", "_size", rows.count()).drop("_size")
