"""Exact duplicates by a tree merge of sorted digest runs.

Each partition turns its texts into prints (SHA-256, length and an unrelated 64-bit hash) and sorts
them into a run with one entry per print. Runs then meet in binomial rounds: the node number and the
print are read as digits of the same base, and in round ``r`` a node's partners, which differ from
it in digit ``r`` only, exchange the entries of that digit. A node merges the runs it receives
and keeps one verified entry per print, so an entry of a million copies moves once per run and round.
After the last round every node holds the finished entries of its own range of prints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglake.llm.common import attach, stored

# Entries that one node is sized for; and the digits a node number is cut into.
PER_NODE = 200_000
ROUNDS = 2
PRINT = 48
NO_ID = np.iinfo(np.int64).min


def text_print(text: bytes) -> bytes:
    """What two texts must share to count as one: SHA-256, byte length and XXH64 after lower-casing A-Z."""
    from xxhash import xxh64_digest

    text = text.lower()
    return hashlib.sha256(text).digest() + len(text).to_bytes(8, "big") + xxh64_digest(text)


def prints(docs: DataFrame, id_col: str, text: str, row: str | None) -> DataFrame:
    """(id, row, print) per row of ``docs``; ``row`` names a column of distinct numbers, else one is made."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    picked = docs.select(
        F.col(id_col).cast("long").alias("id"), number.alias("row"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = pa.array([text_print(x.as_py()) for x in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests], ["id", "row", "print"])

    return picked.mapInArrow(run, "id long, row long, print binary")


ENTRY = "node int, print binary, id long, row long, size long"


def _merge(largest: bool):
    """Merge the sorted runs of a task into one: per print the id that stays, its row and the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        node, ids, row, size = (rows.column(c).to_numpy() for c in ("node", "id", "row", "size"))
        digests = np.frombuffer(b"".join(rows.column("print").to_pylist()), dtype=">u8").reshape(-1, PRINT // 8)
        digests = digests.astype(np.uint64)
        # stable sorts, which take up the runs already in the input
        rank = (row, ids) if largest else (~row, np.where(ids == NO_ID, NO_ID, ~ids))
        order = np.lexsort((*rank, *digests.T[::-1]))
        sorted_digests = digests[order]
        first = np.concatenate(([True], (sorted_digests[1:] != sorted_digests[:-1]).any(axis=1)))
        starts = np.flatnonzero(first)
        last = np.concatenate((starts[1:], [len(order)])) - 1
        pick = order[last]
        sizes = np.add.reduceat(size[order], starts)
        column = rows.column("print").combine_chunks().take(pa.array(pick))
        for at in range(0, len(pick), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[pick[part]], pa.int32()), column[part], *(pa.array(x[part], pa.int64()) for x in (ids[pick], row[pick], sizes))],
                ["node", "print", "id", "row", "size"],
            )

    return run


def merged(rows: DataFrame, total: int, largest: bool, per_node: int = PER_NODE) -> DataFrame:
    """One entry per print of stored ``rows`` (id, row, print): print, id and row that stay, size."""
    bits = max(ROUNDS, int(np.ceil(np.log2(max(total, 1) / per_node))) if total > per_node else ROUNDS)
    digit = -(-bits // ROUNDS)
    nodes, base = 1 << (digit * ROUNDS), 1 << digit
    entries = rows.select(
        (F.spark_partition_id() % nodes).cast("int").alias("node"), "print", F.coalesce("id", F.lit(int(NO_ID))).alias("id"), "row", F.lit(1).cast("long").alias("size")
    ).mapInArrow(_merge(largest), ENTRY)
    # the leading bits of a print as a number below the number of nodes
    own = F.conv(F.substring(F.hex("print"), 1, 8), 16, 10).cast("long") % nodes
    for turn in range(ROUNDS):
        place = base**turn
        wanted = F.expr(f"node - (node div {place}) % {base} * {place}") + (own / place).cast("long") % base * place
        entries = entries.withColumn("node", wanted.cast("int")).repartitionById(nodes, F.col("node")).mapInArrow(_merge(largest), ENTRY)
    return entries.select("print", F.nullif("id", F.lit(int(NO_ID))).alias("keep_id"), F.col("row").alias("keep_row"), "size")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: str = "largest", row: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: id, row, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. The row
    with the largest (or smallest) id of its group stays; null ids come last, and among rows of one
    id the last row (first row) stays, so exactly one row of every group is kept. Other columns are
    ignored; an empty table gives an empty result.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    rows = stored(prints(docs, id_col, text, row))
    total = rows.count()
    groups = stored(merged(rows, total, keep == "largest"))
    return attach(rows, groups, "print", "size", total).select(
        "id", "row", "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex(F.substring("print", 1, 32))).alias("text_sha256"),
    )
