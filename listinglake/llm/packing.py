"""Best-fit packing of documents into token sequences, under several limits at once.

Documents become pieces; how many pieces there are of each length is all that the plan depends on,
and there are at most as many lengths as a sequence has tokens. The plan is vector best fit in
falling length: sequences with the same residual (tokens, documents, attention cost) form a class,
and pieces of one length go to the class that scores best among those which hold them under every
limit. A placement says that the pieces numbered from r of one length go to the sequences
numbered from s at one offset, so it stays small while the pieces grow; each piece then finds its
placement from its number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listinglake.llm.common import stored
from listinglake.llm.tokens import Encoder


@dataclass(frozen=True)
class Limits:
    """What a sequence holds: tokens, documents (none: as many as fit) and attention cost, the sum of
    squared piece lengths (none: that of one full piece). ``weights`` go with these three in a score."""

    tokens: int = 1024
    documents: int | None = None
    cost: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    score: str = "residual"  # or "dot"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.cost or self.tokens**2], dtype=np.int64)


def plan(counts: dict[int, int], limits: Limits) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first piece, pieces, first sequence, offset) of ``counts`` pieces by length.

    Every step uses up either a length or a class, and a class only ever moves to a smaller
    residual, so there are at most about lengths x pieces-in-a-sequence placements.
    """
    full, weights = limits.vector(), np.array(limits.weights)
    if limits.score not in ("residual", "dot"):
        raise ValueError("score is 'residual' or 'dot'")
    residual = np.zeros((64, 3), dtype=np.int64)
    held = np.zeros(64, dtype=np.int64)  # sequences in a class
    index: dict[tuple[int, int, int], int] = {}
    spans: list[list[tuple[int, int]]] = []
    free: list[int] = []
    out, next_sequence = [], 0

    def join(key: tuple[int, int, int], span: tuple[int, int]) -> None:
        nonlocal residual, held
        if key[0] == 0 or key[1] == 0:
            return
        at = index.get(key)
        if at is None:
            if free:
                at = free.pop()
            else:
                at = len(spans)
                spans.append([])
                if at == len(held):
                    residual, held = np.concatenate((residual, np.zeros_like(residual))), np.concatenate((held, np.zeros_like(held)))
            index[key], residual[at] = at, key
        spans[at].append(span)
        held[at] += span[1]

    for length in sorted(counts, reverse=True):
        item = np.array([length, 1, length * length], dtype=np.int64)
        if (item > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the limits of a sequence")
        left, piece = counts[length], 0
        while left:
            used = len(spans)
            fits = (held[:used] > 0) & (residual[:used] >= item).all(axis=1)
            if fits.any():
                where = np.flatnonzero(fits)
                if limits.score == "residual":
                    score = -((((residual[where] - item) / full) ** 2) * weights).sum(axis=1)
                else:
                    score = ((residual[where] / full) * (item / full) * weights).sum(axis=1)
                at = int(where[np.argmax(score)])
                key = tuple(int(x) for x in residual[at])
                start, n = spans[at].pop()
                take = min(n, left)
                if take < n:
                    spans[at].append((start + take, n - take))
                held[at] -= take
                if not held[at]:
                    del index[key]
                    free.append(at)
                out.append((length, piece, take, start, limits.tokens - key[0]))
                join(tuple(int(x) for x in residual[at] - item), (start, take))
                piece, left = piece + take, left - take
                continue
            each = int((full // item).min())
            sequences, rest = divmod(left, each)
            for here, n in ((each, sequences), (rest, 1)):
                if not (here and n):
                    continue
                for k in range(here):
                    out.append((length, piece, n, next_sequence, k * length))
                    piece += n
                join(tuple(int(x) for x in full - here * item), (next_sequence, n))
                next_sequence += n
            left = 0
    return out


PIECES = "doc_id long, row long, piece int, start long, length int, ids_crc32 long, run int, nth long"


def pieces(docs: DataFrame, vocabulary: str, pattern: str, end_id: int, tokens: int, text: str, id_col: str, with_ids: bool) -> DataFrame:
    """A row per piece; ``nth`` numbers the pieces of one length within one run of the input."""
    picked = docs.select(F.col(id_col).cast("long"), F.monotonically_increasing_id(), F.coalesce(F.col(text), F.lit("")))
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "run", "nth"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def cut(doc, row, text, encoder, seen, run_id):
        ids = encoder.ids(text) + end
        total = len(ids) // 4
        first = total % tokens or tokens
        start = 0
        for piece in range(-(-total // tokens)):
            length = first if piece == 0 else tokens
            part = ids[4 * start:4 * (start + length)]
            yield [doc, row, piece, start, length, zlib.crc32(part), run_id, seen[length]] + [np.frombuffer(part, "<i4").tolist()] * with_ids
            seen[length] += 1
            start += length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, run_id = Encoder(vocabulary, pattern), [0] * (tokens + 1), TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc, row, whole in zip(*(batch.column(i) for i in range(3))):
                for piece in cut(doc.as_py(), row.as_py(), whole.as_py(), encoder, seen, run_id):
                    rows.append(piece)
                    if len(rows) >= 20_000:
                        yield batch_of(rows)
                        rows = []
            if rows:
                yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return picked.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def pack(
    docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 2, limits: Limits = Limits(), text: str = "text", id_col: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """A row per piece: doc_id, row, piece, start, length, ids_crc32, sequence_id, offset (, ids).

    Only documents longer than a sequence are cut, and only their first piece may be short. A null
    or empty text is the end id alone; null ids are kept; repeated rows are packed each for itself
    (``row`` tells them apart); other columns are ignored; an empty table gives an empty result.
    """
    cut = stored(pieces(docs, vocabulary, pattern, end_id, limits.tokens, text, id_col, with_ids))
    spark = docs.sparkSession
    # one row per run and length, numbered on per length
    per_run = stored(cut.groupBy("run", "length").agg(F.count(F.lit(1)).alias("n")))
    # at most as many rows as a sequence has tokens
    counts = {r.length: r.n for r in per_run.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = np.array(plan(counts, limits) or np.zeros((0, 5)), dtype=np.int64).reshape(-1, 5)
    placed = placed[np.lexsort((placed[:, 1], placed[:, 0]))]
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_run.select("run", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["run", "length"]).select(*[c for c in cut.columns if c not in ("run", "nth")], (F.col("base") + F.col("nth")).alias("nth"))

    lengths, firsts = placed[:, 0], placed[:, 1]
    begin = {int(n): int(i) for n, i in zip(*np.unique(lengths, return_index=True))}
    end = {n: i + int((lengths == n).sum()) for n, i in begin.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = batch.column("length").to_numpy(), batch.column("nth").to_numpy()
            at = np.zeros(len(nth), dtype=np.int64)
            for n in np.unique(length).tolist():
                mine = length == n
                at[mine] = begin[n] + np.searchsorted(firsts[begin[n]:end[n]], nth[mine], "right") - 1
            sequence = placed[at, 3] + nth - placed[at, 1]
            kept = [batch.column(c) for c in out_names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(placed[at, 4])], [*out_names, "sequence_id", "offset"])

    out_names = [c for c in ranked.columns if c != "nth"]
    schema = ranked.select(*out_names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.mapInArrow(place, schema)
