"""Tokens of two tokenizers aligned by the bytes at which both end, and how often ids are linked.

Texts go through Arrow arrays: lists of ids are flattened with their parent indices, byte ends are
running sums of token lengths less their document's start, and an Acero hash join on (document, end)
finds where tokens of both sides end together. Those ends cut a text into groups, and each links the
two tokens that end there.

Tasks count the linked id pairs of a block of documents (Table.group_by) and hand on one row per pair
and block; Spark merges them. A document keeps its links as places in its block's list of pairs, so the
merged counts travel back once per pair and block, never once per link.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglake.llm.common import attach, stored
from listinglake.llm.tokens import REMEMBERED, Encoder, byte_of_char

# Bytes of text that go through Arrow at once, and that share one list of pairs.
CHUNK_BYTES, BLOCK_BYTES = 2 << 20, 16 << 20
SPACE = "▁"


def byte_level_entries(vocabulary: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary file."""
    with open(vocabulary, encoding="utf-8") as file:
        entries = json.load(file)["model"]["vocab"]
    of = byte_of_char()
    out = [b""] * (max(entries.values()) + 1)
    for entry, number in entries.items():
        out[number] = bytes(map(of.__getitem__, entry)) if all(c in of for c in entry) else entry.encode()
    return out


class PieceEncoder:
    """Ids of whole texts by a piece model, word by word; a task remembers the words it has met.

    No piece holds a space after another character (refused otherwise), so merges never cross from
    one word into the next.
    """

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(SPACE in piece.lstrip(SPACE) for piece in self.pieces):
            raise ValueError("pieces that reach over a space can't be encoded word by word")
        self.known: dict[str, bytes] = {}

    def entries(self) -> list[bytes]:
        """The bytes of every id."""
        of_byte = self.model.is_byte
        return [bytes([int(p[3:5], 16)]) if of_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]

    def ids(self, text: str) -> bytes:
        words, known = re.findall(" +[^ ]*", " " + text), self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            new = [w for w in dict.fromkeys(words) if w not in known]
            # the model puts a space in front by itself, except for an empty text
            for word, ids in zip(new, self.model.encode([w[1:] for w in new], num_threads=1)):
                known[word] = np.asarray(ids if word != " " else [self.model.piece_to_id(SPACE)], dtype="<u4").tobytes()
            return b"".join(map(known.__getitem__, words))


def _lists(ids: list[bytes]) -> pa.LargeListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)))
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))


class Side:
    """One tokenizer's share of a chunk: ids by document, and what its tables say of them."""

    def __init__(self, ids: pa.LargeListArray, lengths: pa.Array):
        self.flat, self.parent = pc.list_flatten(ids), pc.list_parent_indices(ids)
        self.counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        self.lengths = pc.take(lengths, self.flat)

    def ends(self) -> pa.Table:
        """(doc, end, at): where each token ends within its document; running sums less the document's start."""
        running = pc.cumulative_sum(self.lengths)
        last = np.concatenate(([0], running.to_numpy()))[np.concatenate(([0], np.cumsum(self.counts)[:-1]))] if len(self.counts) else []
        start = pc.take(pa.array(last, pa.int64()), self.parent)
        return pa.table({"doc": self.parent, "end": pc.subtract(running, start), "at": np.arange(len(self.flat))})


class Aligner:
    """Both tokenizers and their tables; aligns chunks of texts."""

    def __init__(self, vocabulary: str, pattern: str, model: str):
        self.a, self.b = Encoder(vocabulary, pattern), PieceEncoder(model)
        entries = byte_level_entries(vocabulary), self.b.entries()
        self.entries = [pa.array(x, pa.large_binary()) for x in entries]
        self.lengths = [pa.array([len(e) for e in x], pa.int64()) for x in entries]
        self.width = len(entries[1])
        most = max(map(len, entries))
        self.written = pa.array([f"{i}{end}" for i in range(most) for end in ",|;"], pa.large_string())

    def _fits(self, ids: list[pa.LargeListArray], wholes: list[bytes]) -> np.ndarray:
        """Documents with a text whose tokens, joined, are its bytes on both sides."""
        fit = np.array([len(w) > 1 for w in wholes], dtype=bool)
        for side, entries in zip(ids, self.entries):
            joined = pc.take(entries, side.values)
            bounds = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + len(joined) + 1][side.offsets.to_numpy()]
            data = memoryview(joined.buffers()[2] or b"").cast("B")
            for i, whole in enumerate(wholes):
                fit[i] = fit[i] and data[bounds[i]:bounds[i + 1]] == whole
        return fit

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Per text: A tokens, B tokens, groups and their digest; and the id pairs of all links in order."""
        ids = [_lists([side.ids(front + t) for t in texts]) for side, front in ((self.a, " "), (self.b, ""))]
        fit = self._fits(ids, [b" " + t.encode() for t in texts])
        keep = pa.array(np.flatnonzero(fit))
        a, b = (Side(pc.take(x, keep), n) for x, n in zip(ids, self.lengths))
        met = a.ends().join(b.ends(), keys=["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False)
        met = met.sort_by("at")
        at, at_b, doc = (met.column(c).to_numpy() for c in ("at", "at_b", "doc"))
        digests = self._digests(a, b, at, at_b)
        n = len(texts)
        out_a, out_b, groups, digest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n
        out_a[fit], out_b[fit] = a.counts, b.counts
        groups[fit] = np.bincount(doc, minlength=len(keep))
        for i, d in zip(np.flatnonzero(fit), digests):
            digest[i] = d
        pairs = a.flat.to_numpy()[at].astype(np.int64) * self.width + b.flat.to_numpy()[at_b]
        return out_a, out_b, groups, digest, pairs

    def _digests(self, a: Side, b: Side, at: np.ndarray, at_b: np.ndarray) -> list[str]:
        """SHA-256 of each document's groups, written with ids in decimal; every document's end ends a group."""
        n_a, n_b = np.diff(at, prepend=-1), np.diff(at_b, prepend=-1)
        # a group's A tokens follow the B tokens of those before it, its B tokens follow its own A tokens
        place_a = np.arange(len(a.flat)) + np.repeat(np.cumsum(n_b) - n_b, n_a)
        place_b = np.arange(len(b.flat)) + np.repeat(np.cumsum(n_a), n_b)
        which = np.empty(len(place_a) + len(place_b), dtype=np.int64)
        which[place_a], which[place_b] = a.flat.to_numpy() * 3, b.flat.to_numpy() * 3
        which[place_a[at]] += 1
        which[place_b[at_b]] += 2
        written = pc.take(self.written, pa.array(which))
        bounds = np.frombuffer(written.buffers()[1], np.int64)[np.concatenate(([0], np.cumsum(a.counts + b.counts)))]
        data = memoryview(written.buffers()[2] or b"")
        return [hashlib.sha256(data[s:e - 1]).hexdigest() for s, e in zip(bounds, bounds[1:])]


# Rows of documents (kind 0) and of a block's pairs (kind 1).
ALIGNED = "kind int, block long, id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, at int, pair long, n long"
ALIGNED_ARROW = pa.schema([
    ("kind", pa.int32()), ("block", pa.int64()), ("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("groups_sha256", pa.string()), ("links", pa.binary()), ("at", pa.int32()), ("pair", pa.int64()), ("n", pa.int64()),
])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, as many as fit in a chunk, at least one."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, (name, size) in enumerate(zip(batch.column(0).to_pylist(), pc.binary_length(batch.column(1)).to_pylist())):
            if texts and held + size > CHUNK_BYTES:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(name)
            texts.append(batch.column(1)[i].as_py())
            held += size
    if texts:
        yield ids, texts


def _aligned(vocabulary: str, pattern: str, model: str):
    """(id, text) in, rows of ``ALIGNED`` out."""

    def typed(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in ALIGNED_ARROW], schema=ALIGNED_ARROW
        )

    def finish(block: int, done: list) -> Iterator[pa.RecordBatch]:
        every = pa.array(np.concatenate([d[-1] for d in done]))
        counted = pa.table({"pair": every}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
        pairs = counted.column("pair").combine_chunks()
        at = pc.index_in(every, value_set=pairs).to_numpy(zero_copy_only=False).astype("<i4")
        start = 0
        for ids, n_a, n_b, groups, digests, _ in done:
            bounds = start + np.concatenate(([0], np.cumsum(groups)))
            start = bounds[-1]
            links = [at[s:e].tobytes() for s, e in zip(bounds, bounds[1:])]
            yield typed(len(ids), kind=[0] * len(ids), block=[block] * len(ids), id=ids, n_a=n_a, n_b=n_b, n_groups=groups, groups_sha256=digests, links=links)
        for s in range(0, len(pairs), 50_000):
            part, n = pairs[s:s + 50_000], counted.column("count_all").combine_chunks()[s:s + 50_000]
            yield typed(len(part), kind=[1] * len(part), block=[block] * len(part), at=np.arange(s, s + len(part), dtype=np.int32), pair=part, n=n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(vocabulary, pattern, model)
        block, done, held = TaskContext.get().partitionId() << 32, [], 0
        for ids, texts in _chunks(batches):
            done.append((ids, *aligner.align(texts)))
            held += sum(map(len, texts))
            if held >= BLOCK_BYTES:
                yield from finish(block, done)
                block, done, held = block + 1, [], 0
        if done:
            yield from finish(block, done)

    return run


RESULT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's documents (id, ..., links) and its pairs (at, count, best); sums over each document's links."""
    count, best = (np.zeros(pairs.num_rows, np.int64) for _ in range(2))
    place = pairs.column("at").to_numpy()
    count[place], best[place] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    sums = []
    for links in docs.column("links"):
        at = np.frombuffer(links.as_py(), "<i4")
        sums.append((len(at), int(best[at].sum()), int(count[at].sum())))
    n_links, n_best, count_sum = (pa.array([s[k] for s in sums], pa.int64()) for k in range(3))
    names = ["id", "n_a", "n_b", "n_groups"]
    return pa.table([*(docs.column(c) for c in names), n_links, n_best, count_sum, docs.column("groups_sha256")], [*names, "n_links", "n_best", "count_sum", "groups_sha256"])


def alignment(docs: DataFrame, vocabulary: str, pattern: str, model: str, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and (a, b, count, best) per linked id pair.

    Side A encodes a space and the text, side B the text, which gets its space from the model. Null
    and empty texts, and texts whose tokens don't join to the same bytes, have no tokens: zeros and
    an empty digest. Best are pairs with their B id's highest count, ties included. Ids may be null
    or repeated, each row is a document; other columns are ignored; an empty table gives empty results.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = stored(picked.mapInArrow(_aligned(vocabulary, pattern, model), ALIGNED))
    pairs = rows.where("kind = 1").select("block", "at", "pair", "n")
    width = PieceEncoder(model).model.get_piece_size()
    counts = stored(pairs.groupBy("pair").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("_blocks")).withColumn("b", F.col("pair") % width))
    # one row per id of side B at most
    highest = counts.groupBy("b").agg(F.max("count").alias("_most"))
    counts = stored(counts.join(F.broadcast(highest), "b").withColumn("best", F.col("count") == F.col("_most")).drop("_most"))
    known = attach(pairs.drop("n"), counts.drop("b"), "pair", "_blocks", pairs.count()).select(F.col("block").alias("of"), "at", "count", F.col("best").cast("int").alias("best"))
    placed = rows.where("kind = 0").select("block", "id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    found = placed.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_summed, RESULT)
    ids = counts.select(F.expr(f"pair div {width}").alias("a"), "b", "count", "best")
    return found, ids
