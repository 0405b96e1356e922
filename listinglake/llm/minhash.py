"""MinHash fingerprints of documents and of edited texts, and classes of similar documents.

A text's shingles of five words are hashed in numpy: words by a polynomial over their bytes, shingles
from their words' hashes. ``PERMUTATIONS`` universal hash permutations a x + b (mod 2^64) each keep
their smallest value, of which a fingerprint holds 16 mixed bits. Four minima make a band, whose
64 bits are the key that Spark joins on: a pair of similarity s shares none of the 24 with a chance
of (1 - s^4)^24, 3 in a million at 0.8. Sharing a key decides nothing; whole shingle sets do.

Texts that share a key are compared with the first of them. Who is that similar needs no more, and the
distance 1 - similarity is a metric: a text further than twice the bound from the first has no similar
text among those within the bound. Only what is still open meets the others of its key, in blocks of a
bounded number of shingles.

For the edited text each document meets the next one: texts are packed, sorted by falling id over
range partitions, and read in order; the ends of partitions are joined afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listinglake.llm.common import HEAVY, SALTS, components, meet, settled, stored
from listinglake.skew import attach

WORDS_EACH = 5
SIMILAR = 0.8
PERMUTATIONS, ROWS = 96, 4
BANDS = PERMUTATIONS // ROWS
SEED = 11
# Shingles permuted at once; bytes of a text hashed at once; shingles of the texts compared in one task.
CHUNK, SLICE, BLOCK = 512, 1 << 20, 4_000_000
SLACK = 1e-9

_draw = np.random.default_rng(SEED)
_odd = lambda n: _draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TIMES, PLUS = _odd(PERMUTATIONS)[:, None], _odd(PERMUTATIONS)[:, None] - np.uint64(1)
PLACE = _odd(WORDS_EACH)
OF_BYTE = _odd(256)
BASE = int(_odd(1)[0]) | 5
# A-Z is lower-cased and the six ASCII spaces become one.
FOLDED = bytes(32 if b in b"\t\n\v\f\r " else b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of ``BASE`` and of its inverse mod 2^64, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 14)
            self.up, self.down = (
                np.cumprod(np.array([1, *[b] * (size - 1)], dtype=np.uint64)) for b in (BASE, pow(BASE, -1, 2**64))
            )
        return self.up[:n], self.down[:n]


_powers = _Powers()


def word_hashes(text: bytes) -> np.ndarray:
    """One hash per word, in order; a long text slice by slice, cut at spaces."""
    text, at, out = text.translate(FOLDED), 0, []
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            end = cut + 1 if cut >= 0 else (text.find(b" ", end) + 1 or len(text))
        codes = np.frombuffer(text[at:end], np.uint8)
        up, down = _powers.of(len(codes))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes != 32).view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2]
        running = np.concatenate(([np.uint64(0)], np.cumsum(OF_BYTE[codes] * up)))
        out.append(mix((running[ends] - running[starts]) * down[starts]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: bytes, words_each: int = WORDS_EACH) -> np.ndarray:
    """Hashes of the shingles, repeats included; a shorter text is one shingle, a text without words none."""
    words = word_hashes(text)
    if not len(words):
        return words
    each = min(words_each, len(words))
    total = np.full(len(words) - each + 1, each, dtype=np.uint64)
    for i in range(each):
        total += words[i:len(words) - each + 1 + i] * PLACE[i]
    return mix(total)


def fingerprint(text: bytes) -> np.ndarray:
    """16 bits of each permutation's minimum."""
    hashes = shingles(text)
    least = np.full(PERMUTATIONS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, (TIMES * hashes[at:at + CHUNK] + PLUS).min(axis=1), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype("<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated Jaccard similarity, less what 16 bits share by chance."""
    chance = 2.0**-16
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


PRINTED = "kind int, part int, id long, packed binary, print binary, n_chars long, edited_sha256 binary, fp array<long>, edited_fp array<long>, near_edited double, near_next double"
PRINTED_ARROW = pa.schema([
    ("kind", pa.int32()), ("part", pa.int32()), ("id", pa.int64()), ("packed", pa.binary()), ("print", pa.binary()), ("n_chars", pa.int64()),
    ("edited_sha256", pa.binary()), ("fp", pa.list_(pa.int64())), ("edited_fp", pa.list_(pa.int64())), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
# One row per document; the first and the last document of a partition leave their texts for its neighbours.
DOCUMENT, FIRST, LAST = 0, 1, 2


class _Text:
    """A document on its way through a partition."""

    def __init__(self, name, packed: bytes, unpack):
        self.name, self.packed = name, packed
        self.bytes = unpack(packed)
        self.text = self.bytes.decode()
        self.fp = fingerprint(self.bytes)

    def beside(self, following: "_Text") -> dict:
        """The document's row, given the document that follows."""
        half = len(self.text) // 2
        edited = (self.text[:len(self.text) - half] + following.text[:half]).encode()
        fp = fingerprint(edited)
        return {
            "kind": DOCUMENT, "id": self.name, "print": hashlib.sha256(self.bytes).digest(), "n_chars": len(self.text), "edited_sha256": hashlib.sha256(edited).digest(),
            "fp": self.fp.view("<i8"), "edited_fp": fp.view("<i8"), "near_edited": likeness(self.fp, fp), "near_next": likeness(self.fp, following.fp),
        }


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in PRINTED_ARROW], schema=PRINTED_ARROW)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) in; (id, a hash of the text, the compressed text) out."""
    import zstandard
    from xxhash import xxh64_intdigest

    squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
    for batch in batches:
        texts = batch.column(1).to_pylist()
        tie = pa.array([xxh64_intdigest(t) - (1 << 63) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), tie, pa.array(map(squeeze, texts), pa.binary())], ["id", "tie", "packed"])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition's (id, packed) in; rows of ``PRINTED`` out."""
    import zstandard

    unpack, part, now = zstandard.ZstdDecompressor().decompress, TaskContext.get().partitionId(), None
    for batch in batches:
        out = []
        for name, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            following = _Text(name, packed, unpack)
            out.append(now.beside(following) if now else {"kind": FIRST, "part": part, "packed": packed})
            now = following
        yield _batch(out)
    if now:
        yield _batch([{"kind": LAST, "part": part, "id": now.name, "packed": now.packed}])


def _at_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, packed, the packed text that follows) in; rows of ``PRINTED`` out."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        yield _batch([_Text(name, own, unpack).beside(_Text(None, other, unpack)) for name, own, other in zip(*(c.to_pylist() for c in batch.columns))])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, print, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next) per row, stored.

    Rows follow each other in falling order of their ids, null ids last, equal ids in the order of a
    hash of their texts; the first follows the last.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_bytes"))
    packed = picked.mapInArrow(_pack, "id long, tie long, packed binary").withColumn("nth", F.monotonically_increasing_id())
    order = [F.col("id").desc_nulls_last(), F.col("tie"), F.col("nth")]
    dealt = packed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "packed")
    rows = settled(dealt.mapInArrow(_in_order, PRINTED))
    first = rows.where(F.col("kind") == FIRST).select(F.col("part").alias("after"), F.col("packed").alias("following"))
    # one row per partition
    parts = first.select(F.col("after").alias("part"))
    follows = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0))))
    last = rows.where(F.col("kind") == LAST).select("part", "id", "packed")
    ends = last.join(parts.withColumn("after", follows), "part").join(first, "after").select("id", "packed", "following")
    ends = stored(ends.mapInArrow(_at_ends, PRINTED))
    return rows.where(F.col("kind") == DOCUMENT).unionByName(ends).drop("kind", "part", "packed")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(shingles(x)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "size", "hashes"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; sets without shingles are alike."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    both = len(a) + len(b) - common
    return common / both if both else 1.0


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, node, hashes) sorted by hub, its own row first; (hub, node, similarity) of the others out."""
    now, own = None, None
    for batch in batches:
        found = []
        for hub, node, hashes in zip(*batch.columns):
            hub, node, values = hub.as_py(), node.as_py(), np.frombuffer(hashes.as_py(), "<u8")
            if hub == node:
                now, own = hub, values
            elif hub == now:
                found.append((hub, node, jaccard(own, values)))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["hub", "node", "similarity"])


def _with_hubs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, node, similarity) for every node that shares a key with its hub; a hub of many is repeated over salts."""
    edges = stored(members.select("hub", "node").distinct())
    total = edges.count()
    heavy = stored(edges.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HEAVY >= F.lit(total)).select("hub", F.lit(True).alias("_heavy")))
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    salts = F.when(F.col("_heavy").isNull(), F.array(F.lit(0))).when(F.col("hub") == F.col("node"), every)
    dealt = edges.join(F.broadcast(heavy), "hub", "left").withColumn("salt", F.explode(salts.otherwise(F.array(F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")))))
    dealt = dealt.join(sets.select("node", "hashes"), "node").repartition("hub", "salt")
    dealt = dealt.sortWithinPartitions("hub", "salt", F.col("hub") != F.col("node"), "node").select("hub", "node", "hashes")
    return settled(dealt.mapInArrow(_met, "hub long, node long, similarity double"))


def block_links(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Links between similar sets with different labels; sets that are linked already are not linked again."""
    root = {int(x): int(x) for x in labels}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    sizes = np.array([len(s) for s in sets])
    owners = np.repeat(np.arange(len(sets)), sizes)
    every = np.concatenate(sets)
    by_hash = np.argsort(every, kind="stable")
    every, owners = every[by_hash], owners[by_hash]
    links = []
    for i, own in enumerate(sets):
        start, end = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
        counts = end - start
        places = np.arange(counts.sum()) + np.repeat(start - np.cumsum(counts) + counts, counts)
        common = np.bincount(owners[places], minlength=len(sets))
        alike = common + SLACK >= similar * (sizes + sizes[i] - common)
        for j in np.flatnonzero(alike[:i]):
            a, b = find(int(labels[i])), find(int(labels[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((int(nodes[i]), int(nodes[j])))
    return links


def similar_texts(nodes: DataFrame, sets_of, similar: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """(node, label) for the nodes of stored ``nodes`` (node, fp) that are similar to another, directly or through others.

    ``sets_of`` gives (node, size, hashes) of the nodes it is handed, one row each.
    """
    filed = nodes.select("node", F.posexplode("fp").alias("_band", "_key")).select(F.xxhash64("_band", "_key").alias("key"), "node")
    total = nodes.count() * BANDS
    shared = settled(filed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where("n > 1"))
    members = settled(meet(filed, shared, "key", "n", total))
    # keys with the same texts say the same
    seen = members.groupBy("key").agg(F.bit_xor(F.xxhash64("node")).alias("_x"), F.sum(F.hash("node")).alias("_y"), F.first("n").alias("n"), F.first("hub").alias("hub"))
    once = settled(seen.groupBy("hub", "n", "_x", "_y").agg(F.min("key").alias("key")).select("key", "n"))
    members = settled(meet(members.drop("n"), once, "key", "n", total))
    sets = settled(sets_of(settled(members.select("node").distinct())))

    met = _with_hubs(members, sets)
    links = stored(met.where(F.col("similarity") + SLACK >= similar).select(F.col("hub").alias("a"), F.col("node").alias("b")))
    labels = components(links)

    # a hub has met everyone; what is beyond the bound is open, and within twice the bound it may reach those within it
    beyond = members.where("node <> hub and n > 2").join(met, ["hub", "node"])
    beyond = beyond.withColumn("open", F.col("similarity") + SLACK < similar).withColumn("reaches", F.col("open") & (F.col("similarity") + SLACK >= 2 * similar - 1))
    beyond = beyond.join(sets.select("node", "size"), "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    beyond = settled(beyond.select("key", "n", "node", "size", "label", "open", "reaches"))
    asks = beyond.groupBy("key").agg(F.bool_or("reaches").alias("all"), F.bool_or("open").alias("any"), F.first("n").alias("n"))
    left = settled(meet(beyond.drop("n"), settled(asks.where("any").drop("any")), "key", "n", total).where("open or all"))
    blocks = left.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.sum("size").alias("_total"), F.first("n").alias("n"))
    blocks = settled(blocks.where("_low <> _high").select("key", "n", F.ceil(F.greatest(F.col("_total"), F.lit(1)) / block).cast("int").alias("blocks")))
    dealt = meet(left.select("key", "node", "label"), blocks, "key", "n", total).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("_own", "_with").alias("low"), F.greatest("_own", "_with").alias("high"), "node", "label").join(sets.select("node", "hashes"), "node")

    def links_of(group: pa.Table) -> pa.Table:
        found = block_links(group.column("node").to_numpy(), group.column("label").to_numpy(), [np.frombuffer(x.as_py(), "<u8") for x in group.column("hashes")], similar)
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["a", "b"])

    more = dealt.groupBy("key", "low", "high").applyInArrow(links_of, "a long, b long")
    return components(settled(links.unionByName(more)))


def documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next, class_id, class_rows.

    ``class_id`` is the smallest id among all rows whose texts are similar, directly or through
    others; null only if all ids of the class are. Null counts as empty; texts without words are like
    each other and like nothing else; one row is its own next; repeated rows stay repeated and share a
    class; other columns are ignored; an empty table gives an empty result.
    """
    rows = fingerprints(docs, id_col, text)
    by_text = rows.groupBy("print").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("_rows"), F.any_value("fp").alias("fp"))
    nodes = settled(by_text.withColumn("node", F.monotonically_increasing_id()))

    def sets_of(wanted: DataFrame) -> DataFrame:
        some = F.lit(-(1 << 63))
        picked = stored(nodes.join(wanted, "node", "left_semi").select("print", F.coalesce("least", some).alias("least"), "node"))
        texts = docs.select(F.coalesce(F.col(id_col).cast("long"), some).alias("least"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_bytes"))
        texts = attach(texts.withColumn("print", F.unhex(F.sha2("_bytes", 256))), picked, ["print", "least"], "inner")
        return texts.select("node", "_bytes").mapInArrow(_sets, "node long, size long, hashes binary").dropDuplicates(["node"])

    labels = similar_texts(nodes.select("node", "fp"), sets_of, similar, block)
    known = stored(nodes.drop("fp").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).where("_rows > 1 or label <> node or least is null").select("print", "least", "_rows", "label", "node"))
    heads = nodes.join(known.select("label").distinct(), F.col("node") == F.col("label"), "left_semi").select("print", "least", "_rows", F.col("node").alias("label"), "node")
    in_class = stored(known.unionByName(heads).dropDuplicates(["node"]))
    classes = in_class.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("_rows").alias("class_rows"))
    of_print = stored(in_class.join(classes, "label").select("print", "class_id", "class_rows", F.lit(True).alias("_known")))
    found = attach(rows, of_print, ["print"])
    return found.withColumn("class_id", F.when(F.col("_known"), F.col("class_id")).otherwise(F.col("id"))).withColumn("class_rows", F.coalesce("class_rows", F.lit(1))).drop("print", "_known")


def written(fp: str):
    """A fingerprint as hexadecimal digits."""
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")
