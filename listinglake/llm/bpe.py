"""Byte-level BPE as a fold of ranked merges in Spark's higher-order functions.

A word starts as its bytes; each step of the fold joins the adjacent pieces whose concatenation has
the lowest rank in a literal rank map. The fold runs over distinct words: the most frequent ones of
the corpus are folded once and remembered by every task. Interpreted lambdas take about half a
millisecond a word, which the long tail of rare words (most distinct words, a few hundredths of all
occurrences) cannot afford at corpus scale, so words outside the dictionary are merged in the
Arrow task that meets them, by the same ranks. The result doesn't depend on which words those are.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglake.functions.once import once
from listinglake.llm.common import stored
from listinglake.llm.tokens import REMEMBERED, splitter

# Words in the dictionary, which is what every task holds.
DICTIONARY = 49_152
# Distinct words that one task counts before it forgets those it has seen once.
COUNTED = 400_000
BUCKETS = 16_384
NO_RANK = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as one literal: small maps from a token's hex form, found by the token's CRC-32."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        buckets[zlib.crc32(token) % BUCKETS][token.hex().upper()] = rank
    # a constant, which the optimizer evaluates once
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<map<string,int>>")


def rank_of(literal: Column, piece: Column) -> Column:
    bucket = F.element_at(literal, F.pmod(F.crc32(piece), F.lit(BUCKETS)).cast("int") + 1)
    return F.coalesce(F.try_element_at(bucket, F.hex(piece)), F.lit(NO_RANK))


def merge_pieces(word: Column, literal: Column) -> Column:
    """The pieces of ``word`` (binary, not empty) when no adjacent pair has a rank any more.

    The state holds the pieces and the ranks of their adjacent pairs; a merge changes one piece and
    at most two ranks.
    """
    n = F.octet_length(word)
    no_ranks = F.array().cast("array<int>")

    def pair_ranks(p: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank_of(literal, F.concat(F.element_at(p, i), F.element_at(p, i + 1))))
        return F.struct(p.alias("p"), F.when(n > 1, pairs).otherwise(no_ranks).alias("r"))

    def step(state: Column, _: Column) -> Column:
        p, r = state.p, state.r

        def merged(i: Column) -> Column:
            def rebuilt(joined: Column) -> Column:
                before = F.when(i > 1, F.array(rank_of(literal, F.concat(F.element_at(p, F.greatest(i - 1, F.lit(1))), joined))))
                after = F.when(i < F.size(r), F.array(rank_of(literal, F.concat(joined, F.element_at(p, F.least(i + 2, F.size(p)))))))
                return F.struct(
                    F.concat(F.slice(p, F.lit(1), i - 1), F.array(joined), F.slice(p, i + 2, F.size(p))).alias("p"),
                    F.concat(
                        F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), F.coalesce(before, no_ranks), F.coalesce(after, no_ranks), F.slice(r, i + 2, F.size(p))
                    ).alias("r"),
                )

            return once(F.concat(F.element_at(p, i), F.element_at(p, i + 1)), rebuilt)

        lowest = F.coalesce(F.array_min(r), F.lit(NO_RANK))
        return F.when(lowest >= NO_RANK, state).otherwise(once(F.array_position(r, lowest).cast("int"), merged))

    start = once(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1))), pair_ranks)
    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda state: state.p)


def encode_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word") -> DataFrame:
    """``words`` with ``ids``, by the fold; a whole word that is a token keeps its rank, as any word must."""

    def fold(literal: Column) -> Column:
        return F.transform(merge_pieces(F.col(word).cast("binary"), literal), lambda p: rank_of(literal, p))

    # named once, so that the plan holds the map once
    return words.withColumn("ids", once(rank_map(ranks), fold))


def word_counts(docs: DataFrame, pattern: str, text: str) -> DataFrame:
    """(word, n) of words a task has met more than once; the order of frequent words is what counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = splitter(pattern), Counter()
        for batch in batches:
            for value in batch.column(0):
                counts.update(split(value.as_py()))
                if len(counts) > COUNTED:
                    counts = Counter({w: n for w, n in counts.items() if n > 1})
                    if len(counts) > COUNTED // 2:
                        counts = Counter(dict(counts.most_common(COUNTED // 2)))
        found = [(w, n) for w, n in counts.most_common(2 * DICTIONARY) if n > 1]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], ["word", "n"])

    return docs.select(F.coalesce(F.col(text), F.lit(""))).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", size: int = DICTIONARY) -> dict[str, bytes]:
    """Ids of the ``size`` most frequent words, as little-endian 32-bit integers; bounded by ``size``."""
    frequent = word_counts(docs, pattern, text).orderBy(F.desc("n"), "word").limit(size)
    spark = docs.sparkSession
    frequent = stored(frequent.select("word"))
    parts = spark.sparkContext.defaultParallelism * 4
    # plan descriptions would spell the map out, once for every change of the plan
    setting = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "20000")
    try:
        folded = encode_words(frequent.repartition(parts, "word"), ranks).collect()
    finally:
        spark.conf.set(setting, before)
    return {r.word: np.asarray(r.ids, dtype="<u4").tobytes() for r in folded}


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", id_col: str = "doc_id", with_ids: bool = False,
    size: int = DICTIONARY,
) -> DataFrame:
    """A row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256 (, ids).

    Decoding joins the binary pieces of the ids again. Null and empty texts have no ids; null ids and
    repeated rows are kept, other columns ignored; an empty table gives an empty result.
    """
    ranks = read_ranks(ranks_path)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(dictionary(docs, ranks, pattern, text, size))
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = read_ranks(ranks_path)
        merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        pieces = {rank: token for token, rank in ranks.items()}
        split, common, rare = splitter(pattern), shared.value, {}

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(rare) > REMEMBERED:
                    rare.clear()
                ids = rare.get(word)
                if ids is None:
                    ids = rare[word] = np.asarray(merge(word), dtype="<u4").tobytes()
                return ids

        words = Words(common)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                packed = b"".join(map(words.__getitem__, split(value.as_py())))
                ids = np.frombuffer(packed, dtype="<u4").tolist()
                decoded = b"".join(map(pieces.__getitem__, ids))
                rows.append([len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()] + [ids] * with_ids)
            columns = list(zip(*rows)) or [[]] * (3 + with_ids)
            kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds))], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return picked.mapInArrow(run, schema)
