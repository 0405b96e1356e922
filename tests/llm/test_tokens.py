import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from listinglake.llm import bpe
from listinglake.llm.packing import Limits, pack, plan
from listinglake.llm.token_counts import answers, token_counts
from listinglake.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
JSON = P.path("byte_bpe_50k.json")
RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\n  x", "don't we'll I'M", "½ ²3 ªº", "a\x1cb\x85c  d", "日本語 текст 🎸🎸", "<|endoftext|>", "naïve—test… 12345", "x" * 3000, " wide 　space "]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ODD


def test_encoder_equals_library(texts, library):
    encoder = Encoder(JSON, P.PATTERN)
    assert [np.frombuffer(encoder.ids(t or ""), "<u4").tolist() for t in texts] == library(texts)


def documents(spark, texts):
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)] + [(3, "again", "x")] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3), rows


def test_histogram(spark, texts, library):
    docs, rows = documents(spark, texts)
    lengths = sorted(len(x) for x in library([t for _, t, _ in rows]))
    got = {r.length: r for r in token_counts(docs, JSON, P.PATTERN).collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert r.docs == lengths.count(n) and r.docs_longer == sum(x > n for x in lengths)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths) and r.cut_tokens == sum(max(x - n, 0) for x in lengths)
        assert r.tokens_within == sum(x for x in lengths if x <= n) and abs(r.quantile - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    assert token_counts(docs.limit(0), JSON, P.PATTERN).count() == 0
    by = token_counts(docs.selectExpr("text", "nullif(doc_id % 2, 1) as g"), JSON, P.PATTERN, by=("g",)).groupBy("g").sum("docs").collect()
    assert sum(r[1] for r in by) == len(rows)


def test_blocks_of_lengths(spark):
    h = spark.createDataFrame([(n, n % 5 + 1) for n in range(1, 300)], "length long, docs long")
    one, many = (sorted(answers(h, block=b).collect()) for b in (4096, 16))
    assert one == many


def test_packing(spark, texts, library):
    docs, rows = documents(spark, texts)
    got = pack(docs, JSON, P.PATTERN, limits=Limits(tokens=64)).collect()
    ids = {i: x + [2] for i, x in enumerate(library([t for _, t, _ in rows]))}
    want = []
    for x in ids.values():
        first, start = len(x) % 64 or 64, 0
        for k in range(-(-len(x) // 64)):
            n = first if k == 0 else 64
            want.append((k, start, n, zlib.crc32(np.array(x[start:start + n], "<u4").tobytes())))
            start += n
    assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= 1.02 * sum(r.length for r in got) / 64 + 1
    assert pack(docs.limit(0), JSON, P.PATTERN).count() == 0


@pytest.mark.parametrize("score", ["residual", "dot"])
@pytest.mark.parametrize("documents,cost", [(None, None), (3, None), (None, 2000)])
def test_plan_keeps_every_limit(score, documents, cost):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 41, 400)
    counts = {int(n): int((lengths == n).sum()) for n in set(lengths)}
    limits = Limits(64, documents, cost, score=score)
    bins = {}
    seen = {n: [] for n in counts}
    for length, first, n, start, offset in plan(counts, limits):
        for i in range(n):
            seen[length].append(first + i)
            bins.setdefault(start + i, []).append((offset, length))
    assert {n: sorted(x) for n, x in seen.items()} == {n: list(range(c)) for n, c in counts.items()}
    full = limits.vector()
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= full[0] and len(spans) <= full[1] and sum(n * n for _, n in spans) <= full[2]


def test_bpe_round_trip(spark, texts, library):
    docs, rows = documents(spark, texts)
    got = bpe.encode(docs, RANKS, P.PATTERN, with_ids=True).collect()
    want = sorted((list(x), str(d)) for x, (d, _, _) in zip(library([t for _, t, _ in rows]), rows))
    assert sorted((list(r.ids), str(r.doc_id)) for r in got) == want
    import hashlib

    decoded = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in rows)
    assert sorted(r.decoded_sha256 for r in got) == decoded
    assert bpe.encode(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_fold_alone_equals_library(spark, library):
    words = ["a", " the", "thtionble", " réeuxment", "é", "日本語", " 🎸", "''''", "aaaaaaaaaaaaa", "\n\n\n", " enenenlichkeit"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: list(r.ids) for r in bpe.encode_words(df, bpe.read_ranks(RANKS)).collect()}
    assert got == dict(zip(words, library(words)))
