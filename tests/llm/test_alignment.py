import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from listinglake.llm import alignment as module
from listinglake.llm.alignment import Aligner, PieceEncoder, alignment
from listinglake.llm.tokens import byte_of_char
from tokenizers import Tokenizer

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", "a ", " a", "  a  b ", "\n", "x▁y", "▁", "<|endoftext|> and </s><s>", "<0x41>", "\x00a\x7f", "naïve Ünï 日本語 \U0001F600\U0001F468‍\U0001F469",
    "the the the", "the the the", "word" * 500, "a  " * 300, "\t\r\n x", "...!!!", "1234567890 12,5", "ﬁ ½  x",
]


def slow(texts):
    """Every token's bytes and ends written out, and counts over all links."""
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    of, names = byte_of_char(), {i: t for t, i in a.get_vocab().items()}
    rows, counts = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids = [a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")]
        pieces = [
            [bytes(of[c] for c in names[i]) for i in ids[0]],
            [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]],
        ]
        if not text or any(b"".join(p) != whole for p in pieces):
            rows.append((0, 0, [], ""))
            continue
        ends = [[sum(map(len, p[:i + 1])) for i in range(len(p))] for p in pieces]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links, groups, was = [], [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, e in zip(side, end) if was < e <= cut) for side, end in zip(ids, ends)))
            links += [(i, j) for i, e in zip(ids[0], ends[0]) if e == cut for j, f in zip(ids[1], ends[1]) if f == cut]
            was = cut
        counts.update(links)
        rows.append((len(ids[0]), len(ids[1]), links, hashlib.sha256(";".join(groups).encode()).hexdigest(), len(groups)))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [
        (r[0], r[1], r[4] if len(r) > 4 else 0, len(r[2]), sum(counts[k] == most[k[1]] for k in r[2]), sum(counts[k] for k in r[2]), r[3]) for r in rows
    ], counts


def check(spark, texts):
    rows = [(i, t, "x", 1, 2, 3, 4) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, block long, pair long, links long, n long").repartition(3)
    found, ids = alignment(docs, *FILES)
    want, counts = slow(texts)
    got = {r.id: tuple(r)[1:] for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert {(r.a, r.b): r["count"] for r in ids.collect()} == counts


def test_odd_texts_equal_brute_force(spark):
    check(spark, ODD * 2)


def test_documents_equal_brute_force(spark, sf):
    check(spark, [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 2000])


def test_empty_table_null_and_repeated_ids(spark):
    shape = "doc_id long, text string"
    assert alignment(spark.createDataFrame([], shape), *FILES)[0].collect() == []
    got = alignment(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], shape), *FILES)[0].collect()
    assert sorted((r.id is None, r.n_a, r.count_sum) for r in got) == [(False, 2, 6), (False, 2, 6), (True, 2, 6)]


def test_words_encode_as_whole_texts(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + [t or "" for t in ODD]
    encoder = PieceEncoder(FILES[2])
    for text in texts:
        ids = memoryview(encoder.ids(text)).cast("I").tolist()
        assert ids == model.encode(text) or (text == "" and ids == [model.piece_to_id("▁")])


@pytest.mark.parametrize("size", [1, 1 << 30])
def test_chunks_do_not_matter(monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(module, "CHUNK_BYTES", size)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ODD))), pa.array([t or "" for t in ODD])], ["id", "text"])
    aligner = Aligner(*FILES)
    rows = [x for _, texts in module._chunks([batch]) for x in zip(*aligner.align(texts)[:4])]
    assert [(int(a), int(b), int(g), d) for a, b, g, d in rows] == [(r[0], r[1], r[2], r[6]) for r in slow(ODD)[0]]
