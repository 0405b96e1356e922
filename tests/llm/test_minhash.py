import hashlib
import random

import numpy as np
import pytest
from listinglake.llm.minhash import PERMUTATIONS, documents, fingerprint, jaccard, likeness, shingles, word_hashes

SHAPE = "doc_id long, text string, node long, label long, print string, key long, part int, hub long"


def slow_words(text):
    return (text or "").encode().lower().split()


def slow_set(text):
    words = slow_words(text)
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow(rows):
    """rows: (id, text), ids distinct: (n_chars, edited digest, class) by id, everything compared with everything."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out, sets = {}, [(d, slow_set(t)) for d, t in rows]
    for i, (d, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        out[d] = [len(text), hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest()]
    label = {d: d for d, _ in rows}
    for d, a in sets:
        for e, b in sets:
            if label[d] != label[e] and len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((label[d], label[e]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {d: (*out[d], label[d]) for d in out}


def given(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "p", 3, 4, 5) for r in rows], SHAPE)


def got(spark, rows, **options):
    found = documents(given(spark, rows).repartition(3), **options).collect()
    return {r.id: (r.n_chars, r.edited_sha256.hex(), r.class_id) for r in found}


def edited(rng):
    """Groups around the bound: similarities from 0.5 to 1 to a base, less to each other; and chains of small steps."""
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for size in (40, 120, 300, 60):
        base = [word() for _ in range(size)]
        for k in range(25):
            text = base if size != 60 else list(rows[-1][1].split()) if k else base
            text = list(text)
            for _ in range(rng.randrange(0, max(2, size // 20)) if size != 60 else 1):
                text[rng.randrange(size)] = word()
            rows.append((len(rows) * 7 % 151, " ".join(text)))
    return rows + [(200, "a b c"), (201, "A  b c"), (202, None), (203, " "), (204, ""), (205, "ünï " * 40 + "\U0001F600"), (206, "x" * 3_000_000), (207, "y z " * 400_000)]


@pytest.mark.parametrize("block", [500, 4_000_000])
def test_equals_brute_force(spark, block):
    rows = edited(random.Random(5))
    assert got(spark, rows, block=block) == slow(rows)


def test_documents_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(spark, rows) == slow(rows)


def test_repeated_rows_null_ids_empty_table(spark):
    text = "one two three four five six seven"
    found = documents(given(spark, [(1, text), (1, text), (None, text), (7, "other"), (None, "alone")])).collect()
    assert {(r.id, r.class_id, r.class_rows) for r in found} == {(1, 1, 3), (None, 1, 3), (7, 7, 1), (None, None, 1)}
    assert len({tuple(r.fp) for r in found if r.n_chars == len(text)}) == 1
    assert documents(given(spark, [(1, "a")]).limit(0)).collect() == []
    (single,) = documents(given(spark, [(1, "abcd")])).collect()
    assert single.edited_sha256 == hashlib.sha256(b"abab").digest() and single.near_next == 1.0


def test_likeness_estimates_similarity():
    rng = random.Random(2)
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
        other = [w if i < share * 2000 else f"v{i}" for i, w in enumerate(words)]
        a, b = (" ".join(x).encode() for x in (words, other))
        exact = jaccard(*(np.unique(shingles(x)) for x in (a, b)))
        assert abs(likeness(fingerprint(a), fingerprint(b)) - exact) < 4 * (0.25 / PERMUTATIONS) ** 0.5
    assert likeness(fingerprint(b""), fingerprint(b" \n")) == 1.0
    assert likeness(fingerprint(b""), fingerprint(b"a")) == 0.0


def test_hashes_tell_words_apart_and_slices_do_not_matter(spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    words = sorted({w for t in texts for w in slow_words(t)})
    assert len(set(word_hashes(b" ".join(words)).tolist())) == len(words)
    long = (" \n".join(texts) + " ").encode() * 6  # several slices
    known = {w: int(word_hashes(w)[0]) for w in words}
    assert word_hashes(long).tolist() == [known[w] for w in long.lower().split()]
    assert word_hashes(b"A\tb" + b"x" * 3_000_000)[0] == word_hashes(b" a ")[0]
