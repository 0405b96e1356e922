import random

import corpus_pipeline
import pytest
from listinglake.llm.common import with_row
from listinglake.llm.near_copies import near_copies

SF = "/root/testdata/sf0.01"


def slow_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def slow_first(rows):
    """rows: (id, text); ids without a similar text before them, by comparing everything."""
    sets = sorted(((d is None, d, slow_shingles(t)) for d, t in rows), key=lambda x: x[:2])
    kept = []
    for i, (_, d, a) in enumerate(sets):
        sizes = ((len(a & b), len(a | b)) for _, _, b in sets[:i] if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)))
        if not any(common >= 0.8 * both for common, both in sizes):
            kept.append(d)
    return kept


def test_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.unlike(spark, docs, SF).collect()
    want = slow_first([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in got) == want


@pytest.mark.parametrize("block", [3, 4096])
def test_edited_copies_around_the_bound(spark, block):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for _ in range(6):
        base = [word() for _ in range(rng.choice([40, 120, 300]))]
        for _ in range(25):  # similarities from 0.5 to 1 to the base, and less to each other
            text = list(base)
            for _ in range(rng.randrange(0, len(base) // 20)):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows) * 7 % 151, " ".join(text)))
    rows += [(200, "a b c"), (201, "A  b c"), (202, None), (203, " "), (204, "")]
    docs = with_row(spark.createDataFrame(rows, "doc_id long, text string"))
    gone = near_copies(docs, block=block).withColumnRenamed("row", "_row")
    got = docs.join(gone, "_row", "left_anti").collect()
    assert sorted(r.doc_id for r in got) == slow_first(rows)
