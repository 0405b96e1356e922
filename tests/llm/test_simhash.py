import re

import numpy as np
import pytest
import xxhash

from listinglake.llm import simhash
from listinglake.llm.simhash import fingerprint, near_duplicates, near_links

SF = "/root/testdata/sf0.01"


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """rows: (id, fingerprint); the smallest id reachable, by comparing everything."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    values = np.array(prints, dtype=np.uint64)
    for i, f in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(values ^ np.uint64(f)) <= 3):
            root[find(prints[j])] = find(f)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f, least.get(find(f))) for d, f in rows), key=str)


def as_rows(df):
    return sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in df.collect()), key=str)


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    assert as_rows(near_duplicates(docs)) == slow_components(rows)


def test_odd_rows(spark):
    data = [(1, None, "x"), (2, "", None), (3, " \t\n", "y"), (4, "One", "z"), (4, "one", "z"), (5, "a b", None), (None, "A B", "q"),
            (6, "word " * 30_000, "q"), (7, "É é É", "r"), (8, "\x1ca\x85b c", "r")]
    docs = spark.createDataFrame(data, "doc_id long, text string, fp string")
    rows = [(d, slow_fingerprint(t)) for d, t, _ in data]
    assert as_rows(near_duplicates(docs)) == slow_components(rows)
    assert near_duplicates(docs.limit(0)).count() == 0
    assert fingerprint(b"", 3) == 0


@pytest.mark.parametrize("block", [4, 20, 4096])
def test_crowded_signatures_lose_no_link(spark, block):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**64, 3, dtype=np.uint64)
    near = []
    for c in centre:
        for _ in range(60):
            f = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                f ^= 1 << int(b)
            near.append(f)
    low = [int(x) for x in rng.integers(0, 2**16, 150)]  # share their upper half
    prints = sorted(set(near + low))
    fps = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in prints], "fp long")
    links = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in near_links(fps, block=block).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in links:
        root[find(a)] = find(b)
    got = {}
    for f in prints:
        got.setdefault(find(f), set()).add(f)
    want = {}
    for i, (d, f, c) in enumerate(slow_components([(f, f) for f in prints])):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_only_few_bits_allowed(spark):
    with pytest.raises(ValueError):
        near_links(spark.createDataFrame([(1,)], "fp long"), most=4)
    assert simhash.MOST_BITS == 3
