import hashlib
from collections import defaultdict

import pytest

from listinglake.llm.common import stored
from listinglake.llm.exact_dedup import exact_duplicates, merged, prints

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(AZ)].append(d)
    return groups


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_equal_texts(spark, keep):
    data = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 200_000), (7, "X" * 200_000), (None, "ab"), (None, "solo"), (None, "solo")]
    docs = spark.createDataFrame([(d, t, "c") for d, t in data], "doc_id long, text string, print string")
    groups = brute(data)
    got = exact_duplicates(docs, keep=keep).collect()
    assert len(got) == len(data)
    kept = defaultdict(int)
    for r in got:
        key = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        ids = [d for d in groups[key] if d is not None]
        assert r.group_size == len(groups[key])
        assert r.keep_id == ((max if keep == "largest" else min)(ids) if ids else None)
        kept[key] += r.kept
        assert not r.kept or r.id == r.keep_id
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact_duplicates(docs.limit(0)).count() == 0


def test_many_nodes_agree_with_few(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', string(id % 700)) as text").repartition(7)
    rows = stored(prints(docs, "doc_id", "text", None))
    few, many = (sorted((bytes(r.print), r.keep_id, r.size) for r in merged(rows, 5000, True, n).collect()) for n in (200_000, 300))
    assert few == many and len(few) == 701
