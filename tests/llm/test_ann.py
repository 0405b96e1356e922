import math

import numpy as np
from pyspark.sql import functions as F

from listinglake.llm.ann import nearest

SF = "/root/testdata/sf0.1"


def brute(rows, asks, k=10):
    used = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q in sorted({i for i, _ in used if asks(i)}):
        mine = min(v for i, v in used if i == q)
        ranked = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, mine))), i) for i, v in used if i != q)[:k]
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(ranked)]
    return out


def test_recall_and_scores(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {(r.query_id, r.vec_id): r.score for r in nearest(vectors, F.col("vec_id") % 100 == 0, block=700).collect()}
    rows = vectors.collect()
    ids, values = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    hits = total = 0
    for at in np.flatnonzero(ids % 100 == 0):
        distance = np.sqrt(((values - values[at]) ** 2).sum(axis=1))
        distance[at] = np.inf
        for j in np.lexsort((ids, distance))[:10]:
            hits += (ids[at], ids[j]) in got
            total += 1
        for j in np.flatnonzero(np.isfinite(distance)):
            if (ids[at], ids[j]) in got:
                assert abs(got[ids[at], ids[j]] - distance[j]) < 1e-9
    assert len(got) == total and hits / total >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [2.0, 2.0]), (8, [2.0, 2.0]), (100, [0.5, 0.5]), (100, [0.5, 0.5]), (9, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, score string")
    got = [tuple(r) for r in nearest(vectors, F.col("vec_id") % 100 == 0).collect()]
    want = brute([r for r in rows if r[0] != 9], lambda i: i % 100 == 0)
    assert sorted((q, r, i, round(d, 12)) for q, r, i, d in got) == sorted((q, r, i, round(d, 12)) for q, r, i, d in want)
    assert nearest(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0
