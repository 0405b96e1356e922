"""Approximate nearest neighbours by collision counting over query-aware hashes.

Vectors are dealt into blocks. In a block, every random projection is one sorted array. A query
opens a window around its own projection on each array; a vector inside the windows of enough
projections is verified by its exact distance. Windows widen step by step (virtual rehashing: the
arrays stay as they are) until the nearest found are within a window's half width, at which
a true neighbour collides with a probability that the threshold is set below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listinglake.llm.common import stored

# Vectors in one block, projections, share of projections that must collide, widening per step.
BLOCK = 8192
PROJECTIONS = 64
THRESHOLD = 0.6
WIDEN = 1.25
SEED = 17


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not zero, every component finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Index:
    """Sorted projections of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.axes = np.random.default_rng(SEED).standard_normal((vectors.shape[1], PROJECTIONS))
        projected = (self.vectors.astype(np.float64) @ self.axes).T
        self.order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, self.order, axis=1)
        # first half width: a share of how far apart vectors are
        self.first = max(float(projected.std(axis=1).mean()) / 4, 1e-12)

    def nearest(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``k`` nearest found, nearest first, ties by id."""
        query = query.astype(np.float64)
        centre = query @ self.axes
        n = len(self.ids)
        distance = np.full(n, np.inf)
        seen = self.ids == query_id
        half, needed = self.first, int(np.ceil(THRESHOLD * PROJECTIONS))
        collisions = np.zeros(n, dtype=np.int64)
        left = right = np.array([np.searchsorted(s, c) for s, c in zip(self.sorted, centre)])
        while True:
            wider = np.array([np.searchsorted(s, (c - half, np.nextafter(c + half, np.inf))) for s, c in zip(self.sorted, centre)])
            # only what the windows gained is counted
            gained = [o[a:b] for o, a, b in zip(self.order, wider[:, 0], left)] + [o[a:b] for o, a, b in zip(self.order, right, wider[:, 1])]
            left, right = wider[:, 0], wider[:, 1]
            collisions += np.bincount(np.concatenate(gained), minlength=n)
            new = np.flatnonzero((collisions >= needed) & ~seen)
            if len(new):
                distance[new] = np.sqrt(((self.vectors[new].astype(np.float64) - query) ** 2).sum(axis=1))
                seen[new] = True
            if seen.all():
                break
            if n > k and np.partition(distance, k - 1)[k - 1] <= half:
                break
            half *= WIDEN
        best = np.argsort(distance, kind="stable")[:k]  # ids ascend, so ties keep the smaller
        best = best[np.isfinite(distance[best])]
        return self.ids[best], distance[best]


def _search(k: int, dim: int):
    """Per block: its vectors first, then queries, which pass by in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vectors, index = None, [], [], None
        for batch in batches:
            blocks, asked, id_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            values = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            found = ([], [], [])
            for b in np.unique(blocks):
                mine = blocks == b
                if b != block:
                    block, ids, vectors, index = b, [], [], None
                given = mine & (asked == 0)
                if given.any():
                    ids.append(id_[given])
                    vectors.append(values[given])
                for at in np.flatnonzero(mine & (asked == 1)):
                    if index is None and ids:
                        index = Index(np.concatenate(ids), np.concatenate(vectors))
                    if index is not None:
                        near, far = index.nearest(id_[at], values[at], k)
                        for into, x in zip(found, (np.full(len(near), id_[at]), near, far)):
                            into.append(x)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows where ``queries`` holds, the ``k`` nearest other rows.

    Rows with a null id or an unusable vector take no part, nor do vectors of another length than
    most have (the longer of equally frequent ones). Rows that share the query's id are its own;
    queries that share an id are one, with the smallest vector. Ties go to smaller ids. Other columns
    are ignored; an empty table gives an empty result.
    """
    used = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>").alias("v"), queries.alias("asks")
    )
    used = stored(used)
    lengths = used.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths[0]["dim"]
    used = used.where(F.size("v") == dim)
    blocks = -(-lengths[0]["n"] // block)
    given = used.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("long").alias("block"), F.lit(0).alias("asked"), "id", "v")
    asked = used.where("asks").groupBy("id").agg(F.min("v").alias("v")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("asked"), "id", "v")
    dealt = given.union(asked).repartition(blocks, "block").sortWithinPartitions("block", "asked")
    local = dealt.mapInArrow(_search(k, dim), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
