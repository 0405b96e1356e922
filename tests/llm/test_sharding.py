import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from listinglake.llm.common import with_row
from listinglake.llm.sharding import _name_cells, _name_edges, hilbert, shards, write


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 3), (3, 5)])
def test_curve_visits_neighbours(dims, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    index = hilbert(cells, bits)
    assert sorted(index) == list(range(side**dims))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("n", [1, 24, 100])
def test_rows_are_dealt_evenly(spark, n):
    data = [(i if i % 9 else None, None if i % 11 == 0 else "é" * (i % 50), "en" if i % 3 else None, f"src{i % 5}") for i in range(77)] + [(1, "same", "en", "s")] * 3
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(4)
    got = shards(docs, n).collect()
    counts = Counter(r.shard for r in got)
    each = [counts.get(s, 0) for s in range(n)]
    assert max(each) - min(each) <= 1 and sum(each) == len(data)
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    want = sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _, _ in data)
    assert sorted((str(r.id), r["size"], r.text_crc32) for r in got) == want
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.cell for r in order] == sorted(r.cell for r in got)
    assert shards(docs.limit(0), n).count() == 0


def test_names_in_order_let_files_be_skipped(spark):
    """Shards that minima and maxima can't rule out, against cells of names without order."""
    docs = with_row(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    mixed = docs.select("_row", "doc_id", "text", F.md5("lang").alias("lang"), F.md5("source").alias("source"))
    facts = docs.select("_row", "lang", "source", F.octet_length("text").alias("bytes")).toPandas().set_index("_row")

    def kept(table):
        placed = shards(table, 24, keep=("_row",)).select("_row", "shard").toPandas().set_index("_row").join(facts)
        spans = placed.groupby("shard").agg(["min", "max"])
        asked = {"lang": facts.lang.unique(), "source": facts.source.unique(), "bytes": [100, 1000, 10_000]}
        return {c: sum(((spans[c]["min"] <= v) & (v <= spans[c]["max"])).sum() for v in values) / len(values) for c, values in asked.items()}

    ordered, by_hash = kept(docs), kept(mixed)
    print(ordered, by_hash)
    assert ordered["source"] < 0.8 * by_hash["source"] and ordered["lang"] <= by_hash["lang"] and ordered["bytes"] < 16


def test_names_share_cells_with_their_neighbours(spark):
    edges = _name_edges(spark.range(10_000).select(F.format_string("n%05d", "id").alias("x")).repartition(5), "x", 31)
    assert len(edges) == 31 and edges == sorted(edges) and edges[0] == "n00000"
    assert max(int(b[1:]) - int(a[1:]) for a, b in zip(edges, edges[1:])) < 400
    got = _name_cells(pd.Series([None, "a", "n00000", "n09999", "zz"], dtype=object), edges, 32)
    assert list(got) == [0, 1, 1, 31, 31]
    hot = _name_edges(spark.range(900).select(F.when(F.col("id") < 600, "m").otherwise(F.col("id").cast("string")).alias("x")), "x", 7)
    assert "m" in hot
    assert _name_edges(spark.range(3).select(F.lit(None).cast("string").alias("x")), "x", 7) == []


def test_files(spark, tmp_path):
    docs = with_row(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    write(docs, shards(docs, 24, keep=("_row",)), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("shard", "slot", "cell").exceptAll(docs.drop("_row").select(*[c for c in back.columns if c not in ("shard", "slot", "cell")])).count() == 0
    assert back.count() == docs.count()


def test_write_keeps_columns_with_its_names(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, Shard int, slot long, cell long, slot_given int"
    docs = with_row(spark.createDataFrame([(i, "x" * i, "en", "s", i + 100, i + 200, i + 300, i) for i in range(30)], shape))
    write(docs, shards(docs, 3, keep=("_row",)), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.Shard_given, r.slot_given_, r.cell_given, r.slot_given) for r in got.collect()} == {(i, i + 100, i + 200, i + 300, i) for i in range(30)}
    assert {r["count"] for r in got.groupBy("shard").count().collect()} == {10}
