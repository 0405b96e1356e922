"""How far the sources of a language diverge in their words, ranked by cells of equal counts.

Terms are counted inside Arrow tasks, so one row per task, group and term reaches the shuffle. What a
term's value depends on is its count in the group and in the language, so terms are grouped into
cells of these two counts: a cell is evaluated once, equal values are merged, cells are ranked by the
cumulative number of their terms, and only those that reach the top ranks are expanded into terms.

Pairs of sources meet the same way. Blocks of terms by blocks of sources are dealt over tasks; in a
block, terms with the same counts in both sources form a cell, and each cell is evaluated once. A
block's size is fixed, so more terms or more sources make more blocks, not larger ones.

All arithmetic is exact: 64-bit integers, and decimals where a product exceeds them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listinglake.llm.common import stored
from listinglake.skew import attach

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
# Terms that one task counts before it hands them on; bytes of a text that are split at once.
HELD = 300_000
SLICE = 1 << 20
# Terms and sources in one block of the comparison of pairs.
TERMS_EACH, SOURCES_EACH = 4096, 256

# Bytes of terms are A-Z, a-z and everything beyond ASCII; A-Z is lower-cased, all else parts terms.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, slice by slice, so that a very long text isn't split at once."""
    text, at = text.translate(FOLDED), 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            end = cut + 1 if cut >= 0 else (text.find(b" ", end) + 1 or len(text))
        yield text[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) in; (lang, source, term, n, docs) out, and one row without a term per group seen."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            words = [None, *n]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(words), pa.string()),
                    pa.array([source] * len(words), pa.string()),
                    pa.array(words, pa.binary()).cast(pa.string()),
                    pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *(docs[w] for w in n)], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            slices = iter(terms(text))
            first = next(slices, [])
            n.update(first)
            own = set(first)
            for more in slices:
                n.update(more)
                own.update(more)
            docs.update(own)
            held += len(n)
            if held > HELD:
                yield from out()
                groups.clear()
                held = 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) over all rows; each group also has a row without a term."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    picked = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("_bytes"))
    counted = picked.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, kept: str) -> str:
    """p of a count: 1 + floor(SCALE * (count + 2) / (total + 2 * kept terms)); null without kept terms."""
    scaled = f"cast({n} + 2 as decimal(20, 0)) * cast({SCALE} as decimal(10, 0))"
    return f"if({kept} = 0, null, 1 + ({scaled}) div cast(nullif({total} + 2 * {kept}, 0) as decimal(20, 0)))"


def _distance(p: str, q: str) -> str:
    return f"({p} - {q}) * ({p} - {q}) div ({p} + {q})"


def _cells(top: int, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Part ``term``: cells of (group count, lang count), ranked and expanded."""
    cells = attach(kept.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("m")), groups, ["lang", "source"], "inner")
    cells = cells.withColumn("p", F.expr(_share("n", "total", "v"))).withColumn("q", F.expr(_share("lang_n", "lang_total", "v")))
    cells = stored(cells.where("p > q").select("lang", "source", "n", "lang_n", "m", F.expr(_distance("p", "q")).alias("value")))

    # a value holds a term at least, so the first values of a group are enough
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    values = values.withColumn("_at", F.row_number().over(falling)).where(F.col("_at") <= top)
    before = F.coalesce(F.sum("m").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = stored(values.withColumn("before", before).where(F.col("before") < top).select("lang", "source", "value", "before"))
    reached = stored(attach(cells.drop("m"), chosen, ["lang", "source", "value"], "inner"))

    found = attach(kept, reached, ["lang", "source", "n", "lang_n"], "inner")
    order = Window.partitionBy("lang", "source", "value").orderBy("term")
    found = found.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= top)
    found = found.withColumn("rank", (F.col("before") + F.col("_at")).cast("int")).where(F.col("rank") <= top)
    return found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def cell_distances(p: np.ndarray, q: np.ndarray) -> int:
    """The summed distance of two columns of shares; equal pairs of shares are one cell."""
    own, a = np.unique(p, return_inverse=True)
    other, b = np.unique(q, return_inverse=True)
    key = a * len(other) + b
    if len(own) * len(other) <= 16 * len(p):
        m = np.bincount(key, minlength=len(own) * len(other))
        cells = np.flatnonzero(m)
        m = m[cells]
    else:
        cells, m = np.unique(key, return_counts=True)
    x, y = own[cells // len(other)], other[cells % len(other)]
    return int(((x - y) * (x - y) // (x + y) * m).sum())


PARTIAL = "lang string, a int, b int, value long, seen long"


def _compare(key: tuple, block: pa.Table, sources_each: int) -> pa.Table:
    """One block: rows (no, tid, p), those without a tid give a source's share of an absent term."""
    lang, _, low, high = (k.as_py() for k in key)
    no, tid = block.column("no").to_numpy(), block.column("tid").to_numpy(zero_copy_only=False)
    p, marks = block.column("p").to_numpy(zero_copy_only=False), block.column("tid").is_null().to_numpy()
    sources = np.sort(no[marks])
    of_term, row = np.unique(tid[~marks].astype(np.int64), return_inverse=True)
    out: list[tuple[int, int, int]] = []
    if len(of_term):
        absent = np.empty(len(sources), dtype=np.int64)
        absent[np.searchsorted(sources, no[marks])] = p[marks].astype(np.int64)
        shares = np.repeat(absent[:, None], len(of_term), axis=1)
        shares[np.searchsorted(sources, no[~marks]), row] = p[~marks].astype(np.int64)
    for i, a in enumerate(sources):
        if a // sources_each != low:
            continue
        for j in range(i + 1, len(sources)):
            if sources[j] // sources_each == high:
                out.append((a, sources[j], cell_distances(shares[i], shares[j]) if len(of_term) else 0))
    a, b, value = (pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int64())))
    return pa.table([pa.array([lang] * len(out), pa.string()), a, b, value, pa.array([len(of_term)] * len(out), pa.int64())], ["lang", "a", "b", "value", "seen"])


def _pairs(kept: DataFrame, groups: DataFrame, terms_each: int, sources_each: int) -> DataFrame:
    """Part ``pair``: every two sources of a language, blocks of terms by blocks of sources."""
    numbered = groups.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("v") / terms_each)).cast("int"))
    numbered = numbered.withColumn("absent", F.expr(_share("0", "total", "v")))
    shape = ["lang", "bucket", "no", "sources", "tid", "p"]
    there = attach(kept, numbered, ["lang", "source"], "inner")
    there = there.withColumn("p", F.expr(_share("n", "total", "v"))).withColumn("bucket", F.pmod(F.xxhash64("tid"), F.col("buckets")).cast("int"))
    marks = numbered.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    marks = marks.withColumn("tid", F.lit(None).cast("long")).withColumn("p", F.col("absent"))
    mine = F.floor(F.col("no") / sources_each).cast("int")
    last = F.floor((F.col("sources") - 1) / sources_each).cast("int")
    each = there.select(*shape).unionByName(marks.select(*shape)).withColumn("_with", F.explode(F.sequence(F.lit(0), last)))
    each = each.select("lang", "bucket", F.least(mine, "_with").alias("low"), F.greatest(mine, "_with").alias("high"), "no", "tid", "p")
    partial = each.groupBy("lang", "bucket", "low", "high").applyInArrow(lambda key, block: _compare(key, block, sources_each), PARTIAL)
    summed = stored(partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")))

    side = numbered.select("lang", "no", "source", "absent", "v")
    named = attach(summed, side.select("lang", F.col("no").alias("a"), F.col("source").alias("_a"), F.col("absent").alias("_p"), "v"), ["lang", "a"], "inner")
    named = attach(named, side.select("lang", F.col("no").alias("b"), F.col("source").alias("_b"), F.col("absent").alias("_q")), ["lang", "b"], "inner")
    # terms that a block pair never saw are absent from both sources
    rest = f"(v - seen) * ({_distance('_p', '_q')})"
    named = named.withColumn("value", F.expr(f"if(v = 0, 0L, value + {rest})"))
    both = F.explode(F.array(F.struct(F.col("_a").alias("source"), F.col("_b").alias("item")), F.struct(F.col("_b").alias("source"), F.col("_a").alias("item"))))
    both = named.select("lang", "value", both.alias("_s")).select("lang", "_s.source", "_s.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).cast("int").alias("rank"))


def divergence(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, terms_each: int = TERMS_EACH, sources_each: int = SOURCES_EACH
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group of ``docs``.

    Part ``pair`` ranks the other sources of the language by their distance from the group, part
    ``term`` the ``top`` terms that the group uses more than its language does. Terms count if at
    least ``least_docs`` documents of the language hold them. Null languages, sources and texts are
    empty ones; a group without kept terms still has its pairs, of value 0 where the language keeps
    none; ties go by the item's bytes; repeated rows count each time; other columns are ignored; an
    empty table gives an empty result.
    """
    counts = stored(term_counts(docs))
    of_lang = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("_docs"))
    of_lang = stored(of_lang.where(F.col("_docs") >= least_docs).select("lang", "term", "lang_n", F.monotonically_increasing_id().alias("tid")))
    kept = stored(counts.where("term is not null").join(of_lang, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "tid"))

    langs = stored(of_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total")))
    totals = stored(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")))
    seen = counts.where("term is null").select("lang", "source")
    groups = attach(attach(seen, totals, ["lang", "source"]), langs, ["lang"]).fillna(0, ["total", "v", "lang_total"])
    within = Window.partitionBy("lang")
    groups = groups.withColumn("no", (F.row_number().over(within.orderBy("source")) - 1).cast("int"))
    groups = stored(groups.withColumn("sources", F.count(F.lit(1)).over(within)))
    return _pairs(kept, groups, terms_each, sources_each).unionByName(_cells(top, kept, groups))
