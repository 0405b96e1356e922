"""Quality by hierarchical empirical Bayes: a document's own evidence and what its site is like.

A logistic model of surface features gives each document a probability. Sites are hosts and, below
them, sections: the first segment of the path, or the language where a source has no path. A section's rate is a Beta posterior whose prior is its host's
rate, a host's posterior has the corpus rate as prior; how strongly sparse sites shrink is estimated
from how much sites differ. A document's odds are its evidence times the odds of its section, from
which its own part is left out.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglake.llm.common import attach, labelled, stored
from listinglake.llm.logistic import Logistic

# Rows that labels are learned from; a fixed sample, while every document is scored.
MOST_LABELS = 20_000
# Documents below this probability of good quality are rejected.
CUT = 0.3
# Bounds of the prior's weight, in documents.
LEAST_PRIOR, MOST_PRIOR = 2.0, 10_000.0

NOISE = "#$%&*"
INNER = re.compile(r"\w[,.;:!?]\w")
FEATURES = 14


def features(text: str) -> list[float]:
    """Shares, of words or of characters, that tell prose from junk; an empty text has its own flag."""
    words = text.split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (FEATURES - 1)
    chars = len(text)
    noise = sum(map(text.count, NOISE))
    distinct = len(set(words))
    lines = text.split("\n")
    repeats = sum(map(operator.eq, words, words[1:]))
    return [
        0.0,
        min(np.log1p(n), 9.0),
        min(1.0, 3 * noise / chars) ** 0.5,
        min(1.0, text.count("|") / n) ** 0.5,
        min(1.0, text.count("!!") / n) ** 0.5,
        (sum(map(str.isupper, words)) / n) ** 0.5,
        (repeats / n) ** 0.5,
        distinct / n,
        # distinct words grow with the square root of a text's length
        min(1.5, distinct / n**0.75),
        min(1.0, len(INNER.findall(text)) / n) ** 0.5,
        min(20.0, (chars - n) / n) / 10,
        1 - len(set(lines)) / len(lines),
        min(1.0, sum(map(str.isdigit, words)) / n) ** 0.5,
        min(1.0, len(lines) / n) ** 0.5,
    ]


def _features(texts) -> np.ndarray:
    return np.array([features(t or "") for t in texts], dtype=float).reshape(-1, FEATURES)


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> Logistic:
    """The document model, fitted on at most ``most`` labelled documents; of rows that share an id, on the
    one whose text has the smallest hash, so that the order of rows doesn't matter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array(list(_features(batch.column(2).to_pylist())), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], rows, batch.column(3)], ["doc_id", "hash", "x", "y"])

    sample = labelled(docs.select("doc_id", "text"), labels, "quality", most)
    sample = sample.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text", "_label")
    schema = sample.select("doc_id", "hash", F.lit(None).cast("array<double>").alias("x"), F.lit(0).alias("y")).schema
    one = sample.mapInArrow(run, schema).groupBy("doc_id").agg(F.min(F.struct("hash", "x", "y")).alias("row"))
    rows = sorted((r.row for r in one.collect()), key=lambda r: (r.hash, r.x, r.y))
    x = np.array([r.x for r in rows], dtype=float).reshape(-1, FEATURES)
    return Logistic(x, np.array([r.y for r in rows], dtype=float))


def host_of(source: Column) -> Column:
    """The site's name: what precedes the first slash, after a scheme if there is one."""
    return F.coalesce(F.lower(F.regexp_extract(source, r"^(?:[a-zA-Z]+://)?([^/?#]*)", 1)), F.lit(""))


def section_of(source: Column, lang: Column) -> Column:
    """The site and, below it, the first segment of the path; where there is none, the language."""
    segment = F.coalesce(F.lower(F.regexp_extract(source, r"^(?:[a-zA-Z]+://)?[^/?#]*/+([^/?#]+)", 1)), F.lit(""))
    below = F.when(segment != "", F.concat(F.lit("/"), segment)).otherwise(F.coalesce(lang, F.lit("")))
    return F.concat_ws("\x1f", host_of(source), below)


def _strength(sites: DataFrame, n: str, mean: str, overall: float) -> float:
    """Weight of the prior in documents, by the method of moments: the less sites differ, the more."""
    weight = F.col(n)
    r = sites.agg(
        F.sum(weight * (F.col(mean) - overall) ** 2).alias("between"), F.sum(weight).alias("n"), F.count(F.lit(1)).alias("sites"), F.sum(weight * weight).alias("nn")
    ).first()
    if not r["sites"] or r["sites"] < 2:
        return MOST_PRIOR
    spread = overall * (1 - overall)
    free = r["n"] - r["nn"] / r["n"]
    variance = (r["between"] - (r["sites"] - 1) * spread) / free if free > 0 else 0.0
    return float(min(MOST_PRIOR, max(LEAST_PRIOR, spread / variance - 1))) if variance > 0 else MOST_PRIOR


# Sections that a filter may broadcast; a longer table is joined instead.
BROADCAST_SECTIONS = 200_000


def _keyed(docs: DataFrame, others: list[str], text: str = "text") -> DataFrame:
    """``others``, the host and section of each row, and its text, null as empty."""
    host = host_of(F.col("source"))
    section = section_of(F.col("source"), F.col("lang"))
    return docs.select(*others, host.alias("_host"), section.alias("_section"), F.coalesce(F.col(text), F.lit("")).alias("_text"))


def _with_evidence(keyed: DataFrame, model: Logistic) -> DataFrame:
    """``keyed`` with its text replaced by ``_evidence``, the document model's probability."""
    names = keyed.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probability(_features(batch.column(len(names)).to_pylist())) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64())], [*names, "_evidence"])

    return keyed.mapInArrow(run, keyed.select(*names, F.lit(0.0).alias("_evidence")).schema)


def site_rates(rows: DataFrame) -> tuple[DataFrame, float, float, int]:
    """Sections (_section, _n, _good, host_rate) of stored ``rows``, the prior's weight for a section,
    the corpus rate and the number of rows."""
    sections = stored(rows.groupBy("_section", "_host").agg(F.count(F.lit(1)).alias("_n"), F.sum("_evidence").alias("_good")))
    whole = sections.agg(F.sum("_n").alias("n"), F.sum("_good").alias("good")).first()
    total = whole["n"] or 0
    overall = min(max((whole["good"] or 0.0) / total, 1e-6), 1 - 1e-6) if total else 0.5
    hosts = stored(sections.groupBy("_host").agg(F.sum("_n").alias("n"), F.sum("_good").alias("good")).withColumn("mean", F.col("good") / F.col("n")))
    for_host = _strength(hosts, "n", "mean", overall)
    for_section = _strength(sections.withColumn("mean", F.col("_good") / F.col("_n")), "_n", "mean", overall)
    hosts = hosts.select("_host", ((F.lit(for_host * overall) + F.col("good")) / (for_host + F.col("n"))).alias("host_rate"))
    return stored(sections.join(hosts, "_host").select("_section", "_n", "_good", "host_rate")), for_section, overall, total


def _scored(joined: DataFrame, for_section: float, overall: float) -> DataFrame:
    """Adds section_rate, which leaves the row itself out, and score."""
    others = (F.lit(for_section) * F.col("host_rate") + F.col("_good") - F.col("_evidence")) / (F.lit(for_section) + F.col("_n") - 1)
    near = F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6))
    own = F.least(F.greatest(F.col("_evidence"), F.lit(1e-9)), F.lit(1 - 1e-9))
    odds = F.log(own / (1 - own)) + F.log(near / (1 - near)) - float(np.log(overall / (1 - overall)))
    return joined.withColumn("section_rate", near).withColumn("score", 1 / (1 + F.exp(-odds)))


def quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS, cut: float = CUT) -> DataFrame:
    """Per row of ``docs``: doc_id, evidence, host_rate, section_rate, score, keep.

    Null and empty texts are one kind of document with its own evidence; null sources and languages
    are a site and a section like others; repeated rows repeat; without labels nothing is known and
    everything kept; columns beside doc_id, text, source and lang are ignored; an empty table gives
    an empty result.
    """
    rows = stored(_with_evidence(_keyed(docs, ["doc_id"]), learn(docs, labels, most)))
    sections, for_section, overall, total = site_rates(rows)
    scored = _scored(attach(rows, sections, "_section", "_n", total), for_section, overall)
    return scored.select("doc_id", F.col("_evidence").alias("evidence"), "host_rate", "section_rate", "score", (F.col("score") >= cut).alias("keep"))


def good_documents(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS, cut: float = CUT, broadcast: int = BROADCAST_SECTIONS) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, all columns as they are.

    Texts aren't shuffled while the sections, counted first, are few enough to broadcast; each row's
    evidence is then computed a second time. Otherwise the rows are joined with their sections.
    """
    model = learn(docs, labels, most)
    rows = stored(_with_evidence(_keyed(docs, []), model))
    sections, for_section, overall, total = site_rates(rows)
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "text", "source", "lang")
    again = _with_evidence(_keyed(packed, ["_row"]), model)
    if sections.count() <= broadcast:
        joined = again.join(F.broadcast(sections), "_section")
    else:
        joined = attach(again, sections, "_section", "_n", total)
    return _scored(joined, for_section, overall).where(F.col("score") >= cut).select("_row.*")
