"""From raw documents to packed sequences: each stage is one operator, and its result the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listinglake.llm import exact_dedup, quality, simhash, toxicity
from listinglake.llm.common import stored, table, with_row
from listinglake.llm.near_copies import near_copies
from listinglake.llm.packing import pack
from listinglake.llm.queries import token_pattern, tokenizer_file


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, name="_toxicity").where(F.col("_toxicity") < toxicity.CUT).select(*docs.columns)


def row_name(docs: DataFrame) -> str:
    """A column name that the documents don't have."""
    taken = {c.lower() for c in docs.columns}
    return next(name for name in ("_row" + "_" * i for i in range(len(taken) + 1)) if name not in taken)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    name = row_name(docs)
    rows = with_row(docs, name)
    kept = exact_dedup.exact_duplicates(rows, row=name).where("kept").select(F.col("row").alias(name))
    return rows.join(kept, name, "left_semi").select(*docs.columns)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link, directly or through others, the one with the smallest id; null ids come last.

    What is left of the near copies after that is found by their words: a text goes as well if one before it, whether
    that one stays or not, has a five-word similarity of 0.8 or more, which few such pairs have within 3 bits.
    """
    name = row_name(docs)
    rows = with_row(docs, name)
    linked = simhash.near_duplicates(rows, id_col=name, keep=("doc_id",))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", name))[name]
    firsts = linked.groupBy("component_id").agg(first.alias(name)).select(name)
    copies = near_copies(rows, row=name).select(F.col("row").alias(name))
    return rows.join(firsts, name, "left_semi").join(copies, name, "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1,024 tokens."""
    found = pack(docs, tokenizer_file("byte_bpe_50k.json"), token_pattern())
    return found.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", good), ("toxicity", civil), ("exact_dedup", distinct), ("simhash", unlike), ("packing", packed)]

# Tokens, fingerprints and fitted models are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
