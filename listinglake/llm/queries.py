"""The registered queries of this package and the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listinglake.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SHARDS = 24


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listinglake.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# DuckDB's lower() folds more letters than A-Z, so they are spelled out.
AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op2_exact_dedup", f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, sha256({AZ}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST, r DESC) = 1 AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listinglake.llm.exact_dedup import exact_duplicates

    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listinglake.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), token_pattern(), by=("source",))


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listinglake.llm.packing import pack

    packed = pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), token_pattern())
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset", "row")


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listinglake.llm.bpe import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), token_pattern())


@query("op6_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listinglake.llm.sharding import shards

    placed = shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell"
    )


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listinglake.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listinglake.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_ann")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listinglake.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op10_html_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listinglake.llm.html_main import main_text

    return main_text(table(spark, sf_dir, "pages"))


def _share_sql(count: str, total: str) -> str:
    return f"(1 + (1000000000::HUGEINT * ({count} + 2)) // ({total} + 2 * v))"


def _distance_sql(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) // ({p} + {q})"


@query("op13_divergence", f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({AZ}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total, coalesce(any_value(v), 0) AS v, coalesce(any_value(lang_total), 0) AS lang_total
  FROM g LEFT JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source
),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, {_share_sql('coalesce(c.n, 0)', 'total')} AS p, {_share_sql('lang_n', 'lang_total')} AS q
  FROM s JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
),
pairs AS (
  SELECT x.lang, x.source, y.source AS item, sum({_distance_sql('x.p', 'y.p')}) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source
),
ranked AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, {_distance_sql('p', 'q')} FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value,
  (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= 10
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listinglake.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


@query("op12_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listinglake.llm.alignment import alignment

    found, _ = alignment(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), token_pattern(), tokenizer_file("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


@query("op11_minhash")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listinglake.llm.minhash import documents, written

    found = documents(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), written("fp").alias("fingerprint"),
        written("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "class_id", "class_rows",
    )
