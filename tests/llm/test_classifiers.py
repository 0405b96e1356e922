import pytest
from pyspark.sql import functions as F

from listinglake.llm.common import held_out, with_row
from listinglake.llm.quality import good_documents, host_of, quality
from listinglake.llm.toxicity import INSULT, KINDS, Grammar, composed, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_held_out(docs, labels):
    r = toxicity(docs, labels).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(x.toxic, x.predicted): x["count"] for x in r}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.9 and n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) >= 0.9


def test_labels_of_the_held_out_quarter_change_nothing(docs, labels):
    few = docs.where("doc_id < 1500")
    other = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity(few, x).collect()} for x in (labels, other))
    assert a == b


def odd(spark):
    data = [(1, None, None, None), (2, "", "en", "s"), (3, "word " * 50_000, "en", "s"), (3, "word " * 50_000, "en", "s"), (None, "idiot", "en", "s"), (4, "x", "de", "t")]
    return spark.createDataFrame([(*d, "c") for d in data], "doc_id long, text string, lang string, source string, score string")


def test_odd_rows(spark, labels):
    docs = odd(spark)
    for some in (labels, labels.limit(0)):
        tox, good = toxicity(docs, some).collect(), quality(docs, some).collect()
        assert len(tox) == len(good) == 6
        assert all(0 <= r.score <= 1 for r in [*tox, *good])
        assert good_documents(docs, some).columns == docs.columns
    assert good_documents(docs, labels.limit(0)).count() == 6
    assert toxicity(docs.limit(0), labels).count() == 0 and quality(docs.limit(0), labels).count() == 0


def test_grammar_reads_clauses():
    table, _ = composed()
    grammar = Grammar({"fool": 3.0, "scoun*": 2.0})

    def kinds(text):
        return {KINDS[i] for i, v in enumerate(grammar.features(text)[:len(KINDS)]) if v}

    assert grammar.features("nothing to see") is None and grammar.features("") is None
    assert kinds("a fool.") == {"insult"} and kinds("Scoundrels!") == {"insult"}
    assert kinds("you fool") == {"insult_aimed"} and kinds("not a fool") == {"insult_negated"}
    assert kinds("fool, you") == {"insult", "answered"} and kinds("she said: fool") == {"insult"}
    assert kinds("she said fool") == {"insult_reported"} and kinds("kill you") == {"threat"}
    assert all(table[s, INSULT][1] >= 0 for s, c in table if c == INSULT)


def test_quality_labels(docs, labels):
    r = quality(docs, labels).join(labels, "doc_id").groupBy("quality", "keep").count().collect()
    n = {(x.quality, x.keep): x["count"] for x in r}
    assert n.get((1, False), 0) <= 0.005 * n[1, True] and n.get((0, True), 0) <= 0.05 * n[0, False]


def test_filter_is_the_same_with_and_without_broadcast(docs, labels):
    few = with_row(docs.where("doc_id < 2000"), "_n")
    a, b = (sorted(r["_n"] for r in good_documents(few, labels, broadcast=n).collect()) for n in (200_000, 0))
    kept = quality(few, labels).where("keep").count()
    assert a == b and len(a) == kept


def test_sparse_sites_shrink_to_the_corpus(spark, labels):
    rows = [(i, "fine words follow here and there", "en", "big") for i in range(200)] + [(900, "fine words follow here and there", "en", "lone")]
    got = quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), labels).collect()
    assert max(r.host_rate for r in got) - min(r.host_rate for r in got) < 0.05


def test_hosts(spark):
    df = spark.createDataFrame([("https://A.com/x/y",), ("src0",), (None,), ("b.org/p?q",)], "source string")
    assert [r[0] for r in df.select(host_of(F.col("source"))).collect()] == ["a.com", "src0", "", "b.org"]
