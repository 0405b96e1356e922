import corpus_pipeline
from listinglake.llm.toxicity import CUT
from listinglake.llm import quality, simhash, toxicity
from tests.llm.test_exact_dedup import AZ
from tests.llm.test_near_copies import slow_first

SF = "/root/testdata/sf0.01"


def test_stages_equal_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.quality(docs, labels).where("keep").collect()}
    clean = {r.doc_id for r in toxicity.toxicity(docs, labels).where(f"score < {CUT}").collect()}
    left = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in kept & clean}
    last = {}
    for d, t in left.items():
        last[t.translate(AZ)] = max(d, last.get(t.translate(AZ), d))
    first = slow_first([(d, left[d]) for d in last.values()])
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted({r.doc_id for r in got}) == first
    assert {r.sequence_id for r in got if r.offset == 0} == {r.sequence_id for r in got}


def test_each_stage_keeps_columns_and_takes_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c d", "en", "s", 7), (5, "A B c d", None, "s", 7)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, SF)
            n = out.count()
            if name != "packing":
                assert out.columns == docs.columns
            if name in ("exact_dedup", "simhash"):
                assert n == (2 if given is docs else 0)


def test_columns_with_internal_names_come_through(spark):
    extra = ["_row", "_Row_", "row", "node", "print", "key", "kept", "hashes", "size", "id", "_label"]
    docs = spark.createDataFrame([(i, t, "en", "s", 3, *[1000 + i] * len(extra)) for i, t in enumerate(["a b", "A B", "c d e", "f"])],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in extra))
    for stage, kept in ((corpus_pipeline.distinct, {1, 2, 3}), (corpus_pipeline.unlike, {0, 2, 3})):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {tuple(r[c] for c in ("doc_id", *extra)) for r in out.collect()} == {(i, *[1000 + i] * len(extra)) for i in kept}


def test_linked_fingerprints_leave_one_document(spark):
    body = "one two three four five six seven eight nine " * 60
    texts = [(9, body + "its own end was written by somebody else here"), (4, body + "another tail with quite different words in it"), (None, body), (7, "nothing like the others at all")]
    fps = [simhash.fingerprint(t.encode(), 3) for _, t in texts]
    assert all((fps[0] ^ f).bit_count() <= 3 for f in fps[1:3]) and (fps[0] ^ fps[3]).bit_count() > 3
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    assert slow_first([(d, t) for d, t in texts if d is not None]) == [4, 7, 9]
    assert {r.doc_id for r in corpus_pipeline.unlike(spark, docs, SF).collect()} == {4, 7}
