"""Toxicity and quality against slow readings of what they say they do."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from listinglake.llm import quality as q
from listinglake.llm import toxicity as tox
from listinglake.llm.common import held_out

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def slow_features(text, lexicon):
    """Clause by clause, by looking back at the words before each insult and threat."""
    grammar = tox.Grammar(lexicon)
    clauses, words = [], text.lower().split()
    clause = []
    for token in words:
        kind, weight, ends = grammar.read(token)
        clause.append((kind, weight))
        if ends:
            clauses.append(clause)
            clause = []
    clauses.append(clause)
    sums, heaviest, hits = dict.fromkeys(tox.KINDS, 0.0), 0.0, 0
    for clause in clauses:
        total = 0.0
        for i, (kind, weight) in enumerate(clause):
            near = [k for k, _ in clause[max(0, i - tox.REACH):i]]
            before = [k for k, _ in clause[:i]]
            name = None
            if kind in (tox.INSULT, tox.THREAT):
                name = "insult" if kind == tox.INSULT else "threat"
                if tox.TARGET in near:
                    name += "_aimed"
                if tox.NEGATION in near:
                    name += "_negated"
                elif tox.REPORT in before:
                    name += "_reported"
            elif kind == tox.TARGET and tox.INSULT in near:
                name = "answered"
            if name:
                sums[name] += weight or 1.0
                total += weight or 1.0
                hits += kind == tox.INSULT
        heaviest = max(heaviest, total)
    if not any(kind >= tox.THREAT for c in clauses for kind, _ in c):
        return np.zeros(tox.FEATURES)
    insults = sum(v for k, v in sums.items() if k.startswith("insult"))
    return np.array([math.log1p(v) for v in sums.values()] + [math.log1p(heaviest), math.log1p(insults), math.log1p(hits), min(1.0, 10 * hits / len(words))])


def test_clauses_read_slowly(docs, labels):
    model = tox.learn(docs, labels)
    more = {**model.lexicon, "fool": 3.0, "der": 1.5, "the": 2.0, "scoun*": 2.0}
    texts = [r.text or "" for r in docs.collect()]
    texts += ["you are not a fool, said the fool. you", "kill the fool you scoundrel!", "dijo the a b c d the you", ""]
    grammar = tox.Grammar(more)
    for text in texts:
        fast = grammar.features(text)
        assert np.allclose(fast if fast is not None else np.zeros(tox.FEATURES), slow_features(text, more)), text
    scores = {r.doc_id: r.score for r in tox.toxicity(docs, labels).collect()}
    slow = {r.doc_id: model.logistic.probability(slow_features(r.text or "", model.lexicon)[None])[0] for r in docs.collect()}
    assert scores.keys() == slow.keys() and all(abs(scores[i] - slow[i]) < 1e-12 for i in slow)


def test_lexicon_counted_slowly(spark):
    made = [("you vile scoundrel", 1), ("you vile scoundrel", 1), ("a vile day", 1), ("a day", 0), ("a day", 0), (None, 0), ("vile", 0)]
    sample = spark.createDataFrame(made, "text string, _label int")
    texts = {(t or "", y) for t, y in made}
    n = [sum(y == label for _, y in texts) for label in (0, 1)]
    want = {}
    words = {w for t, _ in texts for w in t.split()}
    for word in words:
        for term in [word, *[word[:k] + "*" for k in tox.STEMS if len(word) >= k]]:
            # a stem counts each of its words
            held = [sum(sum(w == term or (term[-1] == "*" and w.startswith(term[:-1])) for w in set(t.split())) for t, y in texts if y == label) for label in (0, 1)]
            odds = math.log((held[1] + 0.1) / (n[1] + 1)) - math.log((held[0] + 0.1) / (n[0] + 1))
            if held[1] >= 1 and odds >= 0.5:
                want[term] = min(odds, 6.0)
    got = tox.learn_lexicon(sample, seen=1, log_odds=0.5)
    assert got.keys() == want.keys() and all(abs(got[w] - want[w]) < 1e-9 for w in want)
    assert len(tox.learn_lexicon(sample, most=2, seen=1, log_odds=0.5)) == 2


def test_repeated_labelled_ids_are_one(spark):
    rows = [(i % 8, f"text {i}") for i in range(40)] + [(1, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] * 2, "doc_id long, toxic int")
    learned = []
    for given in (rows, rows[::-1]):
        one = tox.labelled_texts(spark.createDataFrame(given, "doc_id long, text string"), labels, 100).collect()
        learned.append(sorted(map(tuple, one)))
    free = labels.where(~held_out(F.col("doc_id"))).select("doc_id").distinct().count()
    assert learned[0] == learned[1] and len(learned[0]) == free


def slow_quality(rows, evidence):
    """Sites and sections added up in dictionaries."""
    def place(row):
        host, _, path = (row.source or "").lower().partition("://")[2 if "://" in (row.source or "") else 0].partition("/")
        segment = path.lstrip("/").split("/")[0].split("?")[0].split("#")[0]
        return host, (host, "/" + segment if segment else row.lang or "")

    sections, hosts = defaultdict(list), defaultdict(list)
    for row, p in zip(rows, evidence):
        host, section = place(row)
        hosts[host].append(p)
        sections[section].append(p)
    overall = min(max(sum(evidence) / len(evidence), 1e-6), 1 - 1e-6)

    def strength(sites):
        if len(sites) < 2:
            return q.MOST_PRIOR
        n, spread = sum(map(len, sites)), overall * (1 - overall)
        between = sum(len(s) * (sum(s) / len(s) - overall) ** 2 for s in sites)
        free = n - sum(len(s) ** 2 for s in sites) / n
        variance = (between - (len(sites) - 1) * spread) / free
        return min(q.MOST_PRIOR, max(q.LEAST_PRIOR, spread / variance - 1)) if variance > 0 else q.MOST_PRIOR

    for_host, for_section = strength(list(hosts.values())), strength(list(sections.values()))
    out = []
    for row, p in zip(rows, evidence):
        host, section = place(row)
        host_rate = (for_host * overall + sum(hosts[host])) / (for_host + len(hosts[host]))
        near = (for_section * host_rate + sum(sections[section]) - p) / (for_section + len(sections[section]) - 1)
        near, own = min(max(near, 1e-6), 1 - 1e-6), min(max(p, 1e-9), 1 - 1e-9)
        odds = math.log(own / (1 - own)) + math.log(near / (1 - near)) - math.log(overall / (1 - overall))
        out.append((row.doc_id, p, host_rate, near, 1 / (1 + math.exp(-odds))))
    return out


@pytest.mark.parametrize("source", ["source", "concat('https://', source, '/', lang, if(doc_id % 3 = 0, '/x?y#z', ''))", "if(doc_id % 2 = 0, concat(source, '/p', doc_id % 4, '?q=/r'), source)"])
def test_sites_added_up_slowly(docs, labels, source):
    moved = docs.withColumn("source", F.expr(source)).cache()
    rows = moved.orderBy("doc_id").collect()
    evidence = q.learn(moved, labels).probability(q._features([r.text for r in rows]))
    got = sorted(tuple(r)[:5] for r in q.quality(moved, labels).collect())
    want = slow_quality(rows, [float(p) for p in evidence])
    assert len({s for s in got}) > 1 and len(got) == len(want)
    assert all(g[0] == w[0] and np.allclose(g[1:], w[1:], rtol=1e-9) for g, w in zip(got, want))


def test_sections(spark):
    given = [("https://A.com/X/y", "en"), ("src0", "de"), (None, None), ("b.org/?q", "fr"), ("b.org//p#z", "fr"), ("b.org/fr", "en")]
    df = spark.createDataFrame(given, "source string, lang string")
    got = [r[0].split("\x1f") for r in df.select(q.section_of(F.col("source"), F.col("lang"))).collect()]
    assert got == [["a.com", "/x"], ["src0", "de"], ["", ""], ["b.org", "fr"], ["b.org", "/p"], ["b.org", "/fr"]]
