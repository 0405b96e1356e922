"""Toxicity by a weighted finite-state grammar over clauses.

Words fall into classes: insults, whose weights are learned from labels, and short fixed lists of
threats, targets (second person), negations and verbs of reported speech. One small transducer
follows each of negation, target, report and insult; their product is a single machine that reads a
clause and names what it matched: an insult that is plain, aimed at someone, negated or reported, a
threat likewise. A logistic model weighs what a document's clauses matched.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listinglake.llm.common import held_out, labelled
from listinglake.llm.logistic import Logistic
from listinglake.llm.tokens import REMEMBERED

# Rows that labels are learned from; a fixed sample, while every document is scored.
MOST_LABELS = 20_000
# Words and stems the insult lexicon may hold, the toxic texts a term must be in to enter it and the
# log odds it must have there. They belong to the model: other values give other scores.
LEXICON = 4096
SEEN, LOG_ODDS = 5, 3.0
STEMS = (4, 5, 6, 7)
CUT = 0.3

# Second person, negation, reported speech and threats in four languages.
TARGETS = "you your yours you're du dich dir dein deine ihr euch tu toi te ton ta vous votre usted ustedes ti tú vos".split()
NEGATIONS = "not no never isn't aren't don't nicht kein keine nie niemals pas jamais non nunca jamás ni".split()
REPORTS = "said says quoted called calls wrote claimed sagte sagt schrieb nannte dit écrit appelle dijo dice escribió llamó".split()
THREATS = "kill hurt destroy beat töten verletzen zerstören tuer frapper détruire matar golpear destruir".split()

OTHER, END, TARGET, NEGATION, REPORT, THREAT, INSULT = range(7)
# Words that a negation or a target reaches over.
REACH = 4


def transducers() -> dict[str, dict[tuple[int, int], int]]:
    """The single machines: (state, class) to state. State 0 is at rest; n counts words still in reach."""
    def reaching(opens: int) -> dict[tuple[int, int], int]:
        return {
            (state, word): 0 if word == END else REACH if word == opens else max(state - 1, 0)
            for state, word in product(range(REACH + 1), range(7))
        }

    report = {(s, w): 0 if w == END else 1 if w == REPORT else s for s, w in product(range(2), range(7))}
    return {"negated": reaching(NEGATION), "aimed": reaching(TARGET), "insulted": reaching(INSULT), "reported": report}


KINDS = [f"{what}{aim}{turn}" for what in ("insult", "threat") for aim in ("", "_aimed") for turn in ("", "_negated", "_reported")] + ["answered"]


def composed() -> tuple[dict[tuple[int, int], tuple[int, int]], int]:
    """The product of the transducers: (state, class) to (state, kind or -1), states numbered from 0."""
    machines = transducers()
    names = list(machines)
    number, table = {(0,) * len(names): 0}, {}
    todo = list(number)
    while todo:
        state = todo.pop()
        at = dict(zip(names, state))
        for word in range(7):
            then = tuple(machines[n][at[n], word] for n in names)
            kind = ""
            if word in (INSULT, THREAT):
                kind = ("insult" if word == INSULT else "threat") + "_aimed" * bool(at["aimed"])
                kind += "_negated" if at["negated"] else "_reported" if at["reported"] else ""
            elif word == TARGET and at["insulted"]:
                kind = "answered"
            if then not in number:
                number[then] = len(number)
                todo.append(then)
            table[number[state], word] = (number[then], KINDS.index(kind) if kind else -1)
    return table, len(number)


EDGES = "\"'“”„«»‘’()[]{}<>*_#~.,;:!?¡¿|$%&"
ENDS = ".!?;:"
FEATURES = len(KINDS) + 4


class Grammar:
    """Reads documents; ``lexicon`` maps words, and stems ending in ``*``, to weights."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.table, _ = composed()
        self.fixed = {w: c for c, ws in ((THREAT, THREATS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS)) for w in ws}
        self.known: dict[str, tuple[int, float, bool]] = {}
        self.loud: dict[str, int] = {}

    def read(self, token: str) -> tuple[int, float, bool]:
        """Class, weight and whether a clause ends with it."""
        core, ends = token.strip(EDGES), token[-1:] in ENDS
        weight = self.lexicon.get(core, 0.0)
        for n in STEMS:
            if len(core) >= n:
                weight = max(weight, self.lexicon.get(core[:n] + "*", 0.0))
        kind = INSULT if weight else self.fixed.get(core, OTHER)
        return kind, weight, ends

    def features(self, text: str) -> np.ndarray | None:
        """Sums by kind, the heaviest clause, all matches and their share of the words; None without any."""
        tokens = text.lower().split()
        loud = self.loud
        if len(loud) > REMEMBERED:
            loud.clear()
        try:
            found = max(map(loud.__getitem__, tokens), default=0)
        except KeyError:
            for t in tokens:
                if t not in loud:
                    loud[t] = int(self.read(t)[0] >= THREAT)
            found = max(map(loud.__getitem__, tokens), default=0)
        if not found:
            return None
        sums, state, clause, heaviest, hits = [0.0] * len(KINDS), 0, 0.0, 0.0, 0
        known, table = self.known, self.table
        if len(known) > REMEMBERED:
            known.clear()
        for t in tokens:
            word = known.get(t)
            if word is None:
                word = known[t] = self.read(t)
            kind, weight, ends = word
            state, match = table[state, kind]
            if match >= 0:
                gain = weight or 1.0
                sums[match] += gain
                clause += gain
                hits += kind == INSULT
            if ends:
                heaviest, clause = max(heaviest, clause), 0.0
                state, _ = table[state, END]
        heaviest = max(heaviest, clause)
        insults = sum(sums[:6])
        return np.array([math.log1p(x) for x in sums] + [math.log1p(heaviest), math.log1p(insults), math.log1p(hits), min(1.0, 10 * hits / len(tokens))])


def _all_features(texts, grammar: Grammar) -> np.ndarray:
    none = np.zeros(FEATURES)
    rows = [grammar.features(t) for t in texts]
    return np.array([none if r is None else r for r in rows]).reshape(-1, FEATURES)


def learn_lexicon(sample: DataFrame, most: int = LEXICON, seen: int = SEEN, log_odds: float = LOG_ODDS) -> dict[str, float]:
    """Words and stems that tell toxic documents of ``sample`` (text, _label), with their log odds.

    Every distinct text counts once per label, as a text and in its words, so that copies don't vote; terms
    are counted in the tasks first. At most ``most`` terms, each in ``seen`` toxic texts or more.
    """
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in {t.strip(EDGES) for t in text.lower().split()} - {""}:
                    counts[word][label] += 1
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[1] for c in counts.values()]), pa.array([c[0] for c in counts.values()])], ["word", "toxic", "clean"])

    texts = sample.select(F.coalesce("text", F.lit("")).alias("text"), "_label").distinct()
    counted = texts.mapInArrow(words, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    stems = F.concat(F.array("word"), *[F.when(F.length("word") >= n, F.array(F.concat(F.substring("word", 1, n), F.lit("*")))).otherwise(F.array().cast("array<string>")) for n in STEMS])
    terms = counted.select(F.explode(stems).alias("term"), "toxic", "clean").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n = {r["_label"]: r["n"] for r in texts.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = F.log((F.col("toxic") + 0.1) / (n.get(1, 0) + 1)) - F.log((F.col("clean") + 0.1) / (n.get(0, 0) + 1))
    told = terms.where(F.col("toxic") >= seen).withColumn("odds", odds).where(F.col("odds") >= log_odds)
    best = told.orderBy(F.desc(F.col("toxic") * F.col("odds")), "term").limit(most).collect()
    return {r.term: min(r.odds, 6.0) for r in best}


class Model:
    """A grammar with its lexicon and the weights of what it matches."""

    def __init__(self, lexicon: dict[str, float], logistic: Logistic):
        self.lexicon, self.logistic = lexicon, logistic

    def scores(self, texts, grammar: Grammar) -> np.ndarray:
        return self.logistic.probability(_all_features(texts, grammar))


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """One (text, _label) per labelled id, at most ``most``; of rows that share an id the one whose text has the
    smallest hash, so that the order of rows doesn't matter."""
    text = F.coalesce("text", F.lit(""))
    sample = labelled(docs.select("doc_id", "text"), labels, "toxic", most)
    one = sample.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64(text).alias("hash"), text.alias("text"), "_label")).alias("row"))
    return one.select("row.text", "row._label")


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS, lexicon_size: int = LEXICON, seen: int = SEEN, log_odds: float = LOG_ODDS) -> Model:
    """Fit on at most ``most`` labelled documents outside the held-out quarter, which bounds what is collected;
    the other parameters are those of ``learn_lexicon``."""
    from listinglake.llm.common import stored

    sample = stored(labelled_texts(docs, labels, most))
    lexicon = learn_lexicon(sample, lexicon_size, seen, log_odds)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            values = _all_features(batch.column(0).to_pylist(), grammar)
            yield pa.RecordBatch.from_arrays([pa.array(list(values), pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = sample.mapInArrow(features, "x array<double>, y int").groupBy("x", "y").count().collect()
    rows.sort(key=lambda r: (r.x, r.y))
    x = np.array([r.x for r in rows for _ in range(r["count"])], dtype=float).reshape(-1, FEATURES)
    y = np.array([r.y for r in rows for _ in range(r["count"])], dtype=float)
    return Model(lexicon, Logistic(x, y))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``; a null text scores as an empty one, all columns stay."""
    names = [c for c in docs.columns if c != name]
    at = len(names)
    picked = docs.select(*names, F.coalesce(F.col(text), F.lit("")).alias("_scored"))
    schema = docs.select(*names, F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.lexicon)
        for batch in batches:
            values = model.scores(batch.column(at).to_pylist(), grammar) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(values, pa.float64())], [*names, name])

    return picked.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) per row of ``docs``.

    Only the text is scored. Null and empty texts get the score of a document without matches; a
    null doc_id isn't held out; repeated rows repeat; without labels every score is 0.5's prior;
    other columns are ignored; an empty table gives an empty result.
    """
    scored = score(docs.select("doc_id", "text"), learn(docs, labels, most))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
