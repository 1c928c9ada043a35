"""Toxicity by a weighted finite-state grammar over clauses.

Words become labels: insult, threat, target, negation, report, other. Small transducers rewrite the labels of a clause: one marks
insults and threats in the scope of a negation, one those in reported speech, and one reads what they
leave and names the clause when it ends. Their composition is one machine, built once. An insult or threat carries a weight, its
log-odds among labelled texts, and a clause weighs as much as its words. A text's features are the weights of its clauses by
kind; a logistic regression on labelled texts gives what each kind of clause counts for.

The insult words are a fixed list and words learned from labelled texts, of any language.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm import hashing
from gazette.llm.batches import bounded, release
from gazette.session import stored

# Common words of each part of the grammar.
INSULTS = ["idiot", "idiots", "moron", "morons", "stupid", "scum", "loser", "losers", "trash", "worthless", "pathetic", "disgusting", "clown",
           "dumb", "imbecile", "bastard", "dummkopf", "trottel", "abschaum", "imbécile", "crétin", "abruti", "imbécil", "estúpido", "basura"]
THREATS = ["kill", "hurt", "destroy", "beat", "murder", "crush", "punish", "töten", "umbringen", "tuer", "frapper", "matar", "golpear"]
TARGETS = ["you", "your", "youre", "u", "he", "she", "they", "him", "her", "them", "people", "du", "sie", "ihr", "euch", "tu", "vous", "ils",
           "elles", "usted", "ustedes", "ellos"]
NEGATIONS = ["not", "no", "never", "isnt", "arent", "dont", "wont", "without", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "tampoco"]
REPORTS = ["said", "says", "wrote", "called", "reported", "claimed", "quoted", "sagte", "schrieb", "nannte", "dit", "écrit", "appelé", "dijo",
           "escribió", "llamó"]

#: Words in the scope of a negation.
SCOPE = 3
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
KINDS = [f"{what}_{how}" for what in ("insult", "threat") for how in ("at_target", "plain", "negated", "reported")]
_WORD = re.compile(r"[^\W_]+")
_CLAUSE = re.compile(r"[.!?;\n]+")


class Transducer:
    """Arcs from (state, label) to (state, label); a label without an arc is copied and keeps the state."""

    def __init__(self, arcs: dict, start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, label):
        return self.arcs.get((state, label), (state, label))


def negation() -> Transducer:
    """Insults and threats within SCOPE words of a negation come out negated."""
    arcs = {}
    for s in range(SCOPE + 1):
        left = max(s - 1, 0)
        for label in (OTHER, TARGET, REPORT):
            arcs[s, label] = (left, label)
        arcs[s, NEGATION] = (SCOPE, OTHER)
        for label in (INSULT, THREAT):
            arcs[s, label] = (left, (label, "negated") if s else label)
        arcs[s, END] = (0, END)
    return Transducer(arcs)


def report() -> Transducer:
    """What follows a word of report in its clause comes out reported."""
    arcs = {(s, REPORT): (1, OTHER) for s in (0, 1)} | {(s, END): (0, END) for s in (0, 1)}
    for label in (INSULT, THREAT):
        arcs[1, label] = (1, (label, "reported"))
        arcs[1, (label, "negated")] = (1, (label, "negated"))
    return Transducer(arcs)


def clause() -> Transducer:
    """Reads a clause and names it at its end: the gravest word in it, and whether a target stands beside it."""
    plain = [None, *((label, how) for label in (INSULT, THREAT) for how in ("reported", "negated", "plain"))]
    arcs = {}
    for k, found in enumerate(plain):
        for target in (False, True):
            for label in (OTHER, NEGATION, REPORT):
                arcs[(k, target), label] = ((k, target), OTHER)
            arcs[(k, target), TARGET] = ((k, True), OTHER)
            for j, other in enumerate(plain[1:], 1):
                label = other[0] if other[1] == "plain" else other
                arcs[(k, target), label] = ((max(j, k), target), OTHER)
            name = None
            if found:
                how = "at_target" if found[1] == "plain" and target else found[1]
                name = f"{'insult' if found[0] == INSULT else 'threat'}_{how}"
            arcs[(k, target), END] = ((0, False), name)
    return Transducer(arcs, (0, False))


def compose(*parts: Transducer) -> Transducer:
    """One machine in which each part reads what the part before it writes."""
    start = tuple(p.start for p in parts)
    arcs, open_ = {}, [start]
    seen = {start}
    while open_:
        state = open_.pop()
        for label in range(END + 1):
            out, after = label, []
            for part, s in zip(parts, state):
                s, out = part.step(s, out)
                after.append(s)
            arcs[state, label] = (tuple(after), out)
            if tuple(after) not in seen:
                seen.add(tuple(after))
                open_.append(tuple(after))
    return Transducer(arcs, start)


def grammar() -> Transducer:
    return compose(negation(), report(), clause())


def labels_of(insults: dict[str, float]) -> dict[str, tuple[int, float]]:
    """Label and weight of every word that has one; an insult outweighs other readings of its word."""
    table = {w: (label, 0.0) for label, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
    table |= {w: (THREAT, 1.0) for w in THREATS}
    return table | {w: (INSULT, x) for w, x in insults.items()}


def clauses(text: str, table: dict, machine: Transducer):
    """(kind, weight, clause) of every clause that the grammar names."""
    graver = {w for w, (label, _) in table.items() if label in (INSULT, THREAT)}
    return _clauses(text.lower(), table, machine, graver)


def _clauses(text: str, table: dict, machine: Transducer, graver: set):
    for part in _CLAUSE.split(text):
        words = _WORD.findall(part)
        if graver.isdisjoint(words):
            continue
        state, weight = machine.start, 0.0
        for w in words:
            label, x = table.get(w, (OTHER, 0.0))
            weight += x
            state, _ = machine.step(state, label)
        _, kind = machine.step(state, END)
        if kind:
            yield kind, weight, part


def features(text: Column, insults: dict[str, float]) -> Column:
    """Array of the logarithms of one plus the weights of a text's clauses, one entry per kind; zeros for a null text."""
    table = labels_of(insults)

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        machine, graver, out = grammar(), {w for w, (label, _) in table.items() if label in (INSULT, THREAT)}, []
        place = {k: i for i, k in enumerate(KINDS)}
        for text in texts:
            sums = [0.0] * len(KINDS)
            if text:
                text = text.lower()
                if not graver.isdisjoint(_WORD.findall(text)):
                    for kind, weight, _ in _clauses(text, table, machine, graver):
                        sums[place[kind]] += weight
            out.append([math.log1p(x) for x in sums])
        release()
        return pd.Series(out)

    return run(text)


def _signatures(texts: pd.Series) -> np.ndarray:
    """Three minima of hashed word triples per text: near copies mostly share one."""
    out = np.zeros((len(texts), 3), np.int64)
    for at, part in hashing.pieces_of(pa.array(texts, pa.string())):
        owner, word = hashing.shingles(part, 3)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        for k in range(3):
            if len(first):
                out[at + owner[first], k] = np.minimum.reduceat(hashing.mix(word * np.uint64(2 * k + 3)), first).view(np.int64)
    return out


def _marked(frames):
    for frame in frames:
        marks = _signatures(frame["text"])
        yield pd.DataFrame({"text": frame["text"], "toxic": frame["toxic"], "a": marks[:, 0], "b": marks[:, 1], "c": marks[:, 2]})


def training_texts(docs: DataFrame, labels: DataFrame, key: str, body: str, most: int) -> DataFrame:
    """(text, toxic): at most about `most` labelled texts of either label, chosen by a hash of the key, one of each group of
    near copies.

    labels: (key, toxic). Only the chosen keys, a number that `most` bounds, are sent to the documents.
    """
    counts = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, most / max(counts.get(1, 0), 1))).otherwise(min(1.0, most / max(counts.get(0, 0), 1)))
    chosen = labels.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share * (1 << 30)).groupBy(key).agg(F.max("toxic").alias("toxic"))
    texts = bounded(docs).select(F.col(key), F.col(body).cast("string").alias("text")).join(F.broadcast(chosen), key).filter("length(text) > 0")
    marked = texts.select("text", F.col("toxic").cast("int")).mapInPandas(_marked, "text string, toxic int, a bigint, b bigint, c bigint")
    for mark in "abc":
        marked = marked.dropDuplicates(["toxic", mark])
    return stored(marked.select("text", "toxic"), "labelled")


def _words_of(frames):
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    docs = Counter()
    for frame in frames:
        for text, toxic in zip(frame["text"], frame["toxic"]):
            counts[toxic].update({w for w in _WORD.findall(text.lower()) if len(w) > 2})
            docs[toxic] += 1
    rows = [(w, t, n) for t in (0, 1) for w, n in counts[t].items()] + [("", t, n) for t, n in docs.items()]
    yield pd.DataFrame(rows, columns=["word", "toxic", "n"])


def learn_insults(texts: DataFrame, most: int = 1000, least: float = 3.0) -> dict[str, float]:
    """Weight of every insult word: the fixed list and up to `most` words whose log-odds of a toxic text are `least` or more.

    A learned word has to be in three toxic texts and 0.4 % of them at least, and its likelihood ratio against chance
    (G squared) has to reach 18, which leaves about one word in fifty thousand to chance.
    """
    counts = texts.mapInPandas(_words_of, "word string, toxic int, n bigint").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    counts = stored(counts, "words")
    total = counts.filter("word = ''").first()
    n_toxic, n_clean = (total.t, total.c) if total else (0, 0)
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_clean + 1.0))
    known = {w: 2.0 for w in INSULTS}
    n = F.col("t") + F.col("c")
    part = lambda x, of: F.when(x > 0, x * F.log(x * (n_toxic + n_clean) / (n * F.lit(float(max(of, 1)))))).otherwise(0)
    scored = counts.filter("word <> ''").withColumn("odds", odds).withColumn("g", 2 * (part(F.col("t"), n_toxic) + part(F.col("c"), n_clean)))
    rest = scored.filter((F.col("t") >= max(3, 0.004 * n_toxic)) & (F.col("odds") >= least) & (F.col("g") >= 18))
    for r in rest.orderBy(F.desc("t"), "word").limit(most).collect() if n_toxic and n_clean else []:
        known[r.word] = round(float(r.odds), 3)
    return known


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", body: str = "text", most: int = 8000) -> tuple[dict[str, float], list[float], float]:
    """(insult weights, weight of each kind of clause, intercept), from at most about `most` labelled texts of either label.

    labels: (key, toxic); rows with null in either are left out. Without texts of both labels the fixed words and plain weights stand in.
    """
    labels = labels.select(key, F.col("toxic").cast("int").alias("toxic")).filter(f"{key} IS NOT NULL AND toxic IN (0, 1)")
    texts = training_texts(docs, labels, key, body, most)
    insults = learn_insults(texts)
    seen = {r.toxic for r in texts.select("toxic").distinct().collect()}
    if seen != {0, 1}:
        return insults, [1.0] * len(KINDS), -1.0
    table = stored(texts.select(features(F.col("text"), insults).alias("x"), F.col("toxic").cast("double").alias("label")), "features")
    # Equal feature rows, most of them all zero, are one row with a weight.
    table = table.groupBy("x", "label").agg(F.count("*").cast("double").alias("weight")).select(array_to_vector("x").alias("features"), "label", "weight")
    model = LogisticRegression(weightCol="weight", regParam=0.001, standardization=False, maxIter=40).fit(table.coalesce(4).cache())
    return insults, [float(x) for x in model.coefficients], float(model.intercept)


def score(text: Column, model: tuple[dict[str, float], list[float], float]) -> Column:
    """Probability between 0 and 1 that a text is toxic; a null or empty text has the one of a text without clauses."""
    insults, weights, intercept = model
    x = features(text, insults)
    total = F.aggregate(F.zip_with(x, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(intercept), lambda s, v: s + v)
    return 1 / (1 + F.exp(-total))


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", body: str = "text", most: int = 8000) -> DataFrame:
    """All columns of docs and `score`, the probability of being toxic.

    Null and empty texts get the score of a text without clauses. Rows that repeat a key are scored one by one; keys may be null.
    An existing column named score is replaced. An empty table gives an empty table. labels: (key, toxic) to learn from.
    """
    model = fit(docs, labels, key, body, most)
    return bounded(docs).withColumn("score", score(F.col(body).cast("string"), model))
