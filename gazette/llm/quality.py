"""Document quality by a sparse ensemble of rules over text statistics.

Shallow trees are grown on labelled documents; every path from a root is a rule, a conjunction of conditions on
statistics. A logistic regression with lasso penalty weighs the rules and drops most. What is left is compiled into one
column expression over the statistics, so documents are scored inside Spark's own code.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm import hashing
from gazette.llm.batches import bounded
from gazette.session import stored

# The characters that count as each kind of sign.
SIGNS = {"symbols": "#$%&*^~<>@\\=+_", "bars": "|", "shouts": "!", "stops": ".", "commas": ",;:", "digits": "0123456789",
         "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lines": "\n", "brackets": "()[]{}", "quotes": "\"'"}
STATISTICS = ["bytes", "words", "word_length", "repeated", "distinct", *SIGNS, "accents"]

Rule = tuple[tuple[int, bool, float], ...]


def _statistics(texts: pa.Array) -> np.ndarray:
    """Statistics of every text. Signs are shares of bytes; `repeated` is the share of words equal to the one before."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    size = np.diff(bounds)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0]:bounds[-1]] if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    cuts = bounds - bounds[0]
    share = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[cuts]) / np.maximum(size, 1)
    hashes, owner = hashing.words(texts)
    words = np.bincount(owner, minlength=len(texts))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    repeated = np.bincount(owner, same, minlength=len(texts)) / np.maximum(words, 1)
    single, _ = hashing.shingles(texts, 1)
    distinct = np.bincount(single, minlength=len(texts)) / np.maximum(words, 1)
    space = share(hashing.spaces()[data]) * size
    columns = [np.log1p(size), np.log1p(words), (size - space) / np.maximum(words, 1), repeated, distinct]
    for signs in SIGNS.values():
        table = np.zeros(256, bool)
        table[list(signs.encode())] = True
        columns.append(share(table[data]))
    columns.append(share(data >= 128))
    return np.column_stack(columns)


def statistics(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, x): the statistics of every text as an array; those of an empty text for null."""

    def run(batches):
        for batch in batches:
            for at, texts in hashing.pieces_of(batch.column(1).fill_null("")):
                x = _statistics(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())], ["k", "x"])

    return bounded(docs).select(F.col(key).cast("bigint"), F.col(body).cast("string")).mapInArrow(run, "k bigint, x array<double>").withColumnRenamed("k", key)


def paths(forest) -> list[Rule]:
    """The paths of all trees, from a root to every node below it, as rules of (statistic, above, limit)."""
    rules = set()
    for tree in forest.trees:
        open_ = [(tree._call_java("rootNode"), ())]
        while open_:
            node, rule = open_.pop()
            if rule:
                rules.add(_tight(rule))
            if node.getClass().getSimpleName() == "InternalNode":
                at, limit = node.split().featureIndex(), node.split().threshold()
                open_ += [(node.leftChild(), (*rule, (at, False, limit))), (node.rightChild(), (*rule, (at, True, limit)))]
    return sorted(rules)


def _tight(rule: Rule) -> Rule:
    """Conditions on one statistic and side shrink to the strictest."""
    best: dict[tuple[int, bool], float] = {}
    for at, above, limit in rule:
        have = best.get((at, above))
        best[at, above] = limit if have is None else (max if above else min)(have, limit)
    return tuple(sorted((at, above, limit) for (at, above), limit in best.items()))


def holds(rule: Rule, x: Column) -> Column:
    """A rule as a column: every condition holds."""
    out = None
    for at, above, limit in rule:
        one = x[at] > F.lit(limit) if above else x[at] <= F.lit(limit)
        out = one if out is None else out & one
    return out


def chosen(labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """About `most` labelled keys at most, by a hash of the key."""
    labels = labels.select(key, F.col(label).cast("int").alias("label")).filter(f"{key} IS NOT NULL AND label IN (0, 1)")
    share = min(1.0, most / max(labels.count(), 1))
    return labels.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share * (1 << 30)).groupBy(key).agg(F.max("label").alias("label"))


def fit(x: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", most: int = 20_000, trees: int = 24,
        depth: int = 3, penalty: float = 0.002) -> tuple[list[tuple[Rule, float]], float]:
    """(rules with weights, intercept) from statistics and at most about `most` labelled keys. One label only gives no rule and an
    intercept for it; no label gives even odds."""
    table = stored(x.join(F.broadcast(chosen(labels, key, label, most)), key).select("x", F.col("label").cast("double").alias("label")), "labelled").coalesce(4)
    counts = {r.label: r.n for r in table.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return [], {0.0: -4.0, 1.0: 4.0}.get(next(iter(counts), None), 0.0)
    grown = table.select(array_to_vector("x").alias("features"), "label").cache()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, subsamplingRate=0.8,
                                    featureSubsetStrategy="0.5", seed=11).fit(grown)
    rules = paths(forest)
    flags = F.array(*[holds(r, F.col("x")).cast("double") for r in rules])
    # Documents that agree in all rules are one row with a weight.
    ruled = table.select(flags.alias("f"), "label").groupBy("f", "label").agg(F.count("*").cast("double").alias("weight"))
    ruled = ruled.select(array_to_vector("f").alias("features"), "label", "weight").coalesce(4).cache()
    model = LogisticRegression(weightCol="weight", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(ruled)
    grown.unpersist()
    ruled.unpersist()
    kept = [(r, float(w)) for r, w in zip(rules, model.coefficients) if w]
    return kept, float(model.intercept)


def compiled(model: tuple[list[tuple[Rule, float]], float], x: Column) -> Column:
    """The probability of label 1 as one expression over the statistics."""
    rules, intercept = model
    total = F.lit(intercept)
    for rule, weight in rules:
        total = total + F.when(holds(rule, x), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", body: str = "text", label: str = "quality", most: int = 20_000) -> DataFrame:
    """(key, score) of every row of docs; score is the probability of label 1.

    Null texts count as empty, and empty texts are scored by their statistics, which are zeros. Rows that repeat a key are scored one
    by one, null keys are kept and never learned from. Of a key with both labels the greater holds. Other columns are not read. An empty
    table gives an empty table.
    """
    x = stored(statistics(docs, key, body), "statistics")
    model = fit(x, labels, key, label, most)
    return x.select(key, compiled(model, F.col("x")).alias("score"))
