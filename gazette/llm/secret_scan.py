"""Secrets in texts: patterns find candidates, a random forest takes out those that only look like secrets.

The forest is trained on labelled findings by Spark and read off into arrays, so that a text is scanned, judged and, where
wanted, redacted in one pass and without a shuffle.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import findings
from gazette.llm.batches import bounded, release

# Patterns of candidates, and words that speak for or against a secret.
LONG = re.compile(r"[A-Za-z0-9_+/~-]{16,}(?:\.[A-Za-z0-9_+/~-]{16,})*={0,2}")
ASSIGNED = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,3}(?::=|=|:)\s{0,3}[\"']?([^\s\"'<>{}()\[\],;]{8,})")
#: A name inside a value.
INNER = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)(?::=|=|:)")
PEM = re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?")
#: A text without any of this has no candidate.
_PRE = r"(?i)[0-9]|passw|pwd|secret|token|api[_-]?key|access[_-]?key|auth|BEGIN [A-Z ]*PRIVATE"
SPEAKS_FOR = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private_key", "key")
SPEAKS_AGAINST = ("sha", "md5", "commit", "checksum", "digest", "hash", "uuid", "guid", "etag", "integrity", "version", "card", "phone", "build", "image", "example",
                  "session", "order", "href", "id")
PATHS_FOR = ("env", "config", "settings", "conf", "prod", "deploy", "secret", "credential", "terraform")
PATHS_AGAINST = ("test", "fixture", "example", "sample", "doc", "readme", "lock", "sum", "asset", "data", "vendor")
KNOWN = ("AKIA", "ghp_", "gho_", "sk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "-----BEGIN")
PLACEHOLDERS = ("example", "your", "xxxx", "0000", "1234", "abcd", "changeme", "placeholder", "sample", "dummy")
COMMON_PAIRS = ("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be "
                "ma si om ur").split()

FEATURES = ["length", "entropy", "class_changes", "letter_pairs", "longest_run", "digits", "upper", "hex_only", "known", "dictionary", "placeholder",
            "assigned", "quoted", "speaks_for", "speaks_against", "nearest", "path_for", "path_against"]
#: Characters of the neighbourhood that are looked at.
NEAR = 40

_dictionary = sorted((w for w in findings.WORDS if len(w) > 3), key=lambda w: (-len(w), w))
_words = re.compile("|".join(_dictionary))


def _classes(text: str) -> list[int]:
    return [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in text]


def measures(candidate: str, before: str, after: str, path: str) -> list[float]:
    """Features of a finding from the candidate, the words around it and the path."""
    n, lower = len(candidate), candidate.lower()
    kinds = _classes(candidate)
    counts = np.unique(list(candidate), return_counts=True)[1] / n
    pairs = [lower[k:k + 2] for k in range(n - 1) if lower[k:k + 2].isalpha()]
    run = best = 1
    for a, b in zip(candidate, candidate[1:]):
        run = run + 1 if a == b else 1
        best = max(best, run)
    near, place = before.lower()[-NEAR:], path.lower()
    nearest = max([near.rfind(w) for w in SPEAKS_FOR]) - max([near.rfind(w) for w in SPEAKS_AGAINST])
    lead = near.rstrip("\"' ")
    covered = sum(len(m) for m in _words.findall(lower))
    return [math.log(n), -float((counts * np.log2(counts)).sum()), sum(a != b for a, b in zip(kinds, kinds[1:])) / max(n - 1, 1),
            sum(p in COMMON_PAIRS for p in pairs) / max(len(pairs), 1), best / n, kinds.count(2) / n, kinds.count(1) / n,
            float(set(lower) <= set("0123456789abcdef")), float(candidate.startswith(KNOWN)), covered / n, float(any(p in lower for p in PLACEHOLDERS)),
            float(lead[-1:] in ("=", ":")), float(near[-1:] in ("'", '"') and after[:1] in ("'", '"')), float(sum(w in near for w in SPEAKS_FOR)),
            float(sum(w in near for w in SPEAKS_AGAINST)), float(np.sign(nearest)), float(any(w in place for w in PATHS_FOR)),
            float(any(w in place for w in PATHS_AGAINST))]


def _found(text: str) -> list[tuple[int, int, str]]:
    """(start, -stop, kind) of every candidate, in order; candidates may overlap, no place comes twice."""
    found = [(m.start(), -m.end(), "private_key") for m in PEM.finditer(text)]
    for m in ASSIGNED.finditer(text):
        found.append((m.start(1), -m.end(1), "assigned"))
        # Names inside a value, as in the query of an address, have values of their own, each up to the next name.
        inner = list(INNER.finditer(text, *m.span(1)))
        for name, after in zip(inner, [*[x.start() for x in inner[1:]], m.end(1)]):
            if after - name.end() >= 8:
                found.append((name.end(), -after, "assigned"))
    for m in LONG.finditer(text):
        word = m.group()
        if any(c.isdigit() for c in word) and any(c.isalpha() for c in word):
            found.append((m.start(), -m.end(), "string"))
    places: dict[tuple[int, int], str] = {}
    for start, stop, kind in sorted(found):
        places.setdefault((start, stop), kind)
    return [(start, stop, kind) for (start, stop), kind in places.items()]


def candidates(text: str):
    """(start, stop, kind) of candidates in order and without overlap; where two begin together the longer counts."""
    end = 0
    for start, stop, kind in _found(text):
        if start >= end:
            end = -stop
            yield start, end, kind


class Forest:
    """Trees as arrays; gives the mean share of label 1 in the leaves that rows of features reach."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for at, limit, left, right, share in self.trees:
            node = np.zeros(len(x), int)
            while (inner := at[node] >= 0).any():
                go = x[np.arange(len(x)), np.maximum(at[node], 0)] <= limit[node]
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            total += share[node]
        return total / max(len(self.trees), 1)


def _arrays(tree) -> tuple[np.ndarray, ...]:
    rows, open_ = [], [(tree._call_java("rootNode"), -1, 0)]
    while open_:
        node, parent, side = open_.pop()
        me = len(rows)
        if parent >= 0:
            rows[parent][2 + side] = me
        inner = node.getClass().getSimpleName() == "InternalNode"
        stats = list(node.impurityStats().stats())
        rows.append([node.split().featureIndex() if inner else -1, node.split().threshold() if inner else 0.0, 0, 0, stats[1] / max(sum(stats), 1e-9)])
        if inner:
            open_ += [(node.leftChild(), me, 0), (node.rightChild(), me, 1)]
    table = np.array(rows, dtype=float)
    return table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]


def train(spark: SparkSession, rows: list[tuple[str, str, str, str, int]] | None = None, trees: int = 30, depth: int = 8) -> Forest:
    """A forest from labelled findings (candidate, before, after, path, label), a list that its maker bounds."""
    rows = findings.labelled() if rows is None else rows
    table = pd.DataFrame({"x": [measures(*r[:4]) for r in rows], "label": [float(r[4]) for r in rows]})
    data = spark.createDataFrame(table).select(array_to_vector("x").alias("features"), "label").coalesce(2).cache()
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=5).fit(data)
    data.unpersist()
    return Forest([_arrays(t) for t in model.trees])


def _judged(texts: pa.Array, paths: list, forest: Forest, least: float):
    """(index of the text, start, stop, kind, score) of all kept findings of the texts, in order.

    Every candidate is judged; of those that are kept, one that lies within another is left out.
    """
    at = np.flatnonzero(np.asarray(pc.match_substring_regex(texts.fill_null(""), _PRE).cast(pa.int8())))
    spots, rows = [], []
    for i in at.tolist():
        text = texts[i].as_py()
        for start, stop, kind in _found(text):
            stop = -stop
            spots.append((i, start, stop, kind))
            rows.append(measures(text[start:stop], text[max(0, start - NEAR):start], text[stop:stop + NEAR], paths[i] or ""))
    if not rows:
        return
    reach = (-1, 0)
    for spot, score in zip(spots, forest(np.array(rows))):
        if score >= least and (spot[0], spot[2]) > reach:
            reach = (spot[0], spot[2])
            yield *spot, float(score)


def scan(docs: DataFrame, forest: Forest, key: str = "doc_id", body: str = "text", path: str | None = None, least: float = 0.5) -> DataFrame:
    """(key, start, length, kind, secret, score) of every candidate that the forest holds for a secret; places in code points.

    path: a column with the place of the text, or None. Null and empty texts have no finding, null paths are empty. Rows that
    repeat a key are scanned one by one and null keys are kept. Equal findings come as often as they stand. Other columns are
    not read. An empty table gives an empty table.
    """

    def run(batches):
        names = ["k", "start", "length", "kind", "secret", "score"]
        for batch in batches:
            texts, paths, keys = batch.column(1), batch.column(2).to_pylist(), batch.column(0)
            rows = [(keys[i].as_py(), a, b - a, kind, texts[i].as_py()[a:b], score) for i, a, b, kind, score in _judged(texts, paths, forest, least)]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()))], names)

    place = F.lit("") if path is None else F.col(path).cast("string")
    made = bounded(docs).select(F.col(key).cast("bigint"), F.col(body).cast("string"), place).mapInArrow(
        run, "k bigint, start bigint, length bigint, kind string, secret string, score double")
    return made.withColumnRenamed("k", key)


def redacted(body: Column, path: Column, forest: Forest, mark: str = "[SECRET]", least: float = 0.5) -> Column:
    """The text with every secret replaced by a mark; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, paths: pd.Series) -> pd.Series:
        out = texts.tolist()
        cuts: dict[int, list] = {}
        for i, start, stop, _, _ in _judged(pa.array(out, pa.string()), paths.tolist(), forest, least):
            spots = cuts.setdefault(i, [])
            if spots and start < spots[-1][1]:
                start = spots.pop()[0]
            spots.append((start, stop))
        for i, spots in cuts.items():
            text = out[i]
            for start, stop in reversed(spots):
                text = text[:start] + mark + text[stop:]
            out[i] = text
        release()
        return pd.Series(out)

    return run(body, path)
