import re

import numpy as np
import pyarrow as pa
import pytest

from gazette.llm import hashing
from gazette.llm.components import components

TEXTS = ["The the THE a", "", "x", None, "é É a b c d", " a\tb\nc ", "a  b", "w " * 300, "long" * 1000, "tail"]


def lowered(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("block", [7, 64, hashing.BLOCK])
def test_words_are_told_apart_in_any_block_size(block, monkeypatch):
    monkeypatch.setattr(hashing, "BLOCK", block)
    hashes, owner = hashing.words(pa.array(TEXTS))
    wanted = [(i, w) for i, t in enumerate(TEXTS) for w in lowered(t)]
    assert owner.tolist() == [i for i, _ in wanted]
    by_word = {}
    for (_, w), h in zip(wanted, hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_words_of_a_slice():
    whole, part = pa.array(TEXTS), pa.array(TEXTS).slice(4, 3)
    hashes, owner = hashing.words(whole)
    some, at = hashing.words(part)
    assert some.tolist() == hashes[(owner >= 4) & (owner < 7)].tolist() and at.tolist() == (owner[(owner >= 4) & (owner < 7)] - 4).tolist()


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_shingles_are_distinct_sets(size):
    owner, _ = hashing.shingles(pa.array(TEXTS), size)
    for i, text in enumerate(TEXTS):
        w = lowered(text)
        wanted = set(zip(*[w[k:] for k in range(size)])) if len(w) >= size else ({tuple(w)} if w else set())
        assert (owner == i).sum() == len(wanted)


def test_rolling_windows_agree_where_words_do():
    a, _ = hashing.words(pa.array(["a b c d e f a b c d"]))
    windows = hashing.rolling(a, 3)
    assert windows[0] == windows[6] and windows[1] == windows[7] and len(set(windows[:6].tolist())) == 6


def test_pieces_cover_every_text_once():
    texts = pa.array(["x" * n for n in (5, 50, 1, 0, 30)] + [None])
    pieces = list(hashing.pieces_of(texts, 40, 2))
    assert [t for _, p in pieces for t in p.to_pylist()] == texts.to_pylist() and all(len(p) <= 2 for _, p in pieces)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, k) for k in range(101, 120)] + [(7, 7), (2, 3), (3, 2), (None, 5)]
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    root = {r.node: r.root for r in rows}
    assert len(rows) == len(root) and root == {**{k: 10 for k in range(10, 41)}, **{k: 100 for k in range(100, 120)}, 2: 2, 3: 2}


def test_no_links_no_components(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_mix_spreads():
    assert len(np.unique(hashing.mix(np.arange(1000, dtype=np.uint64)) >> np.uint64(44))) > 990
