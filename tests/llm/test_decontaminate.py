import random
import re

import numpy as np
import pytest

from gazette.llm import decontaminate

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def naive_tiles(item, doc, seed):
    """Greedy string tiling as defined: look for the longest unmarked match, mark it, again."""
    taken, used, found = set(), set(), []
    while True:
        best = None
        for s in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while s + n < len(item) and p + n < len(doc) and item[s + n] == doc[p + n] and s + n not in taken and p + n not in used:
                    n += 1
                if n >= seed and (best is None or n > best[2]):
                    best = (s, p, n)
        if best is None:
            return sorted(found)
        found.append(best)
        taken.update(range(best[0], best[0] + best[2]))
        used.update(range(best[1], best[1] + best[2]))


def brute(docs, items, seed, least):
    out = []
    for d, text in docs:
        for i, body in items:
            a, b = words(body), words(text)
            made = naive_tiles(a, b, seed) if i is not None else []
            covered = sum(n for _, _, n in made)
            if made and covered >= least * len(a):
                out.append((d, i, len(a), covered, made))
    return sorted(out, key=repr)


def check(frame, docs, items, seed=3, least=0.5):
    made = decontaminate.matches(frame(docs, DOCS), frame(items, ITEMS), seed=seed, least=least).collect()
    got = sorted(((r.doc_id, r.item_id, r.item_words, r.covered, [tuple(t) for t in r.tiles]) for r in made), key=repr)
    assert got == brute(docs, items, seed, least)


def test_verbatim_reordered_and_partial_passages(frame):
    r = random.Random(4)
    text = lambda n: [f"w{r.randrange(500)}" for _ in range(n)]
    items = [(i, " ".join(text(30))) for i in range(6)]
    docs = []
    for i, body in items:
        w = body.split()
        docs += [(10 * i, " ".join(text(20) + w + text(20))), (10 * i + 1, " ".join(w[15:] + text(5) + w[:15])),
                 (10 * i + 2, " ".join(text(5) + w[:10] + text(5))), (10 * i + 3, " ".join(w[20:] + w[10:20] + w[:10]).upper() + "!!"),
                 (10 * i + 4, "### ".join(w) + "###"), (10 * i + 5, " ".join(text(40)))]
    check(frame, docs, items)


@pytest.mark.parametrize("seed", range(4))
def test_few_words_many_repeats(frame, seed):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    check(frame, [(i, text(r.randrange(3, 40))) for i in range(10)], [(i, text(r.randrange(3, 16))) for i in range(5)])


def test_odd_rows(frame):
    items = [(1, "one two three four five"), (2, "short"), (3, None), (4, ""), (None, "one two three four five"), (6, "É é ß 日本 ok fine")]
    docs = [(1, "One, two; THREE four-five"), (1, "one two three four five"), (None, "one two three four five"), (2, None), (3, ""), (4, "é É ß 日本 ok fine"),
            (5, "one two " * 2000), (7, "three four five one two three")]
    check(frame, docs, items)


def test_seeds_in_several_parts(frame, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_SEEDS", 1 << 16)
    r = random.Random(9)
    items = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(700))) for i in range(200)]
    docs = [(i, items[i * 7][1]) for i in range(20)]
    made = decontaminate.matches(frame(docs, DOCS), frame(items, ITEMS), seed=5)
    assert sorted((r.doc_id, r.item_id, r.covered) for r in made.collect()) == [(i, i * 7, 700) for i in range(20)]


def test_tiles_of_no_match():
    assert decontaminate.tiles(np.array([0]), np.array([0]), 5) == [(0, 0, 5)]


def test_empty_tables_and_other_columns(frame):
    assert decontaminate.matches(frame([], DOCS), frame([(1, "a b c d e f")], ITEMS)).count() == 0
    assert decontaminate.matches(frame([(1, "a b c d e f")], DOCS), frame([], ITEMS)).count() == 0
    made = decontaminate.matches(frame([(1, "a b c d e f", 9, 8)], DOCS + ", item_id int, row int"), frame([(2, "a b c d e f", 7)], ITEMS + ", doc_id int")).first()
    assert (made.doc_id, made.item_id, made.coverage) == (1, 2, 1.0)


def test_items_shorter_than_a_seed_match_as_a_whole(frame):
    items = [(1, "alpha beta"), (2, "gamma"), (3, "one two three"), (4, "a b c d e f"), (5, "alpha"), (5, "alpha beta gamma"), (6, "x y"), (6, "p q r s t u")]
    docs = [(1, "so Alpha, beta then alpha beta"), (2, "gamma gamma alpha"), (3, "one two and three"), (4, "a b c d"), (5, "alpha beta gamma"),
            (6, "one two three"), (7, "x y and no more"), (8, "p q r s t u"), (9, "a b c d e")]
    made = decontaminate.matches(frame(docs, DOCS), frame(items, ITEMS), seed=5, least=0.5).collect()
    got = sorted((r.doc_id, r.item_id, r.item_words, r.covered, [tuple(t) for t in r.tiles]) for r in made)
    assert got == [(1, 1, 2, 2, [(0, 1, 2)]), (2, 2, 1, 1, [(0, 0, 1)]), (5, 1, 2, 2, [(0, 0, 2)]), (5, 2, 1, 1, [(0, 2, 1)]), (5, 5, 3, 3, [(0, 0, 3)]),
                   (6, 3, 3, 3, [(0, 0, 3)]), (8, 6, 6, 6, [(0, 0, 6)]), (9, 4, 6, 5, [(0, 0, 5)])]
