import random
import re
from collections import Counter, defaultdict

import pytest

from gazette.llm import jaccard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, size, num, den=100):
    """{row: (key, set size, least key reachable)} over all pairs."""
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append(set(zip(*[w[k:] for k in range(size)])) if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    places = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            places[x].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in places[x] if j > i).items():
            if den * both >= num * (len(s) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    classes = defaultdict(list)
    for i, (key, _) in enumerate(docs):
        if key is not None:
            classes[find(i)].append(key)
    return sorted(((key, len(sets[i]), min(classes[find(i)], default=None)) for i, (key, _) in enumerate(docs)), key=repr)


def check(frame, docs, size, num):
    made = jaccard.classes(frame(docs, "doc_id bigint, text string"), size=size, num=num)
    assert sorted(map(tuple, made.collect()), key=repr) == brute(docs, size, num)


@pytest.mark.parametrize("size, num", [(3, 90), (5, 80)])
def test_small_tables_agree_with_all_pairs(spark, small, size, num):
    docs = [(r.doc_id, r.text) for r in small("documents").collect()]
    made = jaccard.classes(small("documents"), size=size, num=num)
    assert sorted(map(tuple, made.collect()), key=repr) == brute(docs, size, num)


def test_chains_of_edits_and_a_large_group(frame):
    """Near copies of all degrees around the threshold, a shared passage in everything, exact copies."""
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(100_000)}" for _ in range(n)]
    passage, base, docs = words(12), words(60), []
    for i in range(120):
        copy = list(base)
        for _ in range(r.randrange(0, 5)):
            copy[r.randrange(len(copy))] = f"e{r.randrange(10**6)}"
        docs.append((i, " ".join(copy + passage)))
    docs += [(200 + i, " ".join(words(20) + passage)) for i in range(60)]
    docs += [(300 + i, " ".join(base)) for i in range(40)]
    chain = words(50)
    for i in range(30):
        chain = chain[1:] + words(1)
        docs.append((400 + i, " ".join(chain)))
    r.shuffle(docs)
    for size, num in ((3, 90), (3, 80), (5, 80)):
        check(frame, docs, size, num)


def test_odd_rows(frame):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two"), (8, "one two"), (8, "one two"), (None, "one two"),
            (None, "alone here now"), (9, "a b c"), (9, "x y z"), (10, "É a b"), (11, "é a b"), (12, "w " * 5000), (13, "w w w w w")]
    check(frame, docs, 3, 90)


def test_empty_table_and_other_columns(frame):
    assert jaccard.classes(frame([], "doc_id bigint, text string")).count() == 0
    made = jaccard.classes(frame([(1, "a b c", 5, "v"), (2, "a b c", 6, "w")], "doc_id bigint, text string, n int, vid string"), size=3)
    assert sorted(map(tuple, made.collect())) == [(1, 1, 1), (2, 1, 1)]


def test_a_set_at_the_threshold_links(frame):
    # 9 of 10 shingles of one word are shared: exactly 90 %.
    docs = [(1, " ".join("abcdefghij")), (2, " ".join("abcdefghi")), (3, " ".join("abcdefgh"))]
    check(frame, docs, 1, 90)


def test_a_group_of_near_copies_makes_no_square(frame, monkeypatch):
    """Copies with one word changed each: about a twentieth of all pairs link, and all hang together by way of the original."""
    r, verified = random.Random(2), []
    real = jaccard._verify

    def counted(pairs, *rest):
        verified.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(jaccard, "_verify", counted)
    for original in (True, False):
        verified.clear()
        base = [f"w{r.randrange(10**6)}" for _ in range(60)]
        docs = [(9999, " ".join(base))] if original else []
        for i in range(400):
            copy = list(base)
            copy[r.randrange(60)] = f"e{i}"
            docs.append((i, " ".join(copy)))
        check(frame, docs, 5, 80)
        assert sum(verified) < 10 * len(docs) and verified[-1] < len(docs)
