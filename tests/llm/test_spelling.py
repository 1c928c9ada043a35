import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from gazette.llm import spelling
from gazette.llm.queries import QUERIES, SQL

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def counted(docs, shortest=5, least=3):
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= shortest:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least}


def near(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(n):
    """{word: (n, n_near, form, form_n, root)} by comparing all pairs."""
    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (n[w], len(around[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n}


def result(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.mark.parametrize("letters, longest", [("ab", 7), ("abcé", 6), ("aeioustrn", 4)])
def test_all_pairs_of_close_words(frame, letters, longest):
    """Few letters, so that words share multisets, halves and whole groups of signatures."""
    r = random.Random(len(letters))
    words = {"".join(r.choice(letters) for _ in range(r.randrange(1, longest + 1))) for _ in range(250)}
    n = {w: r.choice([3, 3, 4, 6, 8, 20, 41, 100]) for w in words}
    made = spelling.variants(frame(list(n.items()), "word string, n bigint"))
    assert made.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert result(made) == brute(n)


def test_every_pair_is_made_once(frame):
    words = ["abcde", "abcdee", "bbcde", "aabcde", "edcba", "abcdf", "abced"]
    got = [(r.a, r.b) for r in spelling.near_pairs(frame([(w, 1) for w in words], "word string, n bigint")).collect()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if a < b and near(a, b))


def test_long_chain_of_forms(frame):
    word, n = "a" * 5, {}
    for k in range(20):
        n[word] = 3 << k
        word = word + chr(ord("b") + k % 20)
    assert result(spelling.variants(frame(list(n.items()), "word string, n bigint"))) == brute(n)


def test_words_of_documents(spark, small):
    docs = [(r.doc_id, r.text) for r in small("documents").collect()]
    assert {r.word: r.n for r in spelling.words(small("documents")).collect()} == counted(docs)


def test_the_query_agrees_with_its_sql(spark, small):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    made = QUERIES["op13_partenum_spelling"](spark, "/root/testdata/sf0.001")
    want = con.execute(f"SELECT word, n, n_near, form, form_n, root FROM ({SQL['op13_partenum_spelling']})").fetchall()
    assert sorted(map(tuple, made.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=repr) == sorted(want, key=repr)


def test_odd_rows(frame):
    long_ = "Wörterbuch " * 20_000
    docs = [(1, None), (None, "Colour colour COLOUR"), (2, ""), (3, "12345 _ -"), (4, long_), (4, long_), (5, "ÉCOLES école×école école"), (6, "x" * 30_000 + " " + "x" * 30_000), (7, "x" * 30_000)]
    made = spelling.words(frame([(*d, 1, "w") for d in docs], "doc_id bigint, text string, n int, word string"))
    assert {r.word: r.n for r in made.collect()} == counted(docs)


def test_empty_table_and_null_words(frame):
    assert spelling.variants(spelling.words(frame([], "doc_id bigint, text string"))).count() == 0
    made = result(spelling.variants(frame([(None, 4), ("abcde", 4), ("abcdef", 8)], "word string, n bigint")))
    assert made["abcde"] == (4, 1, "abcdef", 8, "abcdef") and made[None] == (4, 0, None, None, None)
