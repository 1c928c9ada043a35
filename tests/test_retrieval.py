"""The kept text index: scores against a plain computation, what a query reads, tables without rows."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gazette.operators import retrieval

TEXTS = {i: " ".join(["common"] * (i % 3 + 1) + [f"term{i % 7}", f"other{i}", f"rare{i % 29}"]) for i in range(60)} | {60: "", 61: None}


@pytest.fixture
def index(spark, tmp_path):
    def build(texts, **how):
        docs = spark.createDataFrame(list(texts.items()), "id INT, body STRING")
        return retrieval.open_index(spark, retrieval.build_index(docs, "id", "body", str(tmp_path / "index"), **how))

    return build


def asked(spark, *texts):
    return retrieval.query_terms(spark.createDataFrame([(t,) for t in texts], "t STRING"), "t")


def plain(texts, query):
    """Cosines with the query as one more document."""
    words = {k: Counter((t or "").split()) for k, t in texts.items()}
    q = Counter(query.split())
    rows = Counter(w for c in [*words.values(), q] for w in c)
    idf = {w: math.log((len(words) + 2) / (n + 1)) + 1 for w, n in rows.items()}
    vector = lambda c: {w: n / sum(c.values()) * idf[w] for w, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    b = vector(q)
    out = {}
    for k, c in words.items():
        a = vector(c)
        if set(a) & set(b):
            out[k] = sum(a[w] * b[w] for w in set(a) & set(b)) / norm(a) / norm(b)
    return out


@pytest.mark.parametrize("size", [5, 20_000_000])
def test_scores_are_those_of_a_plain_computation(spark, index, size):
    query = "common term3 absent rare5 rare5"
    found = {r.id: r.score for r in retrieval.cosine_to_query(index(TEXTS, rows_a_part=size), asked(spark, *query.split(" ", 2))).collect()}
    assert found == pytest.approx(plain(TEXTS, query))


def test_a_kept_index_answers_many_queries(spark, index):
    kept = index(TEXTS)
    for query in ("term1", "other7 rare3", "absent"):
        assert {r.id: r.score for r in retrieval.cosine_to_query(kept, asked(spark, query)).collect()} == pytest.approx(plain(TEXTS, query))


def test_a_query_reads_its_own_parts_only(spark, index):
    kept = index(TEXTS, rows_a_part=2)
    assert kept.parts > 50
    found = retrieval.cosine_to_query(kept, asked(spark, "term3"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    mine = kept.terms.filter("term = 'term3'").select(F.pmod(F.xxhash64("term"), F.lit(kept.parts)).alias("p")).first().p
    assert any(f"= {mine})" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])


def test_weights_of_all_terms(spark, index):
    found = retrieval.weights(index(TEXTS), asked(spark, "common"))
    assert found.count() == sum(len(set((t or "").split())) for t in TEXTS.values())
    assert {r.term for r in found.filter("query_weight IS NOT NULL").collect()} == {"common"}


def test_no_documents_and_no_query(spark, index):
    empty = index({})
    assert empty.total == 0 and retrieval.cosine_to_query(empty, asked(spark, "word")).count() == 0


def test_a_query_without_words(spark, index):
    assert retrieval.cosine_to_query(index(TEXTS), asked(spark, " ", None)).count() == 0


def test_a_folder_without_sizes_is_no_index(spark, tmp_path):
    with pytest.raises(Exception):
        retrieval.open_index(spark, str(tmp_path / "nothing"))


def test_words_are_counted_inside_their_row(spark):
    docs = spark.createDataFrame([(1, "bb aa bb cc"), (2, ""), (3, None)], "id INT, body STRING")
    found = {r.id: (r.length, [tuple(w) for w in r.words]) for r in retrieval.document_terms(docs, "id", "body").collect()}
    assert found == {1: (4, [("aa", 1), ("bb", 2), ("cc", 1)]), 2: (0, []), 3: (0, [])}


def test_weights_of_common_terms_are_not_shuffled(spark, index):
    found = retrieval.weights(index(TEXTS), asked(spark, "common"))
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("common", [1, 3, 10])
def test_rare_and_common_terms_have_the_same_weights(spark, index, monkeypatch, common):
    query = "common term3 absent rare5 rare5"
    weigh = lambda kept: {(r.id, r.term): r.weight for r in retrieval.weights(kept, asked(spark, query)).collect()}
    usual = weigh(index(TEXTS))
    monkeypatch.setattr(retrieval, "COMMON", common)
    kept = index(TEXTS, rows_a_part=20, rows_a_task=15)
    assert weigh(kept) == pytest.approx(usual)
    found = {r.id: r.score for r in retrieval.cosine_to_query(kept, asked(spark, query)).collect()}
    assert found == pytest.approx(plain(TEXTS, query))


def test_rows_of_one_key_are_one_document(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aa bb"), (1, "bb cc"), (2, "aa")], "id INT, body STRING")
    kept = retrieval.open_index(spark, retrieval.build_index(docs, "id", "body", str(tmp_path / "twice")))
    assert {(r.id, r.term): r.tf for r in kept.postings.collect()} == {(1, "aa"): 0.25, (1, "bb"): 0.5, (1, "cc"): 0.25, (2, "aa"): 1.0}
