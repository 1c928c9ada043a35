"""The pipeline's stages one after the other, each against a direct computation on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontaminate import brute as tiled
from tests.llm.test_jaccard import brute as linked

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    out, docs = [spark.read.parquet(f"{FOLDER}/documents.parquet")], spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "secrets", "packing"]
    assert all(s.columns == corpus_pipeline.COLUMNS for s in steps[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, steps):
    before, after = rows(steps[0]), rows(steps[1])
    assert all(after[k] == before[k] for k in after)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    gone = set(before) - set(after)
    assert gone and not any(labels.get(k) == 0 for k in gone)
    words = {"idiot", "moron", "scum", "worthless", "pathetic", "loser", "trash", "clown", "stupid", "disgusting"}
    assert not any(words & set(r.text.lower().split()) for r in after.values())


def test_one_document_of_each_group_stays(steps):
    before, after = rows(steps[1]), rows(steps[2])
    wanted = {key for key, _, least in linked([(k, r.text) for k, r in before.items()], 5, 80) if key == least}
    assert set(after) == wanted and all(after[k] == before[k] for k in after)


def test_benchmark_documents_go(spark, steps):
    before, after = rows(steps[2]), rows(steps[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    from collections import defaultdict

    from tests.llm.test_decontaminate import words
    seeds = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 4):
            seeds[tuple(w[k:k + 5])].add(i)
    hit = set()
    for key, r in before.items():
        w = words(r.text)
        near = {i for k in range(len(w) - 4) for i in seeds.get(tuple(w[k:k + 5]), ())}
        # Long texts are cut down to the part with seeds, so that the direct tiling stays affordable.
        at = [k for k in range(len(w) - 4) if tuple(w[k:k + 5]) in seeds]
        if near and tiled([(key, " ".join(w[max(0, min(at) - 5):max(at) + 10]))], [x for x in items if x[0] in near], 5, 0.5):
            hit.add(key)
    assert hit and set(before) - set(after) == hit


def test_secrets_are_masked(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert set(before) == set(after)
    changed = [k for k in after if after[k].text != before[k].text]
    assert all("[SECRET]" in after[k].text and after[k].n_chars == len(after[k].text) for k in changed)
    assert all(after[k] == before[k] for k in after if k not in changed)


def test_everything_that_is_left_is_packed(steps):
    assert {r.doc_id for r in steps[5].select("doc_id").distinct().collect()} == set(rows(steps[4]))


def test_run_gives_the_last_stage(spark, steps):
    made = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, made.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(
        map(tuple, steps[5].select("doc_id", "start", "length", "ids_crc32").collect()))


ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c d e f g", "en", "s", 13), (4, "a b c d e f g", "en", "t", 13),
       (5, "a b c d e f g", None, "t", None), (None, "a b c d e f g", "en", "s", 13), (None, None, None, None, None), (6, "x " * 30_000, "en", "s", 60_000),
       (7, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "en", None, 50), (8, "you idiot", "en", "s", 9), (9, "same id one", "en", "s", 11),
       (9, "same id two and more", "en", "s", 20)]


def test_odd_rows_pass_through(spark, frame):
    docs = frame([(*r, "z", 1) for r in ODD], SCHEMA + ", score string, vid int")
    stages = dict(corpus_pipeline.STAGES)
    kept = {n: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in stages[n](spark, docs, FOLDER).collect())
            for n in ("toxicity", "ngram_jaccard", "decontamination", "secrets")}
    everything = sorted((k is None, k or 0, t or "") for k, t, *_ in ODD)
    assert kept["toxicity"] == [x for x in everything if x[1] != 8]
    # Rows without an id stay; of equal rows one stays; of linked rows that with the least id.
    assert kept["ngram_jaccard"] == [x for x in sorted(set(everything)) if x[1] not in (4, 5)]
    assert kept["decontamination"] == everything
    assert [x[1] for x in kept["secrets"]] == [x[1] for x in everything] and not any("04dbebab" in x[2] for x in kept["secrets"])
    assert stages["packing"](spark, docs, FOLDER).agg(F.countDistinct("doc_id")).first()[0] == 9


def test_no_documents(spark, frame):
    docs = frame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, FOLDER)
        assert made.count() == 0 and (name == "packing" or made.columns == corpus_pipeline.COLUMNS)


def test_rows_that_repeat_an_id_go_one_by_one(spark, frame):
    stages = dict(corpus_pipeline.STAGES)
    a, b, c = "one two three four five six seven", "red green blue pink grey black white", "north south east west up down left"
    left = lambda name, rows: sorted((r.doc_id, r.text) for r in stages[name](spark, frame([(*r, "en", "s", 1) for r in rows], SCHEMA), FOLDER).collect())
    assert left("ngram_jaccard", [(3, a), (3, b), (1, b), (9, a)]) == [(1, b), (3, a)]
    assert left("ngram_jaccard", [(3, a), (3, b), (5, b), (2, a), (7, c), (7, c), (7, "")]) == [(2, a), (3, b), (7, ""), (7, c)]
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    assert left("decontamination", [(3, a), (3, item), (4, item), (5, b)]) == [(3, a), (5, b)]
