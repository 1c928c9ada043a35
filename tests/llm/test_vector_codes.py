import hashlib

import numpy as np
import pytest

from gazette.llm import vector_codes


def brute(rows, entries=16, rounds=6, parts=8):
    """{key: (code, error)} and codebooks, with all parts in one place."""
    rows = sorted(rows)
    x = np.floor(4096 * np.array([v for _, v in rows], np.float64)).astype(np.int64).reshape(len(rows), parts, -1)
    book = x[:entries].transpose(1, 0, 2).copy()

    def assigned():
        far = ((x[:, :, None, :] - book[None]) ** 2).sum(-1)
        return far.argmin(-1), far.min(-1).sum(1)

    for _ in range(rounds):
        entry, _ = assigned()
        for p in range(parts):
            for e in range(book.shape[1]):
                mine = x[entry[:, p] == e, p]
                if len(mine):
                    book[p, e] = mine.sum(0) // len(mine)
    entry, error = assigned()
    return {k: ("".join(f"{e:02x}" for e in c), int(d)) for (k, _), c, d in zip(rows, entry, error)}, book


def test_agrees_with_plain_rounds(spark, small):
    rows = [(r.vec_id, r.embedding) for r in small("embeddings").collect()]
    made, book = vector_codes.codes(small("embeddings"))
    want, wanted = brute(rows)
    assert (book == wanted).all() and {r.vec_id: (r.code, r.error) for r in made.collect()} == want
    text = ",".join(str(v) for p in wanted for e in p for v in e)
    assert vector_codes.book_digest(book) == hashlib.sha256(text.encode()).hexdigest()


def test_several_salts_and_one_hot_entry(spark, frame, monkeypatch):
    """A third of all vectors are one vector; owners hold a few members each."""
    r = np.random.default_rng(5)
    rows = [(i, [0.25] * 16 if i % 3 == 0 else r.normal(size=16).tolist()) for i in range(300)]
    monkeypatch.setattr(vector_codes, "OWNED", 300)
    monkeypatch.setattr(vector_codes, "GATHERED", 16 * 4 * 16)
    made, book = vector_codes.codes(frame(rows, "vec_id bigint, embedding array<double>").withColumn("label", frame_label()), rounds=4)
    want, wanted = brute(rows, rounds=4)
    assert (book == wanted).all() and {x.vec_id: (x.code, x.error) for x in made.collect()} == want


def frame_label():
    from pyspark.sql import functions as F

    return F.lit(None).cast("int")


def test_only_parts_that_change_their_entry_are_shuffled(spark, frame):
    r = np.random.default_rng(1)
    book = r.integers(-9, 9, (8, 4, 2))
    owners = vector_codes._Owners(spark, 4)
    rows = frame([(r.normal(size=16).tolist(),) for _ in range(50)], "v array<double>")
    sent = rows.mapInArrow(vector_codes._sent(book, 16, 1, 8), vector_codes._BLOCK)
    owners.put(sent.groupBy(*vector_codes._KEY).applyInArrow(vector_codes._gathered(2), vector_codes._OWNER))
    moved = owners.read().mapInArrow(vector_codes._leaving(book), vector_codes._BLOCK)
    after = owners.read().groupBy(*vector_codes._KEY).cogroup(moved.groupBy(*vector_codes._KEY)).applyInArrow(vector_codes._settled(book), vector_codes._OWNER)
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    # With the codebook that they were assigned by, nobody leaves.
    assert moved.count() == 0 and after.count() == owners.read().count()
    owners.drop()


def test_odd_rows(spark, frame):
    schema = "vec_id bigint, embedding array<double>, label string, code string, error int, salt int"
    tail = ("c", 1, 2)
    rows = [(1, None, "a", *tail), (2, [1.0, None], "a", *tail), (3, [float("nan")] * 2, "a", *tail), (4, [float("inf"), 0.0], "a", *tail),
            (5, [], "b", *tail), (6, [1.0], None, *tail), (7, [1.0] + [0.0] * 8, None, *tail), (7, [1.0] + [0.0] * 8, "b", *tail), (None, [1e300, -1e300], "b", *tail)]
    made, book = vector_codes.codes(frame(rows, schema))
    assert made.columns == ["vec_id", "label", "code", "error"] and book.shape == (8, 5, 2)
    got = vector_codes.with_label_error(made).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 5), (False, 6), (False, 7), (False, 7), (True, 0)]
    # Shorter vectors count as filled up with zeros, so 6 and 7 are alike; ties go to the lower index.
    code = {r.vec_id: r.code for r in got}
    assert code[6] == code[7] == "01" + "00" * 7 and all(r.error == 0 for r in got)
    assert {r.label_error for r in got} == {0}


def test_labels_with_nulls_add_up(spark, frame):
    rows = [(i, i % 4 or None, "00", i) for i in range(40)]
    got = {r.vec_id: r.label_error for r in vector_codes.with_label_error(frame(rows, "vec_id bigint, label int, code string, error bigint"), heavy=5).collect()}
    sums = {k: sum(i for i in range(40) if i % 4 == k) for k in range(4)}
    assert got == {i: sums[i % 4] for i in range(40)}


def test_empty_and_few(spark, frame):
    schema = "vec_id bigint, embedding array<float>, label int"
    made, book = vector_codes.codes(frame([], schema))
    assert vector_codes.with_label_error(made).count() == 0 and vector_codes.book_digest(book) == hashlib.sha256(b"").hexdigest()
    made, _ = vector_codes.codes(frame([(3, [], 1), (4, [], None)], schema))
    assert [(r.code, r.error) for r in made.collect()] == [("00" * 8, 0)] * 2
    with pytest.raises(ValueError):
        vector_codes.codes(frame([], schema), entries=300)


def test_large_integers_are_compared_exactly():
    rows = np.array([[vector_codes.LIMIT, -vector_codes.LIMIT] * 4], np.int32)
    book = np.array([[-vector_codes.LIMIT, vector_codes.LIMIT] * 4, [-vector_codes.LIMIT + 1, vector_codes.LIMIT] * 4], np.int64)
    entry, far = vector_codes.nearest(rows, book)
    assert entry.tolist() == [1] and far.tolist() == [4 * (2 * vector_codes.LIMIT - 1) ** 2 + 4 * (2 * vector_codes.LIMIT) ** 2]
