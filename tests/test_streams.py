"""Streams: resuming, inserting once, rows with impossible times, state that is closed."""

import pytest

from gazette.streaming import ingest

SCHEMA = "k STRING, n BIGINT, ts TIMESTAMP"


@pytest.fixture
def land(spark, tmp_path):
    """Lands rows (k, n, ts) as one more file."""

    def add(*rows):
        spark.createDataFrame([(k, n, t) for k, n, t in rows], "k STRING, n BIGINT, t STRING").selectExpr(
            "k", "n", "cast(t AS timestamp) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return ingest.landed(spark, str(tmp_path / "in"), SCHEMA, per_batch=1)

    return add


def kept(spark, out, schema="k STRING, n BIGINT"):
    return sorted(tuple(r) for r in ingest.result(spark, out, schema).collect())


def test_first_arrival_is_inserted_once(spark, land, tmp_path):
    out = str(tmp_path / "out")
    land(("a", 5, "2024-01-01"), ("a", 3, "2024-01-01"), ("b", 9, "2024-01-01"))
    stream = land(("a", 1, "2024-01-02"), ("c", 7, "2024-01-02"))
    ingest.insert_new(stream.select("k", "n"), out, "k", "n")
    assert kept(spark, out) == [("a", 3), ("b", 9), ("c", 7)]
    # A run that is started again reads only what has landed since.
    stream = land(("b", 1, "2024-01-03"), ("d", 2, "2024-01-03"))
    ingest.insert_new(stream.select("k", "n"), out, "k", "n")
    assert kept(spark, out) == [("a", 3), ("b", 9), ("c", 7), ("d", 2)]


def test_a_run_that_broke_off_goes_on_without_repeats(spark, land, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    land(("a", 1, "2024-01-01"))
    stream = land(("b", 2, "2024-01-02"))
    broken = stream.selectExpr("k", "assert_true(k <> 'b') IS NULL AS fine", "n").select("k", "n", "fine")
    with pytest.raises(Exception):
        ingest.run(broken, out)
    ingest.run(stream.selectExpr("k", "true AS fine", "n").select("k", "n", "fine"), out)
    assert kept(spark, out, "k STRING, n BIGINT, fine BOOLEAN") == [("a", 1, True), ("b", 2, True)]


def test_keys_that_are_there_already_are_not_inserted(spark, land, tmp_path):
    out, present = str(tmp_path / "out"), spark.createDataFrame([("a", 1.5), (None, 2.0)], "k STRING, other DOUBLE")
    stream = land(("a", 1, "2024-01-01"), (None, 2, "2024-01-01"), ("b", 3, "2024-01-01"))
    ingest.insert_new(stream.select("k", "n"), out, "k", "n", present)
    assert kept(spark, out) == [("b", 3)]


def test_rows_without_a_key_make_one_key(spark, land, tmp_path):
    out = str(tmp_path / "out")
    land((None, 4, "2024-01-01"), (None, 2, "2024-01-01"))
    stream = land((None, 1, "2024-01-02"))
    ingest.insert_new(stream.select("k", "n"), out, "k", "n")
    assert kept(spark, out) == [(None, 2)]


def test_rows_that_cannot_count_are_set_aside(spark, land, tmp_path):
    out, args = str(tmp_path / "out"), ("ts", "2024-01-01", "2024-02-01", "2 days")
    land(("a", 1, "2024-01-01"), ("b", 2, "2999-01-01"), ("c", 3, None))
    stream = land(("d", 4, "2024-01-10"), ("e", 5, "2024-01-01"))
    ingest.triage(stream, out, *args)
    # A run that is started again knows the greatest time of the last one; a row exactly at the limit is kept.
    stream = land(("f", 6, "2024-01-08"), ("g", 7, "2024-01-07 23:59:59"), ("h", 8, "1990-01-01"))
    ingest.triage(stream, out, *args)
    rows = ingest.fates(spark, out, SCHEMA).collect()
    assert {r.k: r.fate for r in rows} == {
        "a": "kept", "b": "implausible", "c": "implausible", "d": "kept", "e": "kept", "f": "kept", "g": "late", "h": "implausible"}
    assert len(rows) == 8
    found = [tuple(r)[:4] for r in ingest.counts(spark, out).orderBy("batch").collect()]
    assert found == [(3, 1, 2, 0), (2, 2, 0, 0), (3, 1, 1, 1)]
    ingest.run(ingest.kept(spark, out, SCHEMA).select("k", "n"), str(tmp_path / "good"))
    assert kept(spark, str(tmp_path / "good")) == [("a", 1), ("d", 4), ("e", 5), ("f", 6)]


def test_nothing_landed_and_nothing_kept(spark, land, tmp_path):
    out = str(tmp_path / "out")
    ingest.triage(land(("a", 1, None)), out, "ts", "2024-01-01", "2024-02-01", "2 days")
    ingest.triage(land(("b", 2, "2024-01-05")), out, "ts", "2024-01-01", "2024-02-01", "2 days")
    assert [(r.kept, r.mark is None) for r in ingest.counts(spark, out).orderBy("batch").collect()] == [(0, True), (1, False)]


def test_late_rows_no_longer_count(spark, land, tmp_path):
    out = str(tmp_path / "out")
    for rows in ([("a", 1, "2024-01-01")], [("a", 2, "2024-01-10")], [("a", 5, "2024-01-10")], [("a", 3, "2024-01-01"), ("a", 4, "2024-01-09 12:00:00")]):
        stream = land(*rows)
    ingest.run(ingest.window_counts(stream, "ts", ["k"], "1 day", "1 day"), out, mode="update")
    rows = ingest.latest(spark, out, "start TIMESTAMP, k STRING, n BIGINT", ["start", "k"], ["n"])
    # The row of 1 January that comes after the 10th is too late; the one of the 9th is not.
    assert sorted((str(r.start)[:10], r.n) for r in rows.collect()) == [("2024-01-01", 1), ("2024-01-09", 1), ("2024-01-10", 2)]
