"""Boundaries of the operators on small frames."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazette.operators import audit, curation, geography, heat, joins, portfolio, ranking, retrieval, runs, verdicts, versions
from gazette.session import folders
from gazette.sources import annotations, tables
from tests.conftest import make_record

TODAY = "2026-05-26"


def test_record_on_the_boundary_counts_in_both_windows(records):
    rows = records(make_record(pub_date="2026-02-25", urgency=5.0))
    got = geography.pressure_delta(rows, TODAY).first()
    assert (got.current_count, got.current_pressure, got.prior_pressure, got.delta) == (1, 1.0, 1.0, 0.0)


def test_weekly_buckets_leave_out_the_horizon(records):
    rows = records(make_record(record_id="a", pub_date="2026-05-26"), make_record(record_id="b", pub_date="2026-05-13"),
                   make_record(record_id="c", pub_date="2026-05-12"))
    got = geography.weekly_buckets(rows, TODAY, weeks=2).orderBy("week").collect()
    assert [(r.week, r.n) for r in got] == [(0, 1), (1, 1)]


@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 40), min_size=1))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_every_prefix_stays_near_the_shares(spark, sizes):
    rows = [(f"{k}{i}", k) for k, n in sizes.items() for i in range(n)]
    total, seen = len(rows), dict.fromkeys(sizes, 0)
    got = curation.stratified_prefix(spark.createDataFrame(rows, "id STRING, s STRING"), "id", "s", total).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, total + 1)) and sorted((r.id, r.s) for r in got) == sorted(rows)
    for i, r in enumerate(got, 1):
        seen[r.s] += 1
        # Each stratum is within one of its share at a common point of the order, and so is the prefix up to the number of strata.
        assert all(abs(i * sizes[k] / total - seen[k]) < 1 + len(sizes) * sizes[k] / total for k in sizes)


def test_a_large_stratum_is_ranked_in_slices(spark, monkeypatch):
    rows = spark.range(500).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 400, "x").otherwise("y").alias("s"))
    whole = curation.stratified_prefix(rows, "id", "s", 200).collect()
    monkeypatch.setattr(curation, "RANKED_TOGETHER", 30)
    assert curation.stratified_prefix(rows, "id", "s", 200).collect() == whole


def test_stratified_prefix_is_stable_and_a_permutation(spark):
    rows = spark.range(60).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("s"))
    one, two = (sorted((r.position, r.id) for r in curation.stratified_prefix(df, "id", "s", 60).collect())
                for df in (rows, rows.repartition(7)))
    assert one == two and sorted(r[1] for r in one) == sorted(str(i) for i in range(60))


@pytest.mark.parametrize("target, cap, kept, reason", [(2, 10, 4, "target_reached"), (9, 5, 5, "sweep_cap"), (9, 50, 8, "pool_exhausted")])
def test_sweep_stops(spark, target, cap, kept, reason):
    flags = [False, True, False, True, False, True, False, False]
    df = spark.createDataFrame(list(enumerate(flags)), "i INT, survivor BOOLEAN")
    got = curation.sweep(df, [F.col("i")], target, cap).collect()
    assert len(got) == kept and {r.stop_reason for r in got} == {reason}


def test_verdicts(spark):
    entry = lambda i, c, v="violation": {"obligation_id": i, "verdict": v, "confidence": c, "applies_to_draft": True, "omission_material": True}
    reply = json.dumps({"verdicts": [entry("a", 0.8), entry("a", 0.1, "compliant"), entry("b", 1.2), entry("b", 0.5), entry("c", True),
                                     entry("d", "0.9"), entry("x", 0.5), entry("e", 1)]})
    rows = spark.createDataFrame([(1, reply, list("edcbaf")), (2, "not json", ["a"])], "id INT, response STRING, requested ARRAY<STRING>")
    got = [(r.id, r.obligation_id, r.verdict, r.confidence, r.state) for r in verdicts.validate_verdicts(rows).orderBy("id", "position").collect()]
    unsure = lambda i, s: (1, i, "uncertain", 0.0, s)
    assert got == [(1, "e", "violation", 1.0, "given"), unsure("d", "discarded"), unsure("c", "discarded"), unsure("b", "discarded"),
                   (1, "a", "violation", 0.8, "given"), unsure("f", "omitted"), (2, "a", "uncertain", 0.0, "omitted")]


def test_must_pass_failure_zeroes_a_run(spark):
    rows = [(1, True, True), (1, False, False), (2, False, True), (2, True, False), (3, None, True), (4, True, False), (4, None, True)]
    got = {r.run_id: r.accuracy for r in runs.run_accuracy(spark.createDataFrame(rows, "run_id INT, pass BOOLEAN, must_pass BOOLEAN")).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: None, 4: 1.0}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=30))
def test_pareto_equals_all_pairs(points):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(i, float(c), float(a)) for i, (c, a) in enumerate(points)], "id INT, cost DOUBLE, accuracy DOUBLE")
    got = {r.id: r.on_frontier for r in runs.pareto(df).collect()}
    beaten = lambda p: any(q[0] <= p[0] and q[1] >= p[1] and q != p for q in points)
    assert got == {i: not beaten(p) for i, p in enumerate(points)}


def test_narrowing_ranks_by_overlap_urgency_and_date(spark):
    schema = "record_id STRING, country STRING, bloc STRING, industry ARRAY<STRING>, functions ARRAY<STRING>, compliance_date STRING"
    rows = [("far", "US", "", ["Bank"], [], "2027-05-01"), ("near", "US", "", ["bank"], [], "2026-06-01"), ("past", "US", "", ["BANK"], [], "2020-01-01"),
            ("both", "US", "", ["Bank"], ["Legal"], ""), ("odd", "US", "", ["Bank"], [], "Q3 2026"), ("none", "US", "", ["Farm"], [], "2026-06-01"),
            ("abroad", "FR", "EU", ["Bank"], [], "2026-06-01"), ("late", "US", "", ["Bank"], [], "")]
    firm = spark.createDataFrame([("p", "US", None, ["bank"], "bank", ["legal"])],
                                 "profile_id STRING, country STRING, bloc STRING, industry ARRAY<STRING>, sector STRING, functions ARRAY<STRING>")
    got = curation.narrow(firm, spark.createDataFrame(rows, schema), TODAY).orderBy("position").collect()
    assert [r.record_id for r in got] == ["past", "near", "far", "both", "odd"]


def test_narrowing_keeps_all_of_a_crowded_class_that_may_win(spark):
    schema = "record_id STRING, country STRING, bloc STRING, industry ARRAY<STRING>, functions ARRAY<STRING>, compliance_date STRING"
    rows = [(f"r{i:03d}", "US", "", ["Bank"], [], f"2026-06-{i % 28 + 1:02d}") for i in range(200)]
    firm = spark.createDataFrame([("p", "US", "", ["bank"], "bank", [])],
                                 "profile_id STRING, country STRING, bloc STRING, industry ARRAY<STRING>, sector STRING, functions ARRAY<STRING>")
    got = curation.narrow(firm, spark.createDataFrame(rows, schema), TODAY).orderBy("position").collect()
    assert [r.record_id for r in got] == [r[0] for r in sorted(rows, key=lambda r: (r[5], r[0]))[:5]]


def test_section_changes(spark):
    section = lambda *rows: spark.createDataFrame(list(rows), "section_id STRING, title STRING, markdown STRING")
    old = section(("1.1", "Intro", "same"), ("2.1", "Terms", "180 days"), ("10.1", "Gone", "x"))
    new = section(("1.1", "Intro", "same"), ("2.1", "Terms", "120 days"), ("3.1", "New", "y"))
    got = {r.section_id: r for r in versions.with_texts(versions.section_changes(old, new), old, new).collect()}
    assert {k: (v.kind, v.before, v.after, v.family) for k, v in got.items()} == {
        "2.1": ("modified", "180 days", "120 days", 2), "3.1": ("added", "", "y", 3), "10.1": ("removed", "x", "", 10)}


def test_versions_keep_the_first_of_each_digest(spark):
    rows = [("p", "d1", "2", "200", "text/html"), ("p", "d1", "1", "200", "text/html"), ("p", "d2", "3", "404", "text/html"),
            ("p", "d3", "4", "200", "warc/revisit")]
    df = spark.createDataFrame(rows, "page STRING, digest STRING, ts STRING, status STRING, mimetype STRING")
    assert [(r.digest, r.ts) for r in versions.dedupe_versions(df, "page").collect()] == [("d1", "1")]


def test_domain_query_bounds_and_nulls(spark):
    schema = "record_id STRING, seq INT, pub_date STRING, impact_score DOUBLE, update_type STRING, regulator STRING, title STRING, " \
             "what_changed STRING, why_it_matters STRING, tags ARRAY<STRING>"
    rows = [("a", 1, "2026-01-01", 5.0, "Rule", "SEC", "t", "", "", ["Crypto"]), ("b", 2, "2026-01-02", None, "Rule", "", "t", "", "", []),
            ("c", 3, "2026-01-03", 9.0, "other", "FCC", "t", "", "", [])]
    df = spark.createDataFrame(rows, schema)
    ask = lambda **k: [r.record_id for r in df.filter(ranking.DomainQuery(**k).condition()).orderBy("seq").collect()]
    assert ask(date_from="2026-01-01", date_to="2026-01-02") == ["a", "b"]
    assert ask(min_impact=5.0) == ["a", "c"] and ask(min_impact=0.0) == ["a", "c"]
    assert ask(keyword="crypto") == ["a"] and ask(update_type="rule") == ["a", "b"]
    page = ranking.DomainQuery(order_by="impact", limit=0).page(df).collect()
    assert [(r.record_id, r.matches) for r in page] == [("c", 3)]
    groups = ranking.DomainQuery(group_by="regulator").groups(df).collect()
    assert [(r.key, r.n, r.max_impact) for r in groups] == [("(unknown)", 1, None), ("FCC", 1, 9.0), ("SEC", 1, 5.0)]


def test_name_lookup_returns_only_the_best_tier(spark):
    topics = spark.createDataFrame([(1, "Securities Commission", "SEC"), (2, "SEC Watch", ""), (3, "Bank", "BK")], "topic_id INT, name STRING, acronym STRING")
    ask = lambda q: sorted(r.topic_id for r in retrieval.resolve_name(topics, q).collect())
    assert (ask("sec"), ask("sec "), ask("securities"), ask("watch"), ask("the bank of x"), ask(""), ask("zzz")) == ([1], [1], [1], [2], [3], [], [])


def test_first_occurrence_claims_its_id(records):
    rows = records(make_record(record_id="x", seq=1, relevance=1.0), make_record(record_id="x", seq=2, relevance=9.0))
    assert joins.dedupe_then_filter(rows, "record_id", F.col("scores.relevance.score") >= 5).count() == 0


def test_orders(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k STRING")
    order = spark.createDataFrame([("c", 1), ("a", 2), ("gone", 3)], "k STRING, pos INT")
    assert [r.k for r in joins.curated_order(items, order, "k").collect()] == ["c", "a", "b", "d"]
    rows = spark.createDataFrame([("r1", "retrospective", 9.0), ("a1", "active", 1.0), ("r2", "retrospective", 1.0), ("a2", "active", 5.0)],
                                 "contract_id STRING, kind STRING, heat DOUBLE")
    assert [r.contract_id for r in heat.sectioned(rows).collect()] == ["a2", "a1", "r2", "r1"]


def test_topic_prefilter_finds_substrings(spark):
    topics = spark.createDataFrame([(1, "Bank of England"), (2, "SEC"), (3, "Harbour"), (4, "")], "topic_id INT, topic_name STRING")
    names = spark.createDataFrame([("of Eng",), ("ec",), ("",), ("xyz",), ("r b",)], "name STRING")
    assert sorted(r.topic_id for r in joins.topic_prefilter(topics, names).collect()) == [1, 2]


def test_roles_and_hit_rates(spark, value):
    rows = spark.createDataFrame([("FR", "operating"), ("FR", "closed"), ("DE", "considering"), ("DE", "operating")], "code STRING, role STRING")
    assert {r.code: r.role for r in joins.roles(rows).collect()} == {"FR": "closed", "DE": "considering"}
    df = spark.createDataFrame([("31/39 (79%)",), ("n/a",)], "h STRING").select(*joins.hit_rate(F.col("h")))
    assert [tuple(r) for r in df.collect()] == [(31, 39, 79), (0, 0, 0)]


def test_calendar_weeks_start_on_sunday(spark):
    events = spark.createDataFrame([("2026-05-26",)] * 3, "calendar_date STRING")
    got = {r.day: r for r in portfolio.calendar_month(events, "2026-05-01").collect()}
    assert len(got) == 31 and (got["2026-05-01"].week, got["2026-05-01"].weekday) == (0, 5)
    assert (got["2026-05-03"].week, got["2026-05-03"].weekday, got["2026-05-26"].busy, got["2026-05-27"].busy) == (1, 0, True, False)


def test_net_direction_needs_a_clear_margin(spark):
    events = spark.createDataFrame([("a", "bullish")] * 3 + [("a", "bearish")] * 2 + [("b", "bullish")] * 2 + [("b", "bearish")],
                                   "contract_id STRING, direction STRING").withColumn("day", F.lit(TODAY).cast("date"))
    got = portfolio.net_direction(events.select("contract_id").distinct(), events, TODAY)
    assert {r.contract_id: r.net_direction for r in got.collect()} == {"a": "Mixed", "b": "Bullish"}


def test_jsonl_keeps_malformed_lines_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","output_data":{"classification":{"update_type":"rule"}}}\n\nnot json\n{"topic_id":"t"}\n')
    raw = annotations.read_jsonl(spark, str(tmp_path))
    assert tuple(annotations.quality(raw).first()) == (3, 1, 1)
    flat = annotations.flatten(raw).collect()
    assert [(r.artifact_id, r.update_type, r.title) for r in flat] == [("1", "rule", None)]


def test_snapshots_candles_and_refresh(spark, tmp_path):
    for day in ("20240101", "20240301", "20240201"):
        (tmp_path / f"snapshot={day}").mkdir()
        (tmp_path / f"snapshot={day}" / "e.json").write_text(json.dumps({"v": int(day)}) + "\n")
    (tmp_path / "snapshot=20240201" / "broken.json.gz").write_bytes(b"not an archive")
    assert [r.v for r in tables.read_latest(spark, str(tmp_path), "v BIGINT").collect()] == [20240301]
    prices = spark.createDataFrame([(0.0, 0.4), (0.7, 0.1), (None, 0.2), (None, None)], "c DOUBLE, d DOUBLE")
    assert [r.p for r in prices.select(tables.candle_price(F.col("c"), F.col("d")).alias("p")).collect()] == [0.4, 0.7, 0.2, None]
    cached = spark.createDataFrame([("a", 1), ("b", 2)], "k STRING, v INT")
    fresh = spark.createDataFrame([("a", 9)], "k STRING, v INT")
    assert sorted(tuple(r) for r in tables.refresh(cached, fresh, "k", ["v"]).collect()) == [("a", 9, False), ("b", 2, True)]


def test_writing_again_removes_stale_outputs(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "contract_id STRING, v INT")
    read = lambda: sorted(r.contract_id or "" for r in tables.read_documents(spark, path, "v INT, contract_id STRING").collect())
    assert read() == []
    tables.write_documents(rows("a", "b"), path, "contract_id")
    tables.write_documents(rows("b", "c", None), path, "contract_id")
    assert read() == ["", "b", "c"]
    # A write that fails leaves the last whole version; the next good one removes what it left and what is too old.
    with pytest.raises(Exception):
        tables.write_documents(rows("x", "y").withColumn("v", F.expr("if(contract_id = 'y', raise_error('broken'), v)")), path, "contract_id")
    assert read() == ["", "b", "c"]
    tables.write_documents(rows("d"), path, "contract_id")
    assert read() == ["d"] and len(folders(spark, f"{path}/versions")) == 2
    tables.write_documents(rows(), path, "contract_id")
    assert read() == []


def test_a_heavy_key_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(200_000).select(F.lit("hot").alias("k"), F.lit("the same text in every row").alias("v"))
    limit = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.2"}
    before = {name: spark.conf.get(name, None) for name in limit}
    try:
        for name, value in limit.items():
            spark.conf.set(name, value)
        version = tables.write_documents(rows, str(tmp_path / "out"), "k")
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    found = spark.read.schema("v STRING, k STRING").json(version)
    assert found.count() == 200_000 and len(found.inputFiles()) > 1


def test_topic_prefilter_looks_for_every_customer(spark):
    from gazette.plans import catalog

    folder = "/root/testdata/sf0.01"
    names = {r.c_name[-3:].lower() for r in spark.read.parquet(f"{folder}/customer.parquet").collect()}
    wanted = {r.s_suppkey for r in spark.read.parquet(f"{folder}/supplier.parquet").collect() if any(n in r.s_name.lower() for n in names)}
    assert {r.s_suppkey for r in catalog.QUERIES["topic_prefilter"](spark, folder).collect()} == wanted


def test_corpus_stats_takes_all_date_fields(spark):
    from gazette.schemas import RECORD
    from tests.conftest import make_record

    schema = RECORD.replace("comment_deadline: STRING", "comment_deadline: STRING, early_adoption_date: STRING, updated_date: STRING, other_dates: ARRAY<STRING>", 1)
    none = {"effective_date": "", "compliance_date": "", "comment_deadline": " "}
    rows = [make_record(critical_dates={**none, **d}) for d in ({}, {"early_adoption_date": "2026-01-01"}, {"updated_date": "2026-01-01"},
                                                                {"other_dates": ["2026-01-01"]}, {"other_dates": []}, {"compliance_date": "2026-01-01"})]
    assert audit.corpus_stats(spark.createDataFrame(rows, schema)).first().with_dates == 4


def test_corpus_stats_of_rows_without_metadata(spark):
    from gazette.schemas import RECORD

    bare = dict.fromkeys(audit.METADATA)
    refs = {"rules": ["a", " ", "", None], "statutes": None, "other_ref": []}
    place = lambda j: {"jurisdiction": j, "industry": [], "type": []}
    rows = [make_record(**bare), make_record(**bare, regulator_name=" "), make_record(reg_references=refs, tags=[" ", None], regulator_name=None),
            make_record(tags=["x"], impacted_business=place([" US ", "FR"])), make_record(tags=["x"], impacted_business=place([""]), regulator_name="Agency ")]
    got = audit.corpus_stats(spark.createDataFrame(rows, RECORD)).first()
    assert (got.records, got.with_metadata, got.reg_refs, got.with_refs, got.tags_missing, got.regulators, got.jurisdictions) == (5, 3, 2, 1, 1, 1, 1)


def test_corpus_stats_of_no_rows(records):
    got = audit.corpus_stats(records(make_record()).limit(0)).first()
    assert (got.records, got.with_metadata, got.regulators) == (0, 0, 0)


def test_audits_give_no_share_of_fields_that_the_frame_lacks(records):
    made = {r.field: r.percent for r in audit.field_audit(records(make_record()), {"title": "string", "feed_id": "string", "impact_summary.objective": "string"}).collect()}
    assert made == {"title": 100.0, "feed_id": None, "impact_summary.objective": None}


def test_field_audit_all_has_the_fields_of_the_reference():
    from gazette.plans import corpus

    assert len(corpus._EVERY) == 45 and sum("." in f for f in corpus._EVERY) == 19


def test_corpus_tops_fall_back_to_the_topic_and_end_at_their_limits(spark, records):
    place = lambda i, j: {"impacted_business": {"industry": i, "jurisdiction": j, "type": []}}
    rows = [make_record(**place([" Banks "], [" US "])), make_record(**place([" "], [""])), make_record(topic_id="t2", **place([], None))]
    rows += [make_record(**place(["Banks"], [f"C{k:02}"])) for k in range(30)]
    made = [tuple(r) for r in audit.corpus_tops(records(*rows), spark.createDataFrame([("t1", " Law ")], "topic_id string, sector string")).collect()]
    by = lambda d: [(v, n) for dim, v, n, _ in sorted(made, key=lambda r: r[3]) if dim == d]
    assert by("sector") == [("Banks", 31), ("Law", 1), ("Uncategorized", 1)] and by("topic_sector") == [("Law", 32)]
    assert by("jurisdiction") == [(f"C{k:02}", 1) for k in range(20)] and by("obligations") == []


def test_states_of_files_against_a_plain_loop(spark):
    import random

    from gazette.operators import versions

    r = random.Random(4)
    edits = [(f"f{r.randrange(6)}", r.randrange(1, 12), i, f"e{i}") for i in range(40)]
    files = [(f"f{i}", f"base{i}") for i in range(5)]
    schema = "path STRING, release INT, seq INT, contents STRING"
    base = spark.createDataFrame(files, "path STRING, contents STRING")
    last = {}
    for path, release, _, contents in edits:
        last[path, release] = contents

    def before(path, release):
        done = [k for p, k in last if p == path and k < release]
        return last[path, max(done)] if done else dict(files)[path]

    spans = versions.state_intervals(spark.createDataFrame(edits, schema), base)
    assert spans.count() == 5 + sum(1 for p, _ in last if p != "f5")
    early, late = [e for e in edits if e[2] < 25], [e for e in edits if e[2] >= 25]
    merged = versions.merge_edits(versions.state_intervals(spark.createDataFrame(early, schema), base), spark.createDataFrame(late, schema))
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, spans.collect()))
    for release in (0, 1, 6, 20):
        got = {x.path: x.state for x in versions.state_before(spans, F.lit(release)).collect()}
        assert got == {p: before(p, release) for p, _ in files}
    grid = versions.cumulative_state(spark.createDataFrame(edits, schema), base, spark.createDataFrame([(k,) for k in (3, 7, 7)], "release INT"))
    assert {(x.path, x.release): x.state for x in grid.collect()} == {(p, k): before(p, k) for p, _ in files for k in (3, 7)}


def test_top_many_against_all_pairs(spark, monkeypatch):
    import numpy as np

    from gazette.operators import vectors

    r = np.random.default_rng(8)
    rows = [(i, (r.integers(-2, 3, 4) * 1.0).tolist()) for i in range(120)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [0.0] * 4), (203, [1.0, 2.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>").repartition(5)
    asked = [(k, v) for k, v in rows if k is not None and k % 7 == 0 and v is not None and None not in v]
    queries = spark.createDataFrame(asked, "query_id BIGINT, embedding ARRAY<DOUBLE>")

    def cosine(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(np.dot(a, b) / n), 6) + 0.0 if n else 0.0

    good = [(k, v) for k, v in rows if k is not None and v is not None and None not in v]
    want = {}
    for q, v in asked:
        best = sorted((-cosine(v, w), k) for k, w in good if len(w) == len(v) and cosine(v, w) >= 0.1)[:6]
        want[q] = [(k, -s) for s, k in best]
    for copied in (64 << 20, 100):
        monkeypatch.setattr(vectors, "COPIED", copied)
        monkeypatch.setattr(vectors, "BLOCK", 16)
        got = {}
        for x in sorted(vectors.top_many(df, queries, 6, 0.1).collect(), key=lambda x: x["rank"]):
            got.setdefault(x.query_id, []).append((x.vec_id, x.score))
        assert got == {q: b for q, b in want.items() if b}
    assert vectors.top_many(df, queries.limit(0), 6).count() == 0
