"""Entity matching and heat."""

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gazette.operators import heat, matching
from tests.conftest import make_record

TODAY = "2026-05-26"


def contracts(spark, *rows):
    schema = "contract_id STRING, settlement_entities ARRAY<STRING>, kind STRING, listed_at STRING, resolved_at STRING"
    filled = [(i, e, kind, "2026-04-01", resolved) for i, e, kind, resolved in rows]
    return spark.createDataFrame(filled, schema)


def one_contract(spark, entities):
    return contracts(spark, ("c", entities, "active", ""))


def whole_word(a, b):
    """The rule of the match, pair by pair."""
    a, b = a.strip().lower(), b.strip().lower()
    inside = lambda n, h: re.search(r"\b" + re.escape(n) + r"\b", h) is not None
    return bool(a) and bool(b) and (a == b or inside(a, b) or inside(b, a))


@pytest.mark.parametrize("mine, theirs, hit", [
    ("FCC", "Federal Communications Commission (FCC)", True),
    ("fcc", "FCCA", False),
    ("Federal Reserve Board", "federal reserve", True),
    ("AT&T", "at&t inc", True),
    ("&", "AT&T", True),
    ("(FCC)", "the (FCC)", False),
    ("(FCC)", "(fcc)", True),
    ("  ", "anything", False),
    ("U.S.", "U.S. Treasury", False),
    ("Zürich", "Stadt Zürich", True),
])
def test_pairs(spark, records, mine, theirs, hit):
    found = matching.entity_join(one_contract(spark, [mine]), records(make_record(entities=[theirs])))
    assert (found.count() == 1) is hit is whole_word(mine, theirs)


TEXTS = st.text(alphabet="ab c&.(é-", min_size=0, max_size=9)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXTS, min_size=1, max_size=25), st.lists(TEXTS, min_size=1, max_size=25))
def test_join_equals_nested_loop(spark, records, mine, theirs):
    book = contracts(spark, *[(f"c{i}", [e], "active", "") for i, e in enumerate(mine)])
    rows = records(*[make_record(record_id=f"r{i}", entities=[e]) for i, e in enumerate(theirs)])
    found = {(r.contract_id, r.record_id) for r in matching.entity_join(book, rows).collect()}
    assert found == {(f"c{i}", f"r{j}") for i, a in enumerate(mine) for j, b in enumerate(theirs) if whole_word(a, b)}


def test_first_entity_wins(spark, records):
    found = matching.entity_join(one_contract(spark, ["SEC", "FCC"]), records(make_record(entities=["FCC", "SEC"]))).first()
    assert found.first.matched_entity == "SEC"


def test_heat_formula_and_window(spark, records):
    day = {"fresh": "2026-05-26", "edge": "2026-02-25", "old": "2026-02-24", "future": "2026-05-27"}
    rows = records(*[make_record(record_id=k, pub_date=d, urgency=6.0, entities=["Agency", "Agency of X"]) for k, d in day.items()],
                   make_record(record_id="invalid", pub_date_valid=False), make_record(record_id="bad", pub_date="2569-99-01"))
    got = heat.heat(one_contract(spark, ["Agency"]), rows, TODAY).first().heat
    assert got == round(6.0 + 6.0 * math.exp(-90 / 14), 2)


def test_heat_without_matches_is_zero(spark, records):
    assert heat.heat(one_contract(spark, ["Nobody"]), records(make_record()), TODAY).first().heat == 0.0


def test_resolved_contract_is_scored_at_resolution(spark, records):
    book = contracts(spark, ("a", ["Agency"], "active", ""), ("b", ["Agency"], "retrospective", "2026-05-01"))
    rows = records(make_record(pub_date="2026-05-01", urgency=5.0))
    got = {r.contract_id: r.heat for r in heat.heat_delta(book, rows, TODAY).collect()}
    assert got == {"a": round(5 * math.exp(-25 / 14), 2), "b": 5.0}


def test_sparkline_runs_from_oldest_to_today(spark, records):
    book = one_contract(spark, ["Agency"])
    rows = records(make_record(record_id="a", pub_date="2026-05-26"), make_record(record_id="b", pub_date="2026-05-13"),
                   make_record(record_id="c", pub_date="2026-05-12"))
    line = heat.sparkline(book, heat.contract_days(book, rows), TODAY).first().sparkline
    assert list(line) == [1] + [0] * 12 + [1]


def test_timeline_claims_titles_by_matching_records_only(spark, records):
    rows = records(
        make_record(record_id="other", seq=1, title="Same", entities=["Nobody"], topic_name=""),
        make_record(record_id="first", seq=2, title=" same ", pub_date="2026-05-02"),
        make_record(record_id="second", seq=3, title="SAME", pub_date="2026-05-09"),
        make_record(record_id="early", seq=4, title="Early", pub_date="2025-12-31"))
    found = matching.contract_timeline(one_contract(spark, ["Agency"]), rows, TODAY)
    assert [r.record_id for r in found.collect()] == ["first"]


def test_peer_percentile_counts_itself(spark):
    heats = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 80.0)], "contract_id STRING, heat DOUBLE")
    got = {r.contract_id: (r.percentile, r.peer_tier, r.tier) for r in heat.peer_percentile(heats).collect()}
    assert got == {"a": (25, "watch", "dormant"), "b": (75, "critical", "dormant"), "c": (75, "critical", "dormant"),
                   "d": (100, "critical", "critical")}


def test_a_common_word_is_no_key(spark):
    """"commission" is the longest word of half of all texts; candidates stay near the matches all the same."""
    n = 300
    theirs = [f"Commission of town{i}" for i in range(n)] + [f"Bureau b{i}" for i in range(n)]
    mine = [f"town{i} Commission" for i in range(0, n, 3)] + [f"commission of town{i}" for i in range(0, n, 3)] + ["commission"]
    normal = lambda texts, c: spark.createDataFrame([(t.lower(),) for t in texts], f"{c} STRING").distinct()
    entities, phrases = normal(theirs, "entity"), normal(mine, "c_entity")
    links = {tuple(r) for r in matching.entity_links(entities, phrases).collect()}
    assert links == {(a.lower(), b.lower()) for a in theirs for b in mine if whole_word(a, b)}
    # All texts with the word are partners of the one phrase that is nothing else; the rest meet on names.
    assert matching.candidates(entities, phrases).distinct().count() <= 2 * len(links)


def test_rarest_pieces(spark):
    texts = spark.createDataFrame([(t,) for t in ("bank of x", "bank of y", "bank", "&", "of")], "text STRING")
    assert {r.text: r.piece for r in matching.rarest_pieces(texts).collect()} == {
        "bank of x": "x", "bank of y": "y", "bank": "bank", "&": "&", "of": "of"}
