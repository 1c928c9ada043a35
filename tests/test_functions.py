"""Boundaries of the column functions."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gazette.functions import dates, keywords, money, places, scores, text, urls
from tests.conftest import make_record


@pytest.mark.parametrize("raw, day", [
    ("2026-09-01", "2026-09-01"), ("1 September 2026", "2026-09-01"), ("September 1, 2026", "2026-09-01"),
    ("Sept 1 2026", "2026-09-01"), ("1st Sept. 2026", "2026-09-01"), ("2026-09-01T00:00:00Z", "2026-09-01"),
    ("01/09/2026", None), ("Q3 2026", None), ("TBD", None), ("", None), ("2026-02-30", None), ("2026-13-01", None),
    ("31 Feb 2026", None), ("1 Foo 2026", None)])
def test_strict_day(value, raw, day):
    assert value(dates.strict_day(F.col("c")), c=raw) == day


@pytest.mark.parametrize("raw, day", [
    ("20260319", "2026-03-19"), ("2026-03-19T10:00", "2026-03-19"), ("19 March 2026", "2026-03-19"), (None, ""), ("soon, maybe later", "soon, mayb")])
def test_lenient_day(value, raw, day):
    assert value(dates.lenient_day(F.col("c")), c=raw) == day


@pytest.mark.parametrize("raw, day, label", [
    ("2026 Mar 7", "2026-03-07", "Mar 2026"), ("2026 Mar", "2026-03-01", "Mar 2026"), ("2026", "2026-01-01", "Jan 2026"),
    ("2026 Spring", "2026-01-01", "Jan 2026"), ("n.d.", "0000-00-00", "n.d.")])
def test_partial_day(value, raw, day, label):
    assert value(dates.partial_day(F.col("c")), c=raw) == day
    assert value(dates.month_label(F.col("c")), c=raw) == label


def test_deadline_prefers_fields_then_text(value):
    found = dates.deadline(F.col("body"), F.col("a"), F.col("b"))
    assert value(found, body="due in march 2028", a=" ", b=" 2027-01-01 ") == "2027-01-01"
    assert value(found, body="due in March 2028 or q3 2026", a="", b=None) == "March 2028"
    assert value(found, body="by q3 2026", a="", b="") == "Q3 2026"
    assert value(found, body="mar 2028", a="", b="") == "—"


@pytest.mark.parametrize("score, label", [(8.0, "critical"), (7.99, "high"), (6.5, "high"), (4.0, "medium"), (3.9, "low")])
def test_urgency_label(value, score, label):
    assert value(scores.urgency_label(F.lit(score))) == label


def test_missing_scores_count_zero(records):
    row = records({**make_record(), "scores": None})
    assert row.select(scores.score("urgency").alias("v")).first().v == 0.0


def test_rank_score_counts_named_platforms(records):
    plain = make_record(record_id="a", pub_date="2026-05-20")
    named = make_record(record_id="b", pub_date="2026-05-20", title="On Prediction Market rules")
    got = {r.record_id: r.v for r in records(plain, named).select("record_id", scores.rank_score("2026-05-26").alias("v")).collect()}
    assert got["a"] == round(0.3 * 8 + 0.2 * 8 + 1.5 + 1.5 + 0.8, 4) and got["b"] == round(got["a"] + 1.0, 4)


@pytest.mark.parametrize("topic, listed, code, world", [
    ("US-CA", [], "US-CA", None), ("", ["FR"], "FR", "FR"), (" ", ["APAC"], None, None), (None, [], None, None), ("EU", [], "EU", "EU"),
    ("usa", ["FR"], None, None)])
def test_country_code(records, topic, listed, code, world):
    row = records(make_record(topic_jurisdiction_code=topic, impacted_business={"jurisdiction": listed, "industry": [], "type": []}))
    got = row.select(places.country_code().alias("a"), places.country_code(True).alias("b")).first()
    assert (got.a, got.b) == (code, world)


@pytest.mark.parametrize("code, kind, state", [
    ("US-CA", "state", "US-CA"), ("CA", "state", "US-CA"), ("DE", "state", "US-DE"), ("FR", "international", None), ("US", "federal", None),
    ("APAC", None, None)])
def test_postal_codes_count_as_states(value, code, kind, state):
    assert value(places.place_kind(F.col("c")), c=code) == kind
    assert value(places.state_of(F.col("c")), c=code) == state


@pytest.mark.parametrize("body, amounts", [
    ("fined $1,500 and $2.5 million", [1500, 2500000]), ("$5 Bank", [5_000_000_000]), ("$10K", [10000]), ("none", []), ("$3 billion", [3_000_000_000])])
def test_dollar_amounts(value, body, amounts):
    assert list(value(money.dollar_amounts(F.col("c")), c=body)) == amounts


def test_strict_amounts_need_a_word_end(value):
    assert list(value(money.dollar_amounts(F.col("c"), strict=True), c="$5 Bank, $5 B")) == [5, 5_000_000_000]


def trim(url):
    while url:
        if url[-1] in ".,;:!?" or (url[-1] == ")" and url.count("(") < url.count(")")):
            url = url[:-1]
        else:
            break
    return url


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a/().,;?", max_size=8), min_size=30, max_size=60))
def test_extract_urls_equals_step_by_step_trimming(spark, tails):
    rows = [(f"see https://x.gov/{t} and",) for t in tails]
    got = [list(r.v) for r in spark.createDataFrame(rows, "c STRING").select(urls.extract_urls(F.col("c")).alias("v")).collect()]
    assert got == [[trim(f"https://x.gov/{t}")] for t in tails]


@pytest.mark.parametrize("raw, normal", [
    ("HTTPS://Ex.COM/Path/?Q=A#F", "https://ex.com/Path?Q=A#F"), ("http://ex.com/", "http://ex.com"), ("http://ex.com/a//", "http://ex.com/a")])
def test_normal_url(value, raw, normal):
    assert value(urls.normal_url(F.col("c")), c=raw) == normal


def test_tag_words_match_whole_words(spark):
    rows = [(["Retail banking"],), (["Generative AI"],), (["AI"],), (["email"],), (["robo-advice tools"],)]
    df = spark.createDataFrame(rows, "t ARRAY<STRING>")
    assert [r.v for r in df.select(keywords.any_tag(F.col("t"), ["ai"]).alias("v")).collect()] == [False, True, True, False, False]


def test_longest_keyword_picks_the_bucket(spark):
    df = spark.createDataFrame([(["Credit Advertising"],), (["Other"],)], "t ARRAY<STRING>")
    assert [r.v for r in df.select(keywords.domain_bucket("B", F.col("t")).alias("v")).collect()] == [
        "credit advertising", "investment product marketing"]


def test_negative_topic_needs_the_entity_type(spark):
    rows = [("Energy Commission", "", "Commodity Regulators", ""), ("Tobacco Lottery Board", "", "", ""), ("Harbour", "SEC", "", ""), ("Harbour", "", "", "")]
    df = spark.createDataFrame(rows, "n STRING, a STRING, e STRING, b STRING")
    reasons = keywords.topic_reasons(F.col("n"), F.col("a"), F.col("e"), F.col("b"))
    assert [list(r.v) for r in df.select(reasons.alias("v")).collect()] == [["entity_type"], ["rejected_by_negative"], ["acronym"], []]


def python_sections(body):
    out, current = [], None
    for line in body.split("\n"):
        m = re.match(r"^(\d+(?:\.\d+)+|\d+\.)\s+(.+)$", line.strip())
        if m and len(m.group(1).split(".")) <= 3:
            current = [m.group(1).rstrip("."), m.group(2).strip(), []]
            out.append(current)
        elif current:
            current[2].append(line)
    return [(i, t, "\n".join(b).strip()) for i, t, b in out]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["1. One", "2.3 Two", " 4.5.6  Three ", "1.2.3.4 deep", "5.", "plain", "", "12 none", "7. "]), max_size=9), min_size=20, max_size=30))
def test_sections_equal_line_by_line_split(spark, docs):
    bodies = ["\n".join(d) for d in docs]
    got = spark.createDataFrame([(b,) for b in bodies], "c STRING").select(text.sections(F.col("c")).alias("v")).collect()
    assert [[tuple(s) for s in r.v] for r in got] == [python_sections(b) for b in bodies]


def test_furniture(value):
    body = "Title\n12\n\n\n© 2024 Someone\n\nBody text\n6 February 2024\n"
    assert value(text.strip_furniture(F.col("c")), c=body) == "Title\n\nBody text"
    assert value(text.furniture_only(F.col("c")), c="12\n6 February 2024\nshort") is True
    assert value(text.furniture_only(F.col("c")), c="") is False


def test_tokens_drop_stop_words_and_accented_words(value):
    assert list(value(text.tokens(F.col("c")), c="The FDA and é-mail: ab, a, été 510k ab")) == ["fda", "mail", "ab", "510k", "ab"]
