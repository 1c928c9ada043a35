"""Published records: sound ones, several broken rules at once, and text that is no record."""

import json

import pytest
from pyspark.sql import functions as F

from gazette.functions.common import names_of
from gazette.operators import published
from gazette.plans import publication

CONFIRM = dict.fromkeys(published.CONFIRMATIONS, True)


def sound(**over):
    base = dict(
        id="1", title="t", regulator_name="r", jurisdiction=dict(scope="s", country=None, bloc="EU", region_name=None), update_type="u",
        impact_label="high", objective="o", what_changed="w", why_it_matters="y", key_requirements=["k"], compliance_date=None,
        citation=dict(name="n", url="http://a"), impacted_business=dict(size=[], type=["a"], industry=[]), impacted_functions=[], scenario="B",
        baseline_failures=[dict(mode="missed_obligation", stage="A", baseline_response_excerpt="", judge_rationale="because")],
        human_review=dict(reviewer="a", reviewed_at="b", attestation="approved", **CONFIRM),
        source=dict(artifact_id="1", topic_id="2", source_id="3", snapshot_date="2020-01-01"), probed_at="p", model_id="m", model_cutoff="c")
    return {**base, **over}


@pytest.fixture
def broken(spark):
    def run(*texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "n INT, raw STRING")
        found = {r.n: r.errors for r in published.errors(rows, "raw", "2020-01-01", "m", "c").collect()}
        return [found[i] for i in range(len(texts))]

    return run


def test_a_sound_record_has_no_errors(broken):
    assert broken(json.dumps(sound())) == [[]]


def test_what_is_no_record_has_one_error(broken):
    wrong = ["record: not an object"]
    assert broken(None, "", "null", "[1]", "7", "{", '{"a": 1, "a": 2}') == [wrong] * 7


def test_an_empty_object_lacks_every_key(broken):
    (errors,) = broken("{}")
    assert sorted(errors) == sorted(f"record: missing key {k}" for k in sound())


def test_all_broken_rules_are_named(broken):
    record = sound(title=" \t", scenario=None, key_requirements=["a", None], extra=1)
    record["baseline_failures"].append(dict(mode="date_wrong", stage="A", baseline_response_excerpt=1, judge_rationale="x"))
    record["baseline_failures"].append("text")
    record["human_review"][published.CONFIRMATIONS[1]] = False
    (errors,) = broken(json.dumps(record))
    assert sorted(errors) == [
        "baseline_failures[1].baseline_response_excerpt: not a text", "baseline_failures[1].judge_rationale: wrong",
        "baseline_failures[1].stage: wrong", "baseline_failures[2]: not an object",
        f"human_review.{published.CONFIRMATIONS[1]}: not confirmed", "key_requirements: not a list of texts", "record: unlisted key extra",
        "scenario: not A or B", "title: empty"]


def test_every_rule_is_broken_by_the_fixture_once():
    named = {name for fault in publication.FAULTS for text in fault[2:] for name in text.split(";")}
    assert len(named) >= 60 and len({f[:2] for f in publication.FAULTS}) == len(publication.FAULTS)


def test_rules_are_compiled_and_keys_may_come_in_any_order(spark, broken):
    named = spark.range(1).select(names_of({"a": F.col("id") == 0, "b": F.col("id") == 1, "c": F.col("id").isNull()}).alias("names"))
    assert named.first().names == ["a"]
    assert "lambda" not in named._jdf.queryExecution().optimizedPlan().toString()
    turned = dict(reversed(sound().items()))
    turned["source"] = dict(reversed(turned["source"].items()))
    assert broken(json.dumps(turned)) == [[]]


def test_an_empty_table(spark):
    rows = spark.createDataFrame([], "raw STRING")
    assert published.errors(rows, "raw", "d", "m", "c").count() == 0
