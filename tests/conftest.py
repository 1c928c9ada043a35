import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gazette.session import CHECKPOINT_KEY, build_session

    session = build_session("gazette-tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        CHECKPOINT_KEY: str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def make_record(**over):
    """A record with sensible values; keys of nested parts can be overridden by name."""
    score = lambda v: {"score": v, "label": None}
    base = dict(
        record_id="r1", seq=1, topic_id="t1", topic_name="Topic", title="Notice", link="https://example.com/1",
        update_type="enforcement", regulator_name="Agency", regulator_division="", pub_date="2026-05-01", pub_date_valid=True,
        topic_jurisdiction_code="US", jurisdiction_tier={"label": "us_federal", "tier": 1},
        impacted_business={"jurisdiction": ["US"], "industry": [], "type": []}, impacted_functions=[],
        impact_summary={"what_changed": "x", "why_it_matters": "y", "key_requirements": []},
        critical_dates={"effective_date": "", "compliance_date": "", "comment_deadline": ""},
        reg_references={"rules": [], "statutes": [], "other_ref": []}, penalties_consequences=[], tags=[], entities=["Agency"])
    scores = {d: score(over.pop(d, 8.0)) for d in ("urgency", "impact", "relevance")}
    return {**base, "scores": scores, **over}


@pytest.fixture(scope="session")
def records(spark):
    from gazette.schemas import RECORD

    return lambda *rows: spark.createDataFrame(list(rows), RECORD)


@pytest.fixture(scope="session")
def value(spark):
    """Value of one column expression over a single made-up row."""

    def run(expression, **columns):
        row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} STRING" for k in columns)) if columns else spark.range(1)
        return row.select(expression.alias("v")).first().v

    return run
