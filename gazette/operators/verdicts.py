"""Scoring of answers, validation of verdicts, checks of published records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette import vocab
from gazette.functions import dates, urls
from gazette.functions.common import lookup, text
from gazette.operators.published import CONFIRMATIONS


def citation_outcome(answers: DataFrame, statuses: DataFrame) -> DataFrame:
    """Outcome of the cited address: missing, correct, or by the recorded status of the address.

    `answers` has baseline_url and ground_truth (array); `statuses` has one row (url, status) per address. An
    address without a recorded status is unverifiable.
    """
    cited = urls.normal_url(F.col("baseline_url"))
    known = F.transform("ground_truth", urls.normal_url)
    looked_up = statuses.select(F.col("url").alias("baseline_url"), "status")
    joined = answers.join(looked_up, "baseline_url", "left")
    outcome = (
        F.when(text(F.col("baseline_url")) == "", "citation_missing")
        .when(F.array_contains(known, cited), "citation_correct")
        .otherwise(lookup(F.col("status"), vocab.URL_OUTCOMES, "citation_unverifiable"))
    )
    return joined.withColumn("citation", outcome).drop("status")


def date_outcome(truth: Column, claimed: Column, citation: Column) -> Column:
    """Outcome of the claimed date, judged only where the citation is correct."""
    truth, read = dates.strict_iso_day(truth), dates.strict_day(claimed)
    return (
        F.when(truth.isNull(), "not_applicable")
        .when(text(claimed) == "", "date_missing")
        .when(citation != "citation_correct", "date_uncertain_attribution")
        .when(read.isNull(), "date_unparseable")
        .when(read == truth, "date_correct")
        .otherwise("date_wrong")
    )


def obligation_outcome(eligible: Column, verdict: Column) -> Column:
    return F.when(~eligible, "not_applicable").otherwise(F.coalesce(verdict, F.lit("uncertain")))


def obligation_failed(outcome: Column, confidence: Column, applies: Column, material: Column,
                      floor: float = vocab.JUDGE_CONFIDENCE_FLOOR) -> Column:
    """A violation that is sure enough, applies, and matters."""
    return F.coalesce((outcome == "violation") & (confidence >= floor) & applies & material, F.lit(False))


def evidence(citation: Column, date: Column, obligation: Column, obligation_fails: Column) -> Column:
    """Outcomes that are failures, as an array; a record is admitted when it is not empty."""
    return F.array_compact(F.array(
        F.when(citation == "citation_fabricated", citation), F.when(date == "date_wrong", date),
        F.when(obligation_fails, obligation)))


def outcome_counts(scored: DataFrame, columns: list[str]) -> DataFrame:
    """How often each outcome of each scorer occurs."""
    pairs = F.array(*[F.struct(F.lit(c).alias("scorer"), F.col(c).alias("outcome")) for c in columns])
    return scored.select(F.explode(pairs).alias("p")).groupBy("p.scorer", "p.outcome").agg(F.count("*").alias("n"))


_RESPONSE = ("verdicts ARRAY<STRUCT<obligation_id: STRING, verdict: STRING, confidence: VARIANT, "
             "applies_to_draft: BOOLEAN, omission_material: BOOLEAN>>")


def _confidence(entry: Column) -> Column:
    """Confidence as a number from 0 to 1; text, truth values and other numbers are null, never clamped."""
    raw = entry["confidence"]
    numeric = F.schema_of_variant(raw).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    value = F.try_variant_get(raw, "$", "double")
    return F.when(numeric & value.between(0.0, 1.0), value)


def validate_verdicts(responses: DataFrame) -> DataFrame:
    """Exactly one verdict per requested id in requested order.

    `responses` has response (JSON text) and requested (array of ids). The first entry of an id counts, also
    when it is then discarded; unknown ids are dropped; what is missing becomes an uncertain verdict. All of it
    happens inside the row.
    """
    parsed = responses.withColumn("_entries", F.from_json("response", _RESPONSE)["verdicts"])
    rows = parsed.select(*[c for c in responses.columns if c not in ("response", "requested")], "_entries",
                         F.posexplode("requested").alias("position", "obligation_id"))
    mine = F.get(F.filter(F.coalesce("_entries", F.array()), lambda e: e["obligation_id"] == F.col("obligation_id")), 0)
    rows = rows.withColumn("_entry", F.when(F.col("_entries").isNotNull(), mine)).drop("_entries")
    rows = rows.withColumn("_confidence", _confidence(F.col("_entry")))
    good = F.col("_confidence").isNotNull()
    pick = lambda field, other: F.when(good, F.coalesce(F.col(f"_entry.{field}"), F.lit(other))).otherwise(F.lit(other))
    state = F.when(good, "given").when(F.col("_entry").isNotNull(), "discarded").otherwise("omitted")
    return rows.select(
        *[c for c in rows.columns if not c.startswith("_")], pick("verdict", "uncertain").alias("verdict"),
        F.when(good, F.col("_confidence")).otherwise(0.0).alias("confidence"), pick("applies_to_draft", False).alias("applies"),
        pick("omission_material", False).alias("material"), state.alias("state"))


def has_stage_b_failure(failures: Column) -> Column:
    return F.exists(failures, lambda f: f["mode"].isin("citation_fabricated", "date_wrong"))


def predicts_block(failures: Column, review: Column) -> Column:
    """A missed obligation with all three confirmations."""
    confirmed = [F.coalesce(review[c], F.lit(False)) for c in CONFIRMATIONS]
    return F.exists(failures, lambda f: f["mode"] == "missed_obligation") & confirmed[0] & confirmed[1] & confirmed[2]


def ledger_gaps(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected scores that are absent or not finite; an empty result means the ledger holds."""
    score = F.col("score")
    finite = F.coalesce(~F.isnan(score) & (F.abs(score) < float("inf")), F.lit(False))
    return expected.join(actual, keys, "left").filter(~finite).select(*keys)
