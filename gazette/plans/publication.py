"""Published records as raw JSON, each rule broken by some of them, and their check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.operators import published
from gazette.plans.registry import query
from gazette.plans.views import oracle, records

SNAPSHOT, MODEL, CUTOFF = "2001-08-01", "model-1", "2001-02-01"
_CONFIRMED = [f"human_review.{c}" for c in published.CONFIRMATIONS]
_MIND = ";".join(f"{c}: not confirmed" for c in _CONFIRMED)
_UNASKED = ";".join(f"{c}: confirmed unasked" for c in _CONFIRMED)

# What is put in place of a part of the record (None: the part is left out), and the rules that this breaks,
# for records with a missed obligation and, where it differs, for the others.
FAULTS = [
    ("record", "[1]", "record: not an object"),
    ("record", '{"id": ', "record: not an object"),
    ("record", '{"id": "1", "id": "1"}', "record: not an object"),
    ("note", "1", "record: unlisted key note"),
    ("id", None, "record: missing key id"), ("id", "7", "id: empty"),
    ("title", '" "', "title: empty"), ("regulator_name", "null", "regulator_name: empty"), ("update_type", "[]", "update_type: empty"),
    ("objective", '"\\t"', "objective: empty"), ("what_changed", "true", "what_changed: empty"), ("why_it_matters", '""', "why_it_matters: empty"),
    ("probed_at", "{}", "probed_at: empty"), ("impact_label", '"High"', "impact_label: not high"), ("model_id", '"model-2"', "model_id: wrong"),
    ("model_cutoff", "null", "model_cutoff: wrong"), ("scenario", '"C"', "scenario: not A or B"),
    ("key_requirements", "[]", "key_requirements: empty"), ("key_requirements", '["a", 1]', "key_requirements: not a list of texts"),
    ("impacted_functions", '"x"', "impacted_functions: not a list of texts"),
    ("impacted_functions", "[null]", "impacted_functions: not a list of texts"),
    ("compliance_date", "20", "compliance_date: not a text"), ("compliance_date", None, "record: missing key compliance_date"),
    ("jurisdiction", "null", "jurisdiction: not an object"), ("jurisdiction.reasoning", '"x"', "jurisdiction: unlisted key reasoning"),
    ("jurisdiction.scope", "null", "jurisdiction.scope: not a text"), ("jurisdiction.country", "1", "jurisdiction.country: not a text"),
    ("jurisdiction.bloc", "[]", "jurisdiction.bloc: not a text"), ("jurisdiction.region_name", "false", "jurisdiction.region_name: not a text"),
    ("citation", '"law"', "citation: not an object"), ("citation.name", '""', "citation.name: empty"), ("citation.url", "3", "citation.url: empty"),
    ("citation.url", '"ftp://x"', "citation.url: not http"), ("citation.url", None, "citation: missing key url"),
    ("impacted_business", "[]", "impacted_business: not an object"), ("impacted_business.size", "[2]", "impacted_business.size: not a list of texts"),
    ("impacted_business.type", "{}", "impacted_business.type: not a list of texts"),
    ("impacted_business.industry", "null", "impacted_business.industry: not a list of texts"),
    ("source", "1", "source: not an object"), ("source.artifact_id", '""', "source.artifact_id: empty"),
    ("source.topic_id", "5", "source.topic_id: empty"), ("source.source_id", None, "source: missing key source_id"),
    ("source.snapshot_date", '"2001-08-02"', "source.snapshot_date: wrong"),
    # Nothing says here whether the confirmations were asked for, so they aren't looked at.
    ("baseline_failures", "{}", "baseline_failures: not a list"),
    ("baseline_failures", "[]", "baseline_failures: empty;" + _UNASKED, "baseline_failures: empty"),
    ("baseline_failures", "[7]", "baseline_failures[0]: not an object;" + _UNASKED, "baseline_failures[0]: not an object"),
    ("failure.seen", "1", "baseline_failures[0]: unlisted key seen"), ("failure.stage", None, "baseline_failures[0]: missing key stage"),
    ("failure.mode", '"made_up"', "baseline_failures[0].mode: unknown;" + _UNASKED, "baseline_failures[0].mode: unknown"),
    ("failure.stage", '"C"', "baseline_failures[0].stage: wrong"),
    ("failure.baseline_response_excerpt", "null", "baseline_failures[0].baseline_response_excerpt: not a text"),
    ("failure.judge_rationale", "1", "baseline_failures[0].judge_rationale: wrong"),
    ("human_review", "null", "human_review: not an object"), ("human_review.notes", '"x"', "human_review: unlisted key notes"),
    ("human_review.reviewer", '" "', "human_review.reviewer: empty"), ("human_review.reviewed_at", "null", "human_review.reviewed_at: empty"),
    ("human_review.attestation", '"Approved"', "human_review.attestation: not approved"),
    *[(c, '"yes"', f"{c}: not a truth value;{c}: not confirmed", f"{c}: not a truth value;{c}: confirmed unasked") for c in _CONFIRMED],
    *[(c, "1", f"{c}: not confirmed", f"{c}: confirmed unasked") for c in _CONFIRMED],
    (_CONFIRMED[0], "false", f"{_CONFIRMED[0]}: not confirmed", f"{_CONFIRMED[0]}: confirmed unasked"),
]
# Odd, so that every fault meets every kind of record.
CYCLE = 2 * len(FAULTS) + 1
_FAULT = f"CASE WHEN seq % {CYCLE} <= {len(FAULTS)} THEN CAST(seq % {CYCLE} AS INT) ELSE 0 END"


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _list(c: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", c), F.lit("]"))


def _part(path: str, usual: Column) -> Column:
    """JSON of a part of the record, or what the record's fault puts there; null leaves it out."""
    put = [(i, f[1]) for i, f in enumerate(FAULTS, 1) if f[0] == path]
    out = F
    for number, text in put:
        out = out.when(F.col("fault") == number, F.lit(text))
    return out.otherwise(usual) if put else usual


def _object(path: str, **fields: Column) -> Column:
    prefix = "" if path == "record" else path + "."
    extra = sorted({f[0] for f in FAULTS if f[0].startswith(prefix) and "." not in f[0][len(prefix):]} - {prefix + k for k in fields} - {"record"})
    pairs = [(k, _part(prefix + k, v)) for k, v in fields.items()]
    pairs += [(name[len(prefix):], _part(name, F.lit(None).cast("string"))) for name in extra]
    inside = F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in pairs])
    return _part(path, F.concat(F.lit("{"), inside, F.lit("}")))


def raw_records(spark, folder):
    """JSON text of each record: half of them as the data has them, the others sound but for one fault."""
    rows = records(spark, folder, "impact", "country", "requirements", F.expr(_FAULT).alias("fault"))
    sound = F.col("fault") > 0
    text = lambda c, other="x": _quoted(F.when(sound & (F.coalesce(c, F.lit("")) == ""), other).otherwise(F.coalesce(c, F.lit(""))))
    fixed = lambda v: F.lit(f'"{v}"')
    null = F.lit("null")
    kind = F.col("update_type")
    is_missed = kind.isin("enforcement", "proposed rule")
    failure = lambda mode, stage, rationale: F.format_string(
        '{"mode":"%s","stage":"%s","baseline_response_excerpt":"said","judge_rationale":%s}', F.lit(mode), F.lit(stage), rationale)
    missed = failure("missed_obligation", "A", F.when(F.col("country") != "US", fixed("stated")).otherwise(null))
    natural = (F.when(kind == "enforcement", F.array(missed)).when(kind == "final rule", F.array(failure("date_wrong", "B", null)))
               .when(kind == "proposed rule", F.array(missed, failure("date_wrong", "A", null))).otherwise(F.array().cast("array<string>")))
    one = F.array(_object(
        "failure", mode=F.when(is_missed, fixed("missed_obligation")).otherwise(fixed("date_wrong")),
        stage=F.when(is_missed, fixed("A")).otherwise(fixed("B")), baseline_response_excerpt=fixed("said"),
        judge_rationale=F.when(is_missed, fixed("stated")).otherwise(null)))
    confirm = F.when(is_missed, F.when(sound, True).otherwise(F.col("impact") > 2).cast("string")).otherwise(null)
    requirements = F.col("impact_summary.key_requirements")
    requirements = F.when(sound, F.array(F.lit("File"))).otherwise(requirements)
    raw = _object(
        "record", id=_quoted(F.col("record_id")), title=text(F.col("title")), regulator_name=text(F.col("regulator_name")),
        jurisdiction=_object("jurisdiction", scope=fixed("national"), country=text(F.col("country")), bloc=null, region_name=null),
        update_type=text(kind), impact_label=F.when(sound, fixed("high")).otherwise(_quoted(F.col("scores.impact.label"))),
        objective=fixed("Inform"), what_changed=text(F.col("impact_summary.what_changed")),
        why_it_matters=text(F.col("impact_summary.why_it_matters")), key_requirements=_list(F.transform(requirements, _quoted)),
        compliance_date=F.coalesce(_quoted(F.nullif("critical_dates.compliance_date", F.lit(""))), null),
        citation=_object("citation", name=fixed("law"), url=text(F.col("link"), "https://example.com/")),
        impacted_business=_object("impacted_business", size=F.lit("[]"), type=_list(F.transform("impacted_business.type", _quoted)),
                                  industry=_list(F.transform("impacted_business.industry", _quoted))),
        impacted_functions=_list(F.transform("impacted_functions", _quoted)), scenario=fixed("A"),
        baseline_failures=_list(F.when(sound, one).otherwise(natural)),
        human_review=_object("human_review", reviewer=fixed("Ada"), reviewed_at=fixed("2001-08-01T10:00:00Z"),
                             attestation=F.when(~sound & (F.col("topic_name") == "NATION_3"), fixed("rejected")).otherwise(fixed("approved")),
                             **{c: confirm for c in published.CONFIRMATIONS}),
        source=_object("source", artifact_id=_quoted(F.col("record_id")), topic_id=_quoted(F.col("topic_id")), source_id=fixed("s1"),
                       snapshot_date=fixed(SNAPSHOT)),
        probed_at=fixed("2001-07-01T00:00:00Z"), model_id=fixed(MODEL), model_cutoff=fixed(CUTOFF))
    return rows.select("record_id", raw.alias("raw"))


_MISSED = "update_type IN ('enforcement', 'proposed rule')"
_BROKEN = "CASE fault " + " ".join(
    f"WHEN {i} THEN CASE WHEN {_MISSED} THEN '{f[2]}' ELSE '{f[-1]}' END" for i, f in enumerate(FAULTS, 1)) + f""" ELSE concat_ws(';',
    CASE WHEN title = '' THEN 'title: empty' END, CASE WHEN coalesce(regulator_name, '') = '' THEN 'regulator_name: empty' END,
    CASE WHEN why_it_matters = '' THEN 'why_it_matters: empty' END, CASE WHEN impact < 8 THEN 'impact_label: not high' END,
    CASE WHEN requirements = 0 THEN 'key_requirements: empty' END, CASE WHEN link = '' THEN 'citation.url: empty' END,
    CASE WHEN update_type IN ('other', 'press release') THEN 'baseline_failures: empty' END,
    CASE WHEN update_type = 'proposed rule' THEN 'baseline_failures[1].stage: wrong' END,
    CASE WHEN {_MISSED} AND country = 'US' THEN 'baseline_failures[0].judge_rationale: wrong' END,
    CASE WHEN topic_name = 'NATION_3' THEN 'human_review.attestation: not approved' END,
    CASE WHEN {_MISSED} AND impact <= 2 THEN '{_MIND}' END) END"""


@query("record_constraints", oracle(f"""
    SELECT record_id, array_to_string(list_sort(string_split(broken, ';')), ';') AS errors
    FROM (SELECT record_id, {_BROKEN} AS broken FROM (SELECT *, {_FAULT} AS fault FROM records))""", "records"))
def record_constraints(spark, folder):
    """All broken rules of each published record."""
    checked = published.errors(raw_records(spark, folder), "raw", SNAPSHOT, MODEL, CUTOFF)
    return checked.select("record_id", F.array_join(F.array_sort("errors"), ";").alias("errors"))
