"""Explicit schemas; nothing on a hot path is inferred."""

from __future__ import annotations

SCORE = "STRUCT<score: DOUBLE, label: STRING>"

# One flat record, the shape every record operator takes.
RECORD = f"""
    record_id STRING, seq BIGINT, topic_id STRING, topic_name STRING, title STRING, link STRING,
    update_type STRING, regulator_name STRING, regulator_division STRING, pub_date STRING,
    pub_date_valid BOOLEAN, topic_jurisdiction_code STRING,
    jurisdiction_tier STRUCT<label: STRING, tier: INT>,
    scores STRUCT<urgency: {SCORE}, impact: {SCORE}, relevance: {SCORE}>,
    impacted_business STRUCT<jurisdiction: ARRAY<STRING>, industry: ARRAY<STRING>, type: ARRAY<STRING>>,
    impacted_functions ARRAY<STRING>,
    impact_summary STRUCT<what_changed: STRING, why_it_matters: STRING, key_requirements: ARRAY<STRING>>,
    critical_dates STRUCT<effective_date: STRING, compliance_date: STRING, comment_deadline: STRING>,
    reg_references STRUCT<rules: ARRAY<STRING>, statutes: ARRAY<STRING>, other_ref: ARRAY<STRING>>,
    penalties_consequences ARRAY<STRING>, tags ARRAY<STRING>, entities ARRAY<STRING>
"""

# One nested annotation as it lands in JSONL; `_bad` keeps the text of a malformed line.
ANNOTATION = """
    id STRING, state STRING, topic_id STRING, source_id STRING,
    input_data STRUCT<feed_entry_id: STRING, extracted_metadata: STRUCT<title: STRING, url: STRING>>,
    output_data STRUCT<
        scores: STRUCT<
            impact: STRUCT<label: STRING, score: DOUBLE, confidence: DOUBLE>,
            urgency: STRUCT<label: STRING, score: DOUBLE, confidence: DOUBLE>,
            relevance: STRUCT<label: STRING, score: DOUBLE, confidence: DOUBLE>>,
        classification: STRUCT<
            update_type: STRING, update_subtype: STRING,
            regulatory_source: STRUCT<name: STRING, division_office: STRING>,
            jurisdiction: STRUCT<scope: STRING, country: STRING, bloc: STRING, locality: STRING,
                                 region_name: STRING>,
            jurisdiction_tier: STRUCT<label: STRING, tier: INT>,
            metadata: STRUCT<title: STRING, base_url: STRING, summary: STRING>>,
        metadata: STRUCT<
            impact_summary: STRUCT<objective: STRING, what_changed: STRING, why_it_matters: STRING,
                                   key_requirements: ARRAY<STRING>>,
            critical_dates: STRUCT<effective_date: STRING, compliance_date: STRING,
                                   comment_deadline: STRING>,
            reg_references: STRUCT<rules: ARRAY<STRING>, statutes: ARRAY<STRING>, other_ref: ARRAY<STRING>>,
            impacted_business: STRUCT<jurisdiction: ARRAY<STRING>, industry: ARRAY<STRING>,
                                      type: ARRAY<STRING>>,
            impacted_functions: ARRAY<STRING>, penalties_consequences: ARRAY<STRING>,
            tags: ARRAY<STRING>, entities: ARRAY<STRING>>,
        reconciled_published_date: STRUCT<date: STRING, valid: BOOLEAN>>
"""

# Nested path of each column of the flattened annotation.
FLAT_PATHS = {
    "artifact_id": "id",
    "topic_id": "topic_id",
    "source_id": "source_id",
    "impact_label": "output_data.scores.impact.label",
    "impact_score": "output_data.scores.impact.score",
    "impact_confidence": "output_data.scores.impact.confidence",
    "update_type": "output_data.classification.update_type",
    "update_subtype": "output_data.classification.update_subtype",
    "regulator_name": "output_data.classification.regulatory_source.name",
    "regulator_division": "output_data.classification.regulatory_source.division_office",
    "jurisdiction_scope": "output_data.classification.jurisdiction.scope",
    "jurisdiction_country": "output_data.classification.jurisdiction.country",
    "jurisdiction_bloc": "output_data.classification.jurisdiction.bloc",
    "jurisdiction_locality": "output_data.classification.jurisdiction.locality",
    "jurisdiction_region": "output_data.classification.jurisdiction.region_name",
    "title": "output_data.classification.metadata.title",
    "base_url": "output_data.classification.metadata.base_url",
    "summary": "output_data.classification.metadata.summary",
    "objective": "output_data.metadata.impact_summary.objective",
    "what_changed": "output_data.metadata.impact_summary.what_changed",
    "why_it_matters": "output_data.metadata.impact_summary.why_it_matters",
    "key_requirements": "output_data.metadata.impact_summary.key_requirements",
    "effective_date": "output_data.metadata.critical_dates.effective_date",
    "compliance_date": "output_data.metadata.critical_dates.compliance_date",
    "reg_rules": "output_data.metadata.reg_references.rules",
    "reg_statutes": "output_data.metadata.reg_references.statutes",
    "reg_other_ref": "output_data.metadata.reg_references.other_ref",
    "impacted_business": "output_data.metadata.impacted_business",
    "impacted_functions": "output_data.metadata.impacted_functions",
    "penalties_consequences": "output_data.metadata.penalties_consequences",
    "reconciled_published_date": "output_data.reconciled_published_date.date",
    "reconciled_pub_valid": "output_data.reconciled_published_date.valid",
}

VERDICTS = "verdicts ARRAY<STRUCT<obligation_id: STRING, verdict: STRING, confidence: STRING, " \
           "applies_to_draft: BOOLEAN, omission_material: BOOLEAN>>"
