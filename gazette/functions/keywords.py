"""Keyword and pattern classification."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette import vocab
from gazette.functions.common import blank, case, first_keyword, lookup, mentions, names_of, text, texts


def tag_pattern(words: list[str]) -> str:
    """One pattern for a keyword set: phrases anywhere, single words at word boundaries."""
    parts = [re.escape(w) if " " in w else rf"\b{re.escape(w)}\b" for w in words]
    return "(?U)(?:" + "|".join(parts) + ")"


def any_tag(tags: Column, words: list[str]) -> Column:
    """True when some tag matches some keyword; one pattern, one pass over the tags."""
    pattern = tag_pattern(words)
    return F.exists(tags, lambda t: F.coalesce(F.lower(t).rlike(pattern), F.lit(False)))


def scenario_tags() -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(F.col("impacted_business.industry"), none),
                    F.coalesce(F.col("impacted_functions"), none))


def scenario_eligible(scenario: str, country: Column, bloc: Column, tags: Column | None = None) -> Column:
    """Keyword test of the scenario plus a usable jurisdiction and topic."""
    tags = scenario_tags() if tags is None else tags
    usable = ((text(country) != "") | (text(bloc) != "")) & (F.size(tags) > 0)
    if scenario == "A":
        place = F.coalesce(country.isin(vocab.EEA_COUNTRIES), F.lit(False)) | (text(bloc) == "EU")
        return usable & place & any_tag(tags, vocab.SCENARIO_A_WORDS)
    if scenario == "B":
        both = any_tag(tags, vocab.SCENARIO_B_FINANCE) & any_tag(tags, vocab.SCENARIO_B_PROMOTION)
        return usable & (any_tag(tags, vocab.SCENARIO_B_COMBINED) | both)
    raise ValueError(f"unknown scenario {scenario!r}")


def domain_bucket(scenario: str, tags: Column | None = None) -> Column:
    """Bucket of the first tag that matches a keyword of the scenario, the longest keyword first."""
    tags = scenario_tags() if tags is None else tags
    words = vocab.DOMAIN_BUCKETS[scenario]
    ordered = sorted(words, key=len, reverse=True)

    def bucket_of(tag: Column) -> Column:
        return case([(F.lower(tag).rlike(tag_pattern([word])), words[word]) for word in ordered])

    found = F.array_compact(F.transform(tags, bucket_of))
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(vocab.DEFAULT_BUCKETS[scenario]))


def entity_role(name: Column) -> Column:
    return F.when(mentions(name, vocab.REGULATOR_WORDS), "regulator").otherwise("company")


def looks_like_regulator(name: Column) -> Column:
    return name.rlike(r"\b[A-Z]{2,}\b") | mentions(name, vocab.REGULATOR_NAME_WORDS)


def topic_reasons(name: Column, acronym: Column, entity_type: Column, body: Column) -> Column:
    """Tiers that vouch for a topic. A negative name empties the list unless the entity type vouches."""
    name = text(name)
    by_type = F.lower(text(entity_type)).rlike("(?i)(?:" + "|".join(map(re.escape, vocab.TOPIC_ENTITY_LABELS)) + ")")
    by_name = name.rlike("(?i)(?:" + "|".join(vocab.TOPIC_NAME_PATTERNS) + ")")
    negative = name.rlike("(?i)(?:" + "|".join(vocab.TOPIC_NEGATIVE_PATTERNS) + ")")
    reasons = names_of({
        "entity_type": by_type,
        "name": by_name,
        "acronym": F.trim(text(acronym)).isin(vocab.TOPIC_ACRONYMS),
        "phrase": mentions(F.concat_ws(" ", name, body), vocab.TOPIC_PHRASES),
    })
    rejected = (F.size(reasons) > 0) & negative & ~by_type
    return F.when(rejected, texts(["rejected_by_negative"])).otherwise(reasons)


def topic_relevant(reasons: Column) -> Column:
    return (F.size(reasons) > 0) & ~F.array_contains(reasons, "rejected_by_negative")


def lowered(tags: Column) -> Column:
    return F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)


def tags_pass(tags: Column) -> Column:
    """A listed tag is present and no vetoing tag is."""
    low = lowered(tags)
    return F.arrays_overlap(low, texts(vocab.RELEVANT_TAGS)) & ~F.arrays_overlap(low, texts(vocab.VETO_TAGS))


def tag_layers(tags: Column) -> Column:
    """Ids of the layers that share a tag, in order."""
    low = lowered(tags)
    return F.array_compact(F.array(*[
        F.when(F.arrays_overlap(low, texts(listed)), F.lit(layer)) for layer, listed in vocab.LAYER_TAGS.items()
    ]))


def has_ai_tag(tags: Column) -> Column:
    return F.exists(lowered(tags), lambda t: t.contains("artificial intel") | (t == "ai"))


def is_cardiac(*fields: Column) -> Column:
    return F.concat_ws(" ", *fields).rlike("(?i)(?:" + "|".join(vocab.CARDIAC_TERMS) + ")")


def severity_class(c: Column) -> Column:
    return lookup(F.lower(text(c)), vocab.SEVERITIES, "unknown")


def source_type(update_type: Column, body: Column) -> Column:
    return F.coalesce(lookup(F.lower(text(update_type)), vocab.SOURCE_TYPES),
                      first_keyword(body, vocab.SOURCE_TYPE_WORDS, "regulatory"))


def feed_severity(urgency_label: Column, urgency: Column, impact_label: Column, impact: Column,
                  body: Column, similarity: Column) -> Column:
    """Severity from labels and scores, then from words, then from similarity."""
    label = lambda c: F.lower(text(c))
    return (
        F.when((label(urgency_label) == "high") | (F.coalesce(urgency, F.lit(0.0)) >= 7), "critical")
        .when((label(impact_label) == "high") | (F.coalesce(impact, F.lit(0.0)) >= 8), "critical")
        .when((label(impact_label) == "medium") | (F.coalesce(impact, F.lit(0.0)) >= 5), "high")
        .when(mentions(body, vocab.SEVERITY_WORDS), "critical")
        .when(similarity > 0.25, "high")
        .when(similarity > 0.12, "medium")
        .otherwise("low")
    )


def category(body: Column) -> Column:
    return first_keyword(body, vocab.CATEGORY_WORDS, "Regulatory Update")


def horizon_type(update_type: Column, body: Column) -> Column:
    return F.coalesce(lookup(F.lower(text(update_type)), vocab.HORIZON_TYPES),
                      first_keyword(body, vocab.HORIZON_TYPE_WORDS, "REGULATION"))


def is_forward_looking(body: Column) -> Column:
    return mentions(body, vocab.FORWARD_WORDS)


def is_device_topic(topic: Column) -> Column:
    return mentions(topic, vocab.DEVICE_TOPIC_WORDS)


def clearance_regulator(body: Column) -> Column:
    """Regulator of a clearance notice; null when the text is not one."""
    low = F.lower(text(body))
    out = F.when(~mentions(body, vocab.CLEARANCE_WORDS), None)
    for word, label in vocab.CLEARANCE_REGULATORS:
        out = out.when(low.contains(word), F.lit(label))
    return out.otherwise("INT")


def is_clinical(reason: Column) -> Column:
    return (text(reason) == "") | F.coalesce(reason.isin(vocab.CLINICAL_REASONS), F.lit(False))


def article_type(flags: Column) -> Column:
    has = lambda f: F.array_contains(flags, f)
    return (
        F.when(has("systematic_review") & has("meta_analysis"), "SYSTEMATIC REVIEW + META-ANALYSIS")
        .when(has("systematic_review"), "SYSTEMATIC REVIEW")
        .when(has("meta_analysis"), "META-ANALYSIS")
        .when(has("rct"), "RCT")
        .when(has("clinical_trial"), "CLINICAL TRIAL")
        .otherwise("REVIEW")
    )


def short_authors(authors: Column) -> Column:
    """Up to three names in full, else the first and "et al."."""
    return F.when(F.size(authors) <= 3, F.array_join(authors, ", ")).otherwise(
        F.concat(F.element_at(authors, 1), F.lit(" et al.")))


def candidate_failures(earliest: str, latest: str, day: Column, valid: Column, update_type: Column,
                       impact_label: Column, requirements: Column, references: Column) -> Column:
    """Names of all failed candidate tests; an empty array is a pass."""
    no = lambda cond: ~F.coalesce(cond, F.lit(False))
    return names_of({
        "reconciled_published_date": no(valid & day.between(F.lit(earliest).cast("date"), F.lit(latest).cast("date"))),
        "update_type": no(F.lower(F.trim(update_type)).isin(vocab.ACTIONABLE_TYPES)),
        "impact_label": no(impact_label == "high"),
        "key_requirements": no(F.exists(requirements, lambda r: ~blank(r))),
        "reg_reference_url": no(F.size(references) > 0),
    })
