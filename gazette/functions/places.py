"""Jurisdiction codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette import vocab
from gazette.functions.common import lookup, text, texts

SUBDIVISION = r"^[A-Z]{2}-[A-Z0-9]{1,3}$"
COUNTRY = r"^[A-Z]{2}$"


def impacted() -> Column:
    """Impacted jurisdictions without empty entries; an empty array when there are none."""
    listed = F.coalesce(F.col("impacted_business.jurisdiction"), F.array().cast("array<string>"))
    return F.filter(listed, lambda j: j.isNotNull() & (j != ""))


def is_state(code: Column) -> Column:
    return code.startswith("US-") & (F.length(code) == 5)


def us_states() -> Column:
    return F.filter(impacted(), is_state)


def valid_code(code: Column) -> Column:
    return code.rlike(COUNTRY) | code.rlike(SUBDIVISION)


def country_code(world_only: bool = False) -> Column:
    """Topic code, else the first impacted one; null unless it has the form of a code."""
    topic = F.trim(text(F.col("topic_jurisdiction_code")))
    first = F.trim(F.get(F.col("impacted_business.jurisdiction"), 0))
    code = F.when(topic != "", topic).otherwise(first)
    wanted = code.rlike(COUNTRY) if world_only else valid_code(code)
    return F.when(wanted, code)


def state_of(code: Column) -> Column:
    """State code, also for a bare postal code such as CA; null for anything else."""
    postal = F.concat(F.lit("US-"), code)
    return F.when(is_state(code), code).when(code.isin(vocab.US_STATES), postal)


def place_kind(code: Column) -> Column:
    """state, federal, international or null."""
    return (
        F.when(state_of(code).isNotNull(), "state")
        .when(code == "US", "federal")
        .when(code.rlike("^[A-Za-z]{2}$"), "international")
    )


def jurisdiction_phrase(country: Column, bloc: Column) -> Column:
    """Country name, else the bloc, else a neutral phrase; an unknown code shows as itself."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(filled(country), F.coalesce(lookup(country, vocab.COUNTRY_NAMES), country))
        .when(bloc == "EU", "the EU")
        .when(filled(bloc), bloc)
        .otherwise("the applicable jurisdiction")
    )


def market_tags(topic: Column) -> Column:
    """Market tags of a topic text in table order without repeats; INT when none applies."""
    low = F.lower(topic)
    none = F.array().cast("array<string>")
    found = F.array_distinct(F.concat(*[
        F.when(low.contains(word), texts(markets)).otherwise(none) for word, markets in vocab.MARKET_TAGS
    ]))
    return F.when(F.size(found) > 0, found).otherwise(texts(["INT"]))
