"""Score, rank and label columns of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette import vocab
from gazette.functions import dates
from gazette.functions.common import blank, lookup, mentions, steps, text


def score(dimension: str) -> Column:
    """Numeric score of one dimension; 0.0 when missing or not a number."""
    return F.coalesce(F.col(f"scores.{dimension}.score").try_cast("double"), F.lit(0.0))


def urgency_label(c: Column) -> Column:
    return steps(c, vocab.URGENCY_LABELS, "low")


def regulator_display() -> Column:
    """"name — division", else the name, else the topic."""
    name, division = F.trim(text(F.col("regulator_name"))), F.trim(text(F.col("regulator_division")))
    return (
        F.when((name != "") & (division != ""), F.concat(name, F.lit(" — "), division))
        .when(name != "", name)
        .otherwise(F.trim(text(F.col("topic_name"))))
    )


def mechanism(c: Column) -> Column:
    return lookup(c, vocab.MECHANISMS, "Context")


def recency_points(age: Column) -> Column:
    """Points by age; a future date counts as fresh, a missing one earns nothing."""
    out = F.when(age.isNull(), 0.0)
    for limit, points in vocab.RECENCY_STEPS:
        out = out.when(age <= limit, points)
    return out.otherwise(0.0)


def type_points(c: Column) -> Column:
    return lookup(text(c), vocab.UPDATE_TYPE_WEIGHTS, 0.0)


def _recognition(*parts: Column) -> Column:
    return F.when(mentions(F.concat_ws(" ", *parts), vocab.RECOGNISED_NAMES), 10.0).otherwise(0.0)


def _blend(recency: Column, kind: Column, place: Column, recognition: Column) -> Column:
    return F.round(
        0.30 * score("urgency") + 0.20 * score("impact") + 0.15 * recency + 0.15 * kind
        + 0.10 * place + 0.10 * recognition, 4)


def rank_score(as_of: str) -> Column:
    """Inbox ranking: urgency, impact, recency, type, place and name recognition."""
    code = F.trim(text(F.col("topic_jurisdiction_code")))
    place = (
        F.when(code.startswith("US-"), 10.0)
        .when(code == "US", 8.0)
        .when(F.col("jurisdiction_tier.label") == "international", 4.0)
        .otherwise(0.0)
    )
    named = _recognition(F.col("title"), F.col("regulator_name"), F.col("entities"), F.col("tags"))
    return _blend(recency_points(dates.age_days(as_of)), type_points(F.col("update_type")), place, named)


def rank_components(as_of: str) -> Column:
    """Struct of the parts of the shortlist ranking, whose place and name rules differ from the inbox's."""
    code = text(F.col("topic_jurisdiction_code"))
    place = (
        F.when(code == "", 0.0)
        .when(code.rlike("^US-[A-Z]{2}$"), 10.0)
        .when(code.startswith("US"), 8.0)
        .otherwise(4.0)
    )
    day = dates.iso_day(F.col("pub_date"))
    kind = lookup(F.lower(F.trim(text(F.col("update_type")))), vocab.UPDATE_TYPE_WEIGHTS, 0.0)
    return F.struct(
        score("urgency").alias("urgency"),
        score("impact").alias("impact"),
        recency_points(dates.age_days(as_of, day)).alias("recency"),
        kind.alias("kind"),
        place.alias("place"),
        _recognition(F.col("title"), F.col("entities"), F.col("regulator_name")).alias("recognition"),
    )


def components_total(c: str) -> Column:
    part = lambda n: F.col(f"{c}.{n}")
    return F.round(0.30 * part("urgency") + 0.20 * part("impact") + 0.15 * part("recency")
                   + 0.15 * part("kind") + 0.10 * part("place") + 0.10 * part("recognition"), 4)


def priority(urgency: Column, impact: Column) -> Column:
    """Whole number from 1 to 10, ties to even."""
    return F.greatest(F.least(F.bround(0.6 * urgency + 0.4 * impact, 0).cast("int"), F.lit(10)), F.lit(1))


def is_substantive(min_relevance: float = vocab.MIN_RELEVANCE) -> Column:
    """Not noise, relevant enough, with a title and a link."""
    return (
        ~F.coalesce(F.col("update_type").isin(vocab.NOISE_TYPES), F.lit(False))
        & (score("relevance") >= min_relevance)
        & ~blank(F.col("title"))
        & ~blank(F.col("link"))
    )


def heat_tier(c: Column) -> Column:
    return steps(c, vocab.HEAT_TIERS, "dormant")


def percentile_tier(c: Column) -> Column:
    return steps(c, vocab.PERCENTILE_TIERS, "dormant")


def decayed(urgency: Column, age: Column) -> Column:
    """Urgency after exponential decay over the age."""
    return urgency * F.exp(-age / F.lit(vocab.HEAT_DECAY_DAYS))


def pressure(n: Column, avg_urgency: Column) -> Column:
    """0 to 100 from a count and its average urgency."""
    return F.round(F.least(F.lit(100.0), n * avg_urgency / F.lit(vocab.PRESSURE_DIVISOR)), 2)


def token_cost(fresh: Column, cached: Column, output: Column, searches: Column, warm: bool = True) -> Column:
    """Dollars of one run. Cold prices every input token as fresh."""
    p = vocab.TOKEN_PRICES
    inputs = fresh * p["input"] + cached * (p["cached"] if warm else p["input"])
    return (inputs + output * p["output"]) / F.lit(1e6) + searches * p["search"]
