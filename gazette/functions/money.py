"""Money amounts in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette import vocab
from gazette.functions.common import lookup, text

# An amount in dollars with an optional scale word, and an amount in any currency.
DOLLARS = r"(?i)\$[0-9,]+(?:\.[0-9]+)?\s*(?:million|billion|M|B|K|thousand)?"
DOLLARS_STRICT = r"(?i)\$[0-9,]+(?:\.[0-9]+)?\s*(?:(?:million|billion|M|B|K|thousand)\b)?"
ANY_MONEY = (r"(?i)(?:USD|US\$|\$|€|EUR|£|GBP)\s?[0-9][0-9,\.]*\s?"
             r"(?:billion|bn|million|mn|m|k|thousand)?")


def dollar_amounts(body: Column, strict: bool = False) -> Column:
    """Whole dollars of each amount in the text.

    The scale letter may run into the next word ("$5 Bank" reads as billions); strict asks for a word end.
    """
    hits = F.regexp_extract_all(text(body), F.lit(DOLLARS_STRICT if strict else DOLLARS), F.lit(0))

    def amount(hit: Column) -> Column:
        scale = F.lower(F.regexp_extract(hit, r"([A-Za-z]+)$", 1))
        factor = (
            F.when(scale.isin("billion", "b"), 1e9)
            .when(scale.isin("million", "m"), 1e6)
            .when(scale.isin("thousand", "k"), 1e3)
            .otherwise(1.0)
        )
        number = F.regexp_replace(hit, r"[^0-9.]", "").try_cast("double")
        return F.floor(number * factor).cast("bigint")

    return F.array_compact(F.transform(hits, amount))


def liability(body: Column, agency: Column) -> Column:
    """Struct of low, high and concrete; the agency's usual range when the text names no amount."""
    amounts = dollar_amounts(body)
    concrete = F.size(amounts) > 0
    usual = lambda i: lookup(agency, {a: r[i] for a, r in vocab.PENALTY_RANGES.items()},
                             vocab.DEFAULT_PENALTY_RANGE[i]).cast("bigint")
    return F.struct(
        F.when(concrete, F.array_min(amounts)).otherwise(usual(0)).alias("low"),
        F.when(concrete, F.array_max(amounts)).otherwise(usual(1)).alias("high"),
        concrete.alias("concrete"),
    )


def money_mentions(body: Column) -> Column:
    return F.regexp_count(text(body), F.lit(ANY_MONEY))
