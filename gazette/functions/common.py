"""Small column helpers shared by the other function modules."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    """True for null and for text of spaces only."""
    return F.coalesce(F.trim(c), F.lit("")) == ""


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first argument that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def lookup(c: Column, values: Mapping, default=None) -> Column:
    """Value of a small fixed map; a literal map folds into the plan, so there is no join."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), c)
    return found if default is None else F.coalesce(found, F.lit(default))


def case(pairs: Iterable[tuple[Column, object]], otherwise=None) -> Column:
    """Value of the first pair whose condition holds."""
    out = F
    for cond, value in pairs:
        out = out.when(cond, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def steps(c: Column, limits: Iterable[tuple], otherwise) -> Column:
    """Label of the first lower limit that the value reaches."""
    return case([(c >= limit, label) for limit, label in limits], otherwise)


def any_of(words: Iterable[str]) -> str:
    """A pattern that finds any of the words as plain text."""
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def mentions(c: Column, words: Iterable[str]) -> Column:
    """True when the lower-cased text has any of the words as a substring."""
    return F.lower(text(c)).rlike(any_of(words))


def first_keyword(c: Column, rules: Iterable[tuple[str, list[str]]], otherwise: str) -> Column:
    """Label of the first rule, in order, with a keyword in the text."""
    return case([(mentions(c, words), label) for label, words in rules], otherwise)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often the expression names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def names_of(flags: Mapping[str, Column]) -> Column:
    """Array of the names whose condition holds, in the given order.

    Nulls go by `array_except`: names differ, and a lambda around all conditions would have each interpreted for every row.
    """
    named = F.array(*[F.when(cond, F.lit(name)) for name, cond in flags.items()])
    return F.array_except(named, F.array(F.lit(None).cast("string")))


def texts(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])
