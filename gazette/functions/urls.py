"""URLs in prose and their normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.common import text

IN_PROSE = r"""(?i)https?://[^\s<>"']+"""
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _trimmed(url: Column) -> Column:
    """Drop closing punctuation, and each closing bracket that no opening bracket balances.

    The tail of punctuation and brackets is cut to the longest prefix whose last character may stay: a
    closing bracket stays once the brackets before it balance.
    """
    tail = F.regexp_extract(url, r"[.,;:!?)]*$", 0)
    body = F.substring(url, F.lit(1), F.length(url) - F.length(tail))
    opened = F.length(url) - F.length(F.replace(url, F.lit("("), F.lit("")))
    closed_before = F.length(body) - F.length(F.replace(body, F.lit(")"), F.lit("")))
    allowed = F.greatest(opened - closed_before, F.lit(0))
    # Keep the tail through its last balanced bracket; with none to keep, drop the tail.
    brackets = F.length(tail) - F.length(F.replace(tail, F.lit(")"), F.lit("")))
    kept = F.least(allowed, brackets)
    pieces = F.split(tail, r"\)")
    keep_tail = F.when(kept > 0, F.concat(F.array_join(F.slice(pieces, F.lit(1), kept), ")"), F.lit(")")))
    return F.concat(body, F.coalesce(keep_tail, F.lit("")))


def extract_urls(body: Column) -> Column:
    """Web addresses named in a text, in order, repeats kept."""
    found = F.transform(F.regexp_extract_all(text(body), F.lit(IN_PROSE), F.lit(0)), _trimmed)
    return F.filter(found, lambda u: u.rlike(r"(?i)^https?://[^/?#\s]+"))


def normal_url(url: Column) -> Column:
    """Lower scheme and host, no closing slash on the path; query and fragment untouched."""
    url = F.trim(url)
    part = lambda i: F.regexp_extract(url, PARTS, i)
    bare = lambda c: F.when(F.length(c) > 1, c).otherwise("")
    return F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.regexp_replace(part(3), "/+$", ""),
                    bare(part(4)), bare(part(5)))


def source_url(direct: Column, base: Column) -> Column:
    """The direct link if it is a web address, else the site's address."""
    site = F.regexp_replace(text(base), "^https?://", "")
    return F.when(text(direct).startswith("http"), direct).when(text(base) != "", F.concat(F.lit("https://"), site)) \
            .otherwise("")
