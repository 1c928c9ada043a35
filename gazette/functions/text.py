"""Text columns: tokens, page furniture, section splits, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette import vocab
from gazette.functions.common import bound, text

# Word ends look at letters of every script, so a word with an accent yields no token.
TOKEN = r"(?U)\b[a-z0-9][a-z0-9]+\b"
HEADING = r"^([0-9]+(?:\.[0-9]+)+|[0-9]+\.)\s+(.+)$"
# Number of a heading of at most three levels.
NUMBER = r"(?:[0-9]+(?:\.[0-9]+){1,2}|[0-9]+\.)"
TOC_LINE = r"\.{2,}\s*[0-9]+\s*$"
PAGE_NUMBER = r"^[0-9]{1,4}$"
BARE_DATE = r"^[0-9]{1,2}\s+\w+\s+[0-9]{4}$"
COPYRIGHT = r"(?i)^©\s*[0-9]{4}.*"


def tokens(body: Column) -> Column:
    """Lower-case words of two characters or more without stop words; repeats kept."""
    words = F.regexp_extract_all(F.lower(text(body)), F.lit(TOKEN), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(vocab.STOP_WORDS))


def runs(items: Column, key=lambda item: item) -> Column:
    """Runs of equal keys in a sorted array: where each begins, from 0, and how many items it has."""
    last = lambda i: key(F.get(items, i - 1))
    starts = F.array_compact(F.transform(items, lambda item, i: F.when((i == 0) | (key(item) != last(i)), i)))
    return bound(starts, lambda at: F.transform(at, lambda start, i: F.struct(
        start.alias("start"), (F.coalesce(F.get(at, i + 1), F.size(items)) - start).alias("size"))))


def counted(words: Column) -> Column:
    """The distinct words of an array in their order, each with its number; linear in sorted words, so long texts are no trouble."""
    return bound(F.sort_array(words), lambda all_words: F.transform(runs(all_words), lambda run: F.struct(
        F.get(all_words, run["start"]).alias("term"), run["size"].alias("n"))))


def lines(body: Column) -> Column:
    """Lines of a text; a line end at the very end starts no further line."""
    return F.split(F.regexp_replace(text(body), r"(?:\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")


def is_furniture(line: Column) -> Column:
    """Copyright notes, bare page numbers and bare dates that repeat on every page."""
    line = F.trim(line)
    return line.rlike(COPYRIGHT) | line.rlike(PAGE_NUMBER) | line.rlike(BARE_DATE)


def strip_furniture(body: Column) -> Column:
    """Text without page furniture; runs of blank lines shrink to one."""
    kept = F.array_join(F.filter(lines(body), lambda l: ~is_furniture(l)), "\n")
    return F.regexp_replace(kept, r"(?dm)^([^\S\n]*)(?:\n[^\S\n]*)+$", "$1")


def furniture_only(body: Column, floor: int = 30) -> Column:
    """Not empty, but with fewer than `floor` characters besides page furniture."""
    real = F.filter(F.transform(lines(body), F.trim), lambda l: (l != "") & ~is_furniture(l))
    size = F.aggregate(real, F.lit(0), lambda total, l: total + F.length(l))
    return (F.trim(text(body)) != "") & (size < floor)


def is_heading(line: Column) -> Column:
    """A numbered heading of at most three levels."""
    number = F.regexp_extract(F.trim(line), HEADING, 1)
    return (number != "") & (F.size(F.split(number, r"\.")) <= 3)


def sections(body: Column) -> Column:
    """Array of (section_id, title, markdown) of a text; one row's text never leaves its row.

    The text is cut in front of each heading in one pass; what comes before the first heading is dropped.
    """
    pieces = F.split(F.regexp_replace(text(body), r"\r\n|\r", "\n"), rf"(?dm)^(?=[^\S\n]*{NUMBER}[^\S\n]+\S)")
    first_line = rf"(?d)^[^\S\n]*({NUMBER})[^\S\n]+(\S[^\n]*)"

    def section(piece: Column) -> Column:
        return F.struct(
            F.rtrim(F.regexp_extract(piece, first_line, 1), F.lit(".")).alias("section_id"),
            F.regexp_replace(F.regexp_extract(piece, first_line, 2), r"\s+\z", "").alias("title"),
            F.regexp_replace(F.regexp_replace(piece, r"(?d)^[^\n]*", ""), r"^\s+|\s+\z", "").alias("markdown"),
        )

    return F.transform(F.filter(pieces, lambda p: p.rlike(first_line)), section)


def content_hash(value: Column, length: int = 16) -> Column:
    """Leading hex digits of the digest of a value's JSON text."""
    return F.substring(F.sha2(F.to_json(value), 256), 1, length)


def slim_json(**fields: Column) -> Column:
    """JSON of the given fields without null or empty ones."""
    return F.to_json(F.struct(*[F.nullif(c, F.lit("")).alias(n) for n, c in fields.items()]),
                     {"ignoreNullFields": "true"})


def search_text(*fields: Column) -> Column:
    """Filled fields, one per line."""
    return F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in fields])


