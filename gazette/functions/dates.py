"""Dates out of dirty text. A bad date becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette import vocab
from gazette.functions.common import first_filled, lookup, text

MONTH_NUMBERS = {m: i for i, m in enumerate(vocab.MONTHS, 1)}
MONTH_SHORT = {m[:3]: f"{i:02d}" for m, i in MONTH_NUMBERS.items()}
# Full names, three-letter forms and "sept", as a strict date accepts them.
MONTH_STRICT = {**MONTH_NUMBERS, **{m[:3]: i for m, i in MONTH_NUMBERS.items()}, "sept": 9}


def iso_day(c: Column) -> Column:
    """A date from the first ten characters of an ISO text."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def pub_day(date: Column | str = "pub_date", valid: Column | str = "pub_date_valid") -> Column:
    """Publication date, null unless flagged valid and parsable."""
    date, valid = (F.col(x) if isinstance(x, str) else x for x in (date, valid))
    return F.when(valid, iso_day(date))


def age_days(as_of: Column | str, day: Column | None = None) -> Column:
    """Whole days from the publication date to the as-of date; negative for the future."""
    as_of = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    return F.datediff(as_of, pub_day() if day is None else day)


def within_age(as_of: Column | str, max_age: int, day: Column | None = None) -> Column:
    """Age from 0 to max_age, both included."""
    return age_days(as_of, day).between(0, max_age)


def lenient_day(c: Column) -> Column:
    """ISO text from yyyymmdd, an ISO prefix or "19 March 2026"; else the first ten characters."""
    c = text(c)
    packed = F.when(c.rlike("^[0-9]{8}$"), F.try_to_date(c, "yyyyMMdd"))
    spelled = F.when(F.trim(c).rlike("^[0-9]{1,2} [A-Za-z]+ [0-9]{4}$"), _spelled(F.trim(c), 1, 2, 3))
    return F.coalesce(
        packed.cast("string"),
        F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(c, 1, 10)),
        spelled.cast("string"),
        F.substring(c, 1, 10),
    )


def _spelled(c: Column, day: int, month: int, year: int) -> Column:
    part = lambda i: F.split_part(c, F.lit(" "), F.lit(i))
    iso = F.format_string("%s-%02d-%02d", part(year), lookup(F.lower(part(month)), MONTH_NUMBERS),
                          part(day).try_cast("int"))
    return F.try_to_date(iso, "yyyy-MM-dd")


PARTIAL = r"^([0-9]{4})(?:\s+([A-Za-z]+)(?:\s+([0-9]{1,2}))?)?"


def partial_day(c: Column) -> Column:
    """Sortable text from "2026 Mar 17", "2026 Mar" or "2026"; missing parts count as 01."""
    c = F.trim(text(c))
    year, month, day = (F.regexp_extract(c, PARTIAL, i) for i in (1, 2, 3))
    month_number = F.when(month == "", "01").otherwise(
        lookup(F.lower(F.substring(month, 1, 3)), MONTH_SHORT, "01"))
    day_number = F.when(day == "", "01").otherwise(F.lpad(day, 2, "0"))
    return F.when(year == "", "0000-00-00").otherwise(F.concat_ws("-", year, month_number, day_number))


def month_label(c: Column) -> Column:
    """Display form such as "Mar 2026" of a partial date; the raw text when it has none."""
    return F.coalesce(F.date_format(F.try_to_date(partial_day(c), "yyyy-MM-dd"), "MMM yyyy"), c)


STRICT_ISO = (r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?(?:\.[0-9]+)?"
              r"(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$")
STRICT_DAY_FIRST = r"^([0-9]{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})\.?,?\s+([0-9]{4})$"
STRICT_MONTH_FIRST = r"^([A-Za-z]{3,9})\.?\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\s+([0-9]{4})$"


def strict_iso_day(c: Column) -> Column:
    """ISO text of an ISO date or date-time naming a real day, else null."""
    return F.try_to_date(F.nullif(F.regexp_extract(F.trim(c), STRICT_ISO, 1), F.lit("")),
                         "yyyy-MM-dd").cast("string")


def strict_day(c: Column) -> Column:
    """ISO text of a date that reads only one way; numeric day/month orders are refused."""
    c = F.trim(c)

    def spelled(pattern: str, day: int, month: int) -> Column:
        number = lookup(F.lower(F.regexp_extract(c, pattern, month)), MONTH_STRICT)
        iso = F.format_string("%s-%02d-%02d", F.regexp_extract(c, pattern, 3), number,
                              F.regexp_extract(c, pattern, day).try_cast("int"))
        return F.when(c.rlike(pattern) & number.isNotNull(), F.try_to_date(iso, "yyyy-MM-dd").cast("string"))

    return F.coalesce(strict_iso_day(c), spelled(STRICT_DAY_FIRST, 1, 2), spelled(STRICT_MONTH_FIRST, 2, 1))


def first_time(*cols: Column) -> Column:
    """First of several texts that parses as a timestamp."""
    return F.coalesce(*[F.try_to_timestamp(c) for c in cols])


def age_label(ts: Column, as_of: Column) -> Column:
    """"just now", "3h ago" or "2d ago"; "recently" without a time."""
    hours = F.floor((F.unix_seconds(as_of) - F.unix_seconds(ts)) / F.lit(3600)).cast("bigint")
    return (
        F.when(ts.isNull(), "recently")
        .when(hours < 1, "just now")
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(hours / F.lit(24)).cast("string"), F.lit("d ago")))
    )


def deadline(body: Column, *dates: Column) -> Column:
    """First filled date field, else a month and year or a quarter named in the text, else a dash."""
    found = F.lower(text(body))
    # The months are tried in calendar order; a month only counts if its full name is in the text.
    by_month = F.coalesce(*[
        F.when(found.contains(m),
               F.nullif(F.initcap(F.regexp_extract(found, m[:3] + r"\w*\s+[0-9]{4}", 0)), F.lit("")))
        for m in vocab.MONTHS
    ])
    quarter = F.nullif(F.upper(F.regexp_extract(found, r"q[1-4]\s*20[0-9][0-9]", 0)), F.lit(""))
    return F.coalesce(first_filled(*dates), by_month, quarter, F.lit("—"))


def quarter_start(day: Column) -> Column:
    return F.trunc(day, "quarter")


def quarter_end(day: Column) -> Column:
    return F.date_sub(F.add_months(quarter_start(day), 3), 1)


def quarter_label(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"), F.lit(" "), F.year(day).cast("string"))


def usable(c: Column, latest: str, earliest: str = "2000-01-01") -> Column:
    """A plain ISO day inside the plausible range; ISO text sorts by time."""
    return F.coalesce(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & c.between(earliest, latest), F.lit(False))


