"""Typed readings of text cells, as Column expressions; what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
TRUE_WORDS = ("1", "true", "t", "yes", "y", "present", "available", "submitted", "enclosed", "attached", "on", "हाँ")
FALSE_WORDS = ("0", "false", "f", "no", "n", "absent", "not present", "not available", "nil", "off", "नहीं")

_DAY_FIRST = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})$"
_YEAR_FIRST = r"^(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})$"
_DAY_NAME = r"^(\d{1,2})(?:st|nd|rd|th)?[\s.\-/]*([a-z]{3,9})\.?[\s,.\-/]*(\d{4}|\d{2})$"
_NAME_DAY = r"^([a-z]{3,9})\.?\s*(\d{1,2})(?:st|nd|rd|th)?[\s,.\-]+(\d{4}|\d{2})$"
_MONTH_WORD = (
    r"^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?(ember)?|oct(ober)?|nov(ember)?|dec(ember)?)$"
)


def _trimmed(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def _ymd(year: Column, month: Column, day: Column) -> Column:
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _month(word: Column) -> Column:
    known = F.when(word.rlike(_MONTH_WORD), F.substring(word, 1, 3))
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), known).cast("string")


def read_date(text: Column) -> Column:
    """A date, or null. All-digit dates put the day first unless they open with a four-digit year; two-digit years are 20yy;
    impossible dates (31 February, month 13) are null."""
    t = F.regexp_replace(_trimmed(text), r"^(?:dated|dt\.?|date|on)\s*[:.]?\s*", "")
    g = lambda rx, k: F.regexp_extract(t, rx, k)
    return (
        F.when(t.rlike(_YEAR_FIRST), _ymd(g(_YEAR_FIRST, 1), g(_YEAR_FIRST, 2), g(_YEAR_FIRST, 3)))
        .when(t.rlike(_DAY_FIRST), _ymd(g(_DAY_FIRST, 3), g(_DAY_FIRST, 2), g(_DAY_FIRST, 1)))
        .when(t.rlike(_DAY_NAME), _ymd(g(_DAY_NAME, 3), _month(g(_DAY_NAME, 2)), g(_DAY_NAME, 1)))
        .when(t.rlike(_NAME_DAY), _ymd(g(_NAME_DAY, 3), _month(g(_NAME_DAY, 1)), g(_NAME_DAY, 2)))
    )


def read_boolean(text: Column) -> Column:
    """True or false, or null for words that are neither."""
    t = F.regexp_replace(_trimmed(text), r"[.!]+$", "")
    return F.when(t.isin(*TRUE_WORDS), F.lit(True)).when(t.isin(*FALSE_WORDS), F.lit(False))


def read_integer(text: Column) -> Column:
    """The one run of digits (with grouping commas) of the text as bigint, whatever label precedes it; null with none or several runs."""
    t = _trimmed(text)
    run = F.regexp_replace(F.regexp_extract(t, r"^[^\d]*?(-?\d+(?:,\d+)*)(?:\.0*)?[^\d]*$", 1), ",", "")
    return F.when(run != "", run.try_cast("bigint"))
