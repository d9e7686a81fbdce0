"""Dates in the headings of notes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_NAME = r"(?i)^(?:mon|tues?|wednes|thurs?|fri|satur|sun)(?:day)?\.?,? +"


def _g(t: Column, rx: str, i: int) -> Column:
    return F.regexp_extract(t, rx, i)


def _hit(t: Column, rx: str, order: str) -> Column:
    """The first hit of ``rx`` with its groups in another order, '' for none.  One extraction, one replacement."""
    return F.regexp_replace(F.regexp_extract(t, rx, 0), rx, order)


def _ymd(text: Column) -> Column:
    return F.try_to_date(F.regexp_replace(text, r"^(\d{2})-", "20$1-"), "yyyy-M-d")


def parse_date(text: Column, fallback_year: Column | None = None) -> Column:
    """The first date of a text, or null.

    Tried in order: YYYYMMDD, ISO, M/D/Y (or M/D of the fallback year), M.D.Y
    or M-D-Y, Month D[, Y].  Each form takes its first hit; an impossible date
    falls through to the next form, but M/D isn't tried after an M/D/Y.
    """
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), _DAY_NAME, "")
    compact = r"(?<!\d)(20\d{2})(\d{2})(\d{2})(?!\d)"
    iso = r"(?<!\d)(\d{4})-(\d{1,2})-(\d{1,2})(?!\d)"
    slash = r"(?<!\d)(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})(?!\d)"
    dotted = r"(?<![\d.\-])(\d{1,2})[.\-](\d{1,2})[.\-](\d{4}|\d{2})(?!\d)"
    named = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? (\d{1,2})(?:st|nd|rd|th)?(?:,? +(\d{4}))?(?!\d)"
    forms = [_ymd(_hit(t, compact, "$1-$2-$3")), _ymd(_hit(t, iso, "$1-$2-$3")), _ymd(_hit(t, slash, "$3-$1-$2"))]
    month = F.initcap(_hit(t, named, "$1 $2 $3"))
    if fallback_year is not None:
        year = fallback_year.cast("string")
        short = r"(?<![\d/])(\d{1,2})/(\d{1,2})(?![\d/])"
        forms.append(F.when(~t.rlike(slash), _ymd(F.concat_ws("-", year, _hit(t, short, "$1-$2")))))
        month = F.when(month.endswith(" "), F.concat(month, year)).otherwise(month)
    forms.append(_ymd(_hit(t, dotted, "$3-$1-$2")))
    forms.append(F.try_to_date(month, "MMM d yyyy"))
    return F.coalesce(*forms)


def is_ambiguous(text: Column) -> Column:
    """Whether day and month of an all-number date could be swapped."""
    rx = r"(?<!\d)(\d{1,2})[/.\-](\d{1,2})[/.\-](?:\d{4}|\d{2})(?!\d)"
    a, b = _g(text, rx, 1).try_cast("int"), _g(text, rx, 2).try_cast("int")
    return F.coalesce((a <= 12) & (b <= 12) & (a != b), F.lit(False))


def is_date_header(line: Column, previous: Column) -> Column:
    """Whether a line heads a dated entry.

    It has a full date within its first four words, fewer than ten words, and
    the line before it is blank, a heading or itself a date.
    """
    bare = F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"^#+ *", ""))
    n = F.size(F.split(bare, r"\s+"))
    head = F.array_join(F.slice(F.split(bare, r"\s+"), 1, 4), " ")
    before = F.trim(F.coalesce(previous, F.lit("")))
    return (bare != "") & (n < 10) & parse_date(head).isNotNull() & ((before == "") | before.startswith("#") | parse_date(before).isNotNull())


def recording_time(name: Column) -> Column:
    """The time in the name of a recording, ``YYYYMMDD HH:MM:SS``, as an ISO text."""
    rx = r"(\d{4})(\d{2})(\d{2}) (\d{2}:\d{2}:\d{2})"
    return F.when(name.rlike(rx), _hit(name, rx, "$1-$2-$3T$4"))
