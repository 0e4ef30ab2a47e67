"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.text import ascii_digits, squeeze

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
FULL_MONTHS = "january february march april may june july august september october november december".split()
NUMERIC, NAMED = "^(\\d{1,2})[ /.-]+(\\d{1,2})[ /.-]+(\\d{2,4})$", "^(\\d{1,2})[ -]+([A-Za-z]+)[ -]+(\\d{2,4})$"


def _ready(x: Column) -> Column:
    t = F.regexp_replace(ascii_digits(squeeze(x)), ",", " ")
    return squeeze(F.regexp_replace(t, "(?i)(\\d+)(st|nd|rd|th)\\b", "$1"))


def _year(y: Column) -> Column:
    return F.when(y < 100, y + F.when(y <= 69, 2000).otherwise(1900)).otherwise(y)


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")


def _part(t: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(t, pattern, i).try_cast("int")


def _day_first(t: Column) -> tuple[Column, Column, Column]:
    return tuple(_part(t, NUMERIC, i) for i in (1, 2, 3))


def parse_date(x: Column) -> Column:
    """yyyy-MM-dd, day.month.year in figures (day first; swapped if only that fits), or day month-name year; else null."""
    t = _ready(x)
    a, b, y = _day_first(t)
    swap = (b > 12) & a.between(1, 12)
    month = F.regexp_extract(t, NAMED, 2)
    names = F.when(F.lit(False), 0)
    for i, (short, full) in enumerate(zip(MONTHS, FULL_MONTHS), 1):
        names = names.when(F.lower(month).isin(short, full), i)
    return (
        F.when(t.rlike("^\\d{4}-\\d{1,2}-\\d{1,2}$"), _date(*[_part(t, "^(\\d{4})-(\\d{1,2})-(\\d{1,2})$", i) for i in (1, 2, 3)]))
        .when(t.rlike(NUMERIC), _date(_year(y), F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a)))
        .when(t.rlike(NAMED), _date(_year(_part(t, NAMED, 3)), names, _part(t, NAMED, 1)))
    )


def is_ambiguous(x: Column) -> Column:
    """Whether day and month could change places."""
    t = _ready(x)
    a, b, _ = _day_first(t)
    return F.coalesce(t.rlike(NUMERIC) & (a <= 12) & (b <= 12) & (a != b), F.lit(False))


def date_notes(x: Column, as_of: Column, parsed: Column | None = None) -> Column:
    """What is odd about a date text on a given day. parsed: its date, where a column has it already."""
    d = parse_date(x) if parsed is None else parsed
    notes = F.array(
        F.when(is_ambiguous(x), "DATE_AMBIGUOUS_DAY_FIRST"),
        F.when(x.isNull(), "DATE_MISSING").when(d.isNull(), "DATE_INVALID"),
        F.when(d < F.lit("2017-07-01").cast("date"), "DATE_BEFORE_GST"),
        F.when(d > F.date_add(as_of, 1), "DATE_IN_FUTURE"),
        F.when(d < F.add_months(as_of, -96), "DATE_VERY_OLD"),
    )
    return F.filter(notes, lambda n: n.isNotNull())


def fiscal_year(d: Column) -> Column:
    """April to March, as 2024-25."""
    start = F.year(d) - F.when(F.month(d) >= 4, 0).otherwise(1)
    return F.when(d.isNotNull(), F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0")))


def cell_date(x: Column) -> Column:
    """A spreadsheet cell's date: ISO (with or without a time), then day first with / - or dots, then two-digit years."""
    t = F.trim(x)
    iso = F.when(t.rlike("^\\d{4}-\\d{2}-\\d{2}([T ].*)?$"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
    full = F.when(t.rlike("^\\d{1,2}([/.-])\\d{1,2}\\1\\d{4}$"), F.try_to_date(F.translate(t, ".-", "//"), "d/M/yyyy"))
    y = F.regexp_extract(t, "/(\\d{2})$", 1).try_cast("int")
    wide = F.concat(F.regexp_extract(t, "^(.*/)\\d{2}$", 1), (y + F.when(y <= 68, 2000).otherwise(1900)).cast("string"))
    short = F.when(t.rlike("^\\d{1,2}/\\d{1,2}/\\d{2}$"), F.try_to_date(wide, "d/M/yyyy"))
    return F.coalesce(iso, full, short)


def key_date(x: Column) -> Column:
    """The date at the start of a text, for keys."""
    return F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd")
