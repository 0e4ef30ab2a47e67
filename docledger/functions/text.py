"""String expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of other scripts: the zero of each block.
ZEROS = "٠۰߀०০੦૦୦௦౦೦൦෦๐໐༠၀០᠐０"


def ascii_digits(x: Column) -> Column:
    return F.translate(x, "".join(chr(ord(z) + i) for z in ZEROS for i in range(10)), "0123456789" * len(ZEROS))


def squeeze(x: Column) -> Column:
    """White space, no-break spaces among it, as single spaces; zero-width characters go; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[\u200b\u200c\u200d\ufeff]", ""), "[\\s\u00a0\u2000-\u200a\u202f\u3000]+", " "))


def nfkc(x: Column) -> Column:
    """Compatibility form. Only texts beyond ASCII go to Python, as Arrow batches."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    beyond = x.rlike("[^\\x00-\\x7F]")
    return F.when(beyond, form(F.when(beyond, x))).otherwise(x)


def clean_text(x: Column, unicode_form: bool = False) -> Column:
    return squeeze(nfkc(x) if unicode_form else x)


def lookalikes(x: Column) -> Column:
    """Letters that are read for digits, as digits."""
    return F.translate(x, "OoIl|SsBb", "001115588")


def cell(x: Column) -> Column:
    """A spreadsheet cell as text: spaces trimmed, a leading apostrophe gone, Devanagari digits as ASCII."""
    t = F.trim(F.translate(F.coalesce(x, F.lit("")), "\u00a0\u200b", " "))
    return F.translate(F.regexp_replace(t, "^'", ""), "०१२३४५६७८९", "0123456789")


def label(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9%]+", " "))


def plain_label(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def compact(x: Column) -> Column:
    return F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")


def safe_filename(x: Column) -> Column:
    """The last part of a path with letters, digits, dots, spaces, hyphens and underscores only, 120 characters at most; `upload` if nothing is left."""
    base = F.regexp_replace(F.regexp_extract(x, "([^/\\\\]*)$", 1), "[^A-Za-z0-9._ -]", "_")
    return F.coalesce(F.nullif(F.substring(F.trim(base, F.lit(" .")), 1, 120), F.lit("")), F.lit("upload"))


def formula_safe(x: Column) -> Column:
    """A text that a spreadsheet will not run: an apostrophe before = + @ tab, return, or a minus that starts no number."""
    risky = x.rlike("^[=+@\\t\\r]") | (x.startswith("-") & ~x.rlike("^-[0-9]+(\\.[0-9]+)?$"))
    return F.when(risky, F.concat(F.lit("'"), x)).otherwise(x)


def without_unclear(x: Column) -> Column:
    """A handwritten text without marks for unclear places and control characters."""
    t = F.regexp_replace(x, "(?i)%(?:math|na|sc|unclear|illegible|strike|deleted|insert)%", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[\\x00-\\x1F\\x7F-\\x{9F}]", " "), "\\s+", " "))


#: Characters that handwriting is read for, and what they stand for among figures and among letters.
FIGURES_FROM, FIGURES_TO = "OoQDIl|i!ZzSs$bB", "0000111112255568"
LETTERS_FROM, LETTERS_TO = "01582", "OISBZ"


def handwritten(x: Column, kind: str) -> Column:
    """Characters read as the kind expected: numeric or alpha."""
    return F.translate(without_unclear(x), FIGURES_FROM, FIGURES_TO) if kind == "numeric" else F.translate(without_unclear(x), LETTERS_FROM, LETTERS_TO)


#: What a date, an amount, a quantity, a label and an identifier look like.
DATE_LIKE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b|(?i)\b\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4}\b"
AMOUNT_LIKE = r"(?i)^(?:(?:[₹$€£]|INR|Rs\.?)\s*-?\d[\d,]*(?:\.\d{1,2})?|-?\d[\d,]*(?:\.\d{1,2})?\s*(?:/-)?$)"
QUANTITY_LIKE = r"(?i)^\d+(?:\.\d+)?\s*(?:nos|pcs|qty|units?|kgs?|ltrs?|each|boxes)?$"
LABEL_LIKE = r"invoice|bill|tax|total|date|seller|buyer|client"
IDENTIFIER_LIKE = r"(?i)^[A-Z0-9][A-Z0-9/\-_]{3,24}$"


def semantic_role(x: Column) -> Column:
    """What a handwritten token is: empty, date, amount, quantity, label, identifier or text."""
    t = F.coalesce(without_unclear(x), F.lit(""))
    return (
        F.when(t == "", "empty").when(t.rlike(DATE_LIKE), "date").when(t.rlike(AMOUNT_LIKE) | t.rlike("[₹$€£]"), "amount").when(t.rlike(QUANTITY_LIKE), "quantity")
        .when(F.lower(t).rlike(LABEL_LIKE), "label").when(t.rlike(IDENTIFIER_LIKE) & t.rlike("\\d"), "identifier").otherwise("text")
    )


def interpreted(tokens, text: str = "text", kind: str = "kind"):
    """Tokens with role and reading: handwritten ones without marks of unclear places, as figures where their role says so."""
    hand = F.col(kind) == "handwritten"
    role = F.when(hand, semantic_role(F.col(text)))
    reading = F.when(role.isin("amount", "quantity"), handwritten(F.col(text), "numeric")).when(hand, without_unclear(F.col(text))).otherwise(F.col(text))
    return tokens.withColumns({"role": role, "reading": reading})
