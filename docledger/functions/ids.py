"""Identifier expressions: tax numbers, codes and contact numbers. `*_note` says what is wrong, null if nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions import dims
from docledger.functions.text import ascii_digits, compact, lookalikes, squeeze

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GSTIN = "^([0-9]{2})([A-Z]{5}[0-9]{4}[A-Z])([1-9A-Z])Z([0-9A-Z])$"

#: What documents hold, as patterns. A candidate is what may be a tax number that was read wrongly.
PATTERNS = {
    "gstin": r"(?i)\b\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b",
    "candidate": r"(?i)(?<![A-Z0-9])[A-Z0-9][A-Z0-9 -]{12,17}[A-Z0-9](?![A-Z0-9])",
    "date": r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})\b",
    "amount": r"(?i)(?<![A-Z])(?:[₹$€£]\s*|INR\s*|Rs\.?\s*)?-?\d[\d,]*(?:\.\d{1,2})?(?:/-|=\d{2})?",
    "pan": r"(?i)\b[A-Z]{5}\d{4}[A-Z]\b",
    "phone": r"(?:\+91[\s-]?)?[6-9]\d{9}\b",
    "email": r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b",
    "pincode": r"\b[1-9]\d{5}\b",
    "ifsc": r"(?i)\b[A-Z]{4}0[A-Z0-9]{6}\b",
    "irn": r"(?i)\b[0-9a-f]{64}\b",
}


def found(text: Column, kind: str) -> Column:
    """array<string>: all that a text holds of a kind of PATTERNS, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))


def gstin_normal(x: Column) -> Column:
    t = F.upper(F.regexp_replace(x, "[\\s-]+", ""))
    return F.when(t != "", t)


def gstin_check(first14: Column) -> Column:
    """The check character: digits in base 36, doubled at each second place, their two base-36 digits summed."""
    total = F.lit(0)
    for i in range(14):
        p = (F.instr(F.lit(ALPHABET), F.substring(first14, i + 1, 1)) - 1) * (1 + i % 2)
        total = total + F.floor(p / 36).cast("int") + p % 36
    return F.when(first14.rlike("^[0-9A-Z]{14}$"), F.substring(F.lit(ALPHABET), (36 - total % 36) % 36 + 1, 1))


def gstin_parts(x: Column) -> Column:
    """struct<state_code, pan, entity, check_char>, or null."""
    t = gstin_normal(x)
    names = ("state_code", "pan", "entity", "check_char")
    return F.when(t.rlike(GSTIN), F.struct(*[F.regexp_extract(t, GSTIN, i + 1).alias(n) for i, n in enumerate(names)]))


def gstin_valid(x: Column) -> Column:
    t = gstin_normal(x)
    state = F.substring(t, 1, 2)
    return F.coalesce(t.rlike(GSTIN) & state.isin(*dims.STATE_CODES) & (state != "96") & (gstin_check(F.substring(t, 1, 14)) == F.substring(t, 15, 1)), F.lit(False))


def make_gstin(state: Column, pan: Column, entity: Column) -> Column:
    """A valid number for a state (code, name or alias), or null."""
    code = F.substring(state_of(state), 1, 2)
    p, e = F.upper(F.regexp_replace(pan, " ", "")), F.upper(entity)
    first = F.concat(code, p, e, F.lit("Z"))
    return F.when((code != "96") & p.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$") & e.rlike("^[1-9A-Z]$"), F.concat(first, gstin_check(first)))


def pan(x: Column) -> Column:
    t = F.upper(F.regexp_replace(squeeze(x), "\\s+", ""))
    return F.when(t != "", t)


def pan_note(x: Column) -> Column:
    t = F.coalesce(pan(x), F.lit(""))
    return F.when(t == "", "PAN_MISSING").when(~t.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), "PAN_FORMAT").when(~F.substring(t, 4, 1).isin(*"PCHFATBLJG"), "PAN_ENTITY_TYPE")


def invoice_no(x: Column) -> Column:
    t = squeeze(x)
    return F.when(t != "", t)


def invoice_no_note(x: Column) -> Column:
    t = F.coalesce(squeeze(x), F.lit(""))
    return F.when(t == "", "INVOICE_NUMBER_MISSING").when((F.length(t) > 16) | ~t.rlike("^[A-Za-z0-9/\\\\.\\- ]+$"), "INVOICE_NUMBER_RULE46")


def digits(x: Column) -> Column:
    return F.regexp_replace(ascii_digits(squeeze(x)), "[^0-9]", "")


def hsn(x: Column) -> Column:
    d = digits(x)
    return F.when(d != "", d)


def hsn_note(x: Column) -> Column:
    d = F.coalesce(digits(x), F.lit(""))
    fine = (F.length(d).isin(4, 6, 8) & F.substring(d, 1, 2).isin(*dims.HSN_CHAPTERS)) | ((F.length(d) == 6) & d.startswith("99"))
    return F.when(d == "", "HSN_MISSING").when(~fine, "HSN_FORMAT")


def hsn_padded(x: Column) -> Column:
    """Digits padded with zeros to the next of 4, 6 and 8; other texts as they are."""
    t = F.trim(x)
    n = F.length(t)
    return F.when(t.rlike("^[0-9]+$") & ~n.isin(4, 6, 8), F.when(n < 4, F.lpad(t, 4, "0")).when(n < 6, F.lpad(t, 6, "0")).when(n < 8, F.lpad(t, 8, "0")).otherwise(t)).otherwise(t)


def pincode(x: Column) -> Column:
    return F.regexp_replace(lookalikes(ascii_digits(squeeze(x))), "[^0-9]", "")


def pincode_ok(x: Column) -> Column:
    return pincode(x).rlike("^[1-9][0-9]{5}$")


def phone(x: Column) -> Column:
    """Ten digits without the country's prefix, else the text."""
    d = digits(x)
    d = F.when(d.startswith("91") & (F.length(d) == 12), F.substring(d, 3, 10)).otherwise(d)
    d = F.when(d.startswith("0") & (F.length(d) == 11), F.substring(d, 2, 10)).otherwise(d)
    t = squeeze(x)
    return F.when(d.rlike("^[6-9][0-9]{9}$"), d).when(t != "", t)


def ifsc(x: Column) -> Column:
    t = F.upper(F.regexp_replace(squeeze(x), "\\s+", ""))
    return F.when(t != "", t)


def ifsc_ok(x: Column) -> Column:
    return F.coalesce(ifsc(x).rlike("^[A-Z]{4}0[A-Z0-9]{6}$"), F.lit(False))


def state_of(x: Column) -> Column:
    """`code-name` of a state by code, name or alias; null if unknown."""
    return F.element_at(dims.mapping(dims.state_keys()), compact(x))


def state(x: Column) -> Column:
    """`code-name`, or the text if unknown."""
    t = squeeze(x)
    return F.when(t != "", F.coalesce(state_of(t), t))


def unit(x: Column) -> Column:
    """The unit's code, or the text in capitals if unknown."""
    t = F.replace(F.lower(squeeze(x)), F.lit("."), F.lit(""))
    return F.when(t != "", F.coalesce(F.element_at(dims.mapping(dims.UNIT_NAMES), t), F.upper(t)))


def unit_known(x: Column) -> Column:
    return F.coalesce(unit(x).isin(*dims.UNITS), F.lit(False))
