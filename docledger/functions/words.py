"""Amounts in words, with Indian scales."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.similarity import ratcliff

#: Number words, scales, and words that count for another or for nothing.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"thousand": 1_000, "lakh": 100_000, "crore": 10_000_000}
SAME = {"lac": "lakh", "lakhs": "lakh", "crores": "crore", "paisa": "paise", "rs": "rupees", "inr": "rupees"}
FILLERS = {"and", "only", "rupee"}

NUMBERS = {w: i for i, w in enumerate(UNITS)} | {w: 10 * i for i, w in enumerate(TENS, 2)}
VOCABULARY = [*NUMBERS, "hundred", *SCALES, *SAME, "paise", "rupees", *sorted(FILLERS)]


@lru_cache(maxsize=50_000)
def known_word(word: str) -> tuple[str | None, float]:
    """The vocabulary's word for a written one, and how sure: 1 if the same, else the ratio of the only best one from 0.85 on."""
    if word in VOCABULARY:
        return SAME.get(word, word), 1.0
    ranked = sorted(((ratcliff(word, v), v) for v in VOCABULARY), reverse=True)
    (best, name), (second, _) = ranked[:2]
    return (name, best) if best >= 0.85 and best > second else (None, 0.0)


def _whole(words: list[str]) -> int | None:
    done = hundreds = small = 0
    for w in words:
        if w in FILLERS or w == "rupees":
            continue
        if w in NUMBERS:
            small += NUMBERS[w]
        elif w == "hundred":
            hundreds, small = hundreds + 100 * max(1, small), 0
        elif w in SCALES:
            done, hundreds, small = done + (hundreds + small) * SCALES[w], 0, 0
        else:
            return None
    return done + hundreds + small


def parse(text: str | None) -> tuple[Decimal | None, float]:
    """(amount, mean certainty); (None, 0) if any word is none that amounts are written with."""
    found = [known_word(w) for w in regex.findall(r"[a-z]+", (text or "").casefold())]
    if not found or any(w is None for w, _ in found):
        return None, 0.0
    words = [w for w, _ in found]
    end = words.index("paise") if "paise" in words else len(words)
    if "rupees" in words:
        cut = words.index("rupees")
        rupees, paise = words[:cut], words[cut + 1 : end]
    else:
        rupees, paise = (words[:end], []) if end == len(words) else (words[:end], words[:end])
    a, b = _whole(rupees), _whole(paise)
    if a is None or b is None or b > 99:
        return None, 0.0
    return (Decimal(a) + Decimal(b) / 100).quantize(Decimal("0.01")), sum(c for _, c in found) / len(found)


def _spell(n: int) -> str:
    if n < 20:
        return UNITS[n]
    if n < 100:
        return TENS[n // 10 - 2] + (f" {UNITS[n % 10]}" if n % 10 else "")
    scale, name = next((s, w) for s, w in ((10_000_000, "crore"), (100_000, "lakh"), (1_000, "thousand"), (100, "hundred")) if n >= s)
    return f"{_spell(n // scale)} {name}" + (f" {_spell(n % scale)}" if n % scale else "")


def write(amount) -> str:
    d = Decimal(str(amount)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
    if d < 0:
        return f"minus {write(-d)}"
    whole, paise = divmod(int(d * 100), 100)
    return f"{_spell(whole)} rupees" + (f" and {_spell(paise)} paise" if paise else "") + " only"


def amount_of(text: Column) -> Column:
    """struct<amount decimal(18,2), certainty double> of an amount in words."""

    @F.pandas_udf("amount decimal(18,2), certainty double")
    def of(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(t) for t in s], columns=["amount", "certainty"])

    return of(text)


def words_of(amount: Column) -> Column:
    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else write(v) for v in s], dtype=object)

    return of(amount)
