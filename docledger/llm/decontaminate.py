"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with at most k edits, cut into k + 1 pieces at least, leaves one piece unharmed. All
pieces are searched at once (Aho-Corasick); a hit's neighbouring piece must then agree but for one edit, as must hold for
one pair of pieces; what is left is verified with Myers' bit-parallel distance over the whole item.

Texts stay where they are: the items are a stated query set, taken to the workers in blocks of bounded size.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import Shared, arrow_limits

#: Edits allowed for each character of an item, shortest item (normalised) that may have edits, characters of items in one block.
RATE, SHORTEST, BLOCK_CHARS = 0.1, 20, 4_000_000

MATCH = "array<struct<item_id:long,distance:int,budget:int>>"


def normalise(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str, limit: int) -> int:
    """The least edit distance between the pattern and any substring of the text, or limit + 1 if above the limit."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    return _myers(peq, m, text, limit)


def _myers(peq: dict[str, int], m: int, text: str, limit: int) -> int:
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best = score
    for c in text:
        eq = peq.get(c, 0)
        x = eq | vn
        d0 = ((((eq & vp) + vp) ^ vp) | x) & full
        hp, hn = vn | (full & ~(d0 | vp)), d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
            if score < best:
                best = score
        hp, hn = hp << 1 & full, hn << 1 & full  # any start in the text is free
        vp, vn = hn | (full & ~(d0 | hp)), hp & d0
    return best if best <= limit else limit + 1


class Matcher:
    """Finds a block of items in texts. items: (item_id, text); an item shorter than SHORTEST is found as it is, between word bounds."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, shortest: int = SHORTEST):
        import ahocorasick

        self.items, pieces = [], defaultdict(list)
        for item_id, text in items:
            text = normalise(text)
            if not text:
                continue
            if len(text) < shortest:
                pieces[text].append((len(self.items), 0, True, "", None))
                self.items.append((item_id, text, 0, {}))
                continue
            budget = int(rate * len(text))
            # Pairs of pieces, so many that one of them has one edit at most; of its two pieces one has none then.
            pairs = budget // 2 + 1
            bounds = [len(text) * i // (2 * pairs) for i in range(2 * pairs + 1)]
            peq: dict[str, int] = {}
            for i, c in enumerate(text):
                peq[c] = peq.get(c, 0) | 1 << i
            for i in range(2 * pairs):
                a, b = bounds[i], bounds[i + 1]
                other = text[b : bounds[i + 2]] if i % 2 == 0 else text[bounds[i - 1] : a]
                pieces[text[a:b]].append((len(self.items), a, i % 2 == 0, other, budget))
            self.items.append((item_id, text, budget, peq))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if self.items:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, least distance, budget) of each item found, by item_id."""
        if not self.items or not text:
            return []
        text = normalise(text)
        found: dict[int, int] = {}
        tried: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            begin = end + 1 - size
            for k, offset, first, other, budget in where:
                best = found.get(k)
                if best == 0:
                    continue
                if budget is None:
                    if not (_joins(text, begin) or _joins(text, end + 1)):
                        found[k] = 0
                    continue
                if budget and not _beside(text, begin, end + 1, first, other):
                    continue
                at = begin - offset
                item_id, item, _, peq = self.items[k]
                if at >= 0 and text.startswith(item, at):
                    found[k] = 0
                    continue
                if any(abs(at - x) <= budget for x in tried.get(k, ())):
                    continue
                tried.setdefault(k, []).append(at)
                # A match with this piece starts within the budget of here, and hits so near are not tried again.
                d = _myers(peq, len(item), text[max(0, at - 2 * budget) : at + len(item) + 2 * budget], budget)
                if d <= budget and (best is None or d < best):
                    found[k] = d
        return sorted((self.items[k][0], d, self.items[k][2]) for k, d in found.items())


def _joins(text: str, at: int) -> bool:
    """Whether a word goes on from the character before a place to the one there."""
    return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()


def _beside(text: str, begin: int, end: int, first: bool, other: str) -> bool:
    """Whether the piece beside a hit can agree but for one edit: its half next to the hit stands there, or its far half does, moved by one at most."""
    n, half = len(other), len(other) // 2
    if first:
        return text.startswith(other[:half], end) or any(text.startswith(other[half:], end + half + s) for s in (0, -1, 1))
    near = other[half:]
    if begin >= len(near) and text.startswith(near, begin - len(near)):
        return True
    return any(begin - n + s >= 0 and text.startswith(other[:half], begin - n + s) for s in (0, -1, 1))


def _blocks(items: DataFrame, id_col: str, text_col: str) -> list[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_CHARS, each gathered by itself."""
    items = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // BLOCK_CHARS))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    return [[tuple(r) for r in items.where(block == b).distinct().collect()] for b in range(n)]


def _finder(shared: Shared):
    @F.pandas_udf(MATCH)
    def find(texts: pd.Series) -> pd.Series:
        of = shared.get(lambda x: Matcher(*x)).find
        return texts.map(lambda t: [{"item_id": i, "distance": d, "budget": b} for i, d, b in of(t)])

    return find


def matches(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE) -> Column:
    """array<struct<item_id, distance, budget>>: the items that occur in the text, with their least distance; never null.

    Both sides are compared in lower case with white space runs as one space. A null or empty text holds nothing. Items
    with a null id or text, or without a character, are not searched; those shorter than SHORTEST must occur exactly and as
    whole words; repeated items count once; items of
    one id and several texts give an entry for each text found.
    """
    arrow_limits(docs.sparkSession)
    text = F.col(text_col)
    parts = [_finder(Shared(docs.sparkSession, (block, rate)))(text) for block in _blocks(items, item_id, item_text)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance and budget of every document and the items that occur in it. Repeated rows each give their own."""
    found = docs.select(F.col(id_col).alias("doc_id"), matches(docs, items, text_col).alias("found"))
    return found.select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.item_id", "m.distance", "m.budget")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents in which no item occurs, with the columns they had."""
    return docs.where(F.size(matches(docs, items, text_col)) == 0)
