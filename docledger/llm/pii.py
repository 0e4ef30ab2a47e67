"""Surrogate generation: personal data and secrets get keyed, type-consistent replacements.

An entity is a kind and a canonical value, so that one person's number keeps one surrogate however it is written, all
over the corpus. The surrogate follows from the key, the entity and an attempt; the distinct entities of all documents
are checked for two that would share a surrogate, or whose surrogate is itself an entity of the corpus (names of all
kinds count as one), and only those few take a later attempt. Texts are scanned twice; they are shuffled only where
the later attempts are too many for every worker.

Names are found by a form of address; where a document names somebody so, its other mentions of these words are replaced
alike. A name keeps its script, its capitals and the endings that tell a woman's surname from a man's.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import Shared, arrow_limits, fresh, materialize, trimmed

#: Entities off the first attempt that every worker is given at most (beyond, they go to their documents by a join), and attempts at most.
BLOCK, ATTEMPTS = 200_000, 50

EMAIL = re.compile(r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
CARD = re.compile(r"(?<![\w.])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\w])")
PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w.])\+\d{11,13}(?!\w)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
CLOUD = re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
SECRET = re.compile(r"""(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b["']?\s*[=:]\s*["']?([A-Za-z0-9_+/\-]{8,})""")
IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:.]*\w)")
#: Forms of address, by gender (n: any).
TITLES = {
    "Mr": "m", "Sir": "m", "Lord": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Signor": "m", "Господин": "m", "Κύριος": "m", "श्री": "m", "السيد": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Lady": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Señorita": "f", "Sra": "f", "Srta": "f", "Signora": "f", "Госпожа": "f", "Κυρία": "f", "श्रीमती": "f", "السيدة": "f",
    "Dr": "n", "Prof": "n", "Professor": "n", "Mx": "n",
}
#: Titles that are other words too, right after a capitalised word: a street's name, a senior.
AMBIGUOUS = ("Dr", "Sr")
_ANY_TITLE = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
_CASED = r"\p{Lu}[\p{L}\p{M}]+(?:['’]\p{Lu}[\p{L}\p{M}]*)*|\p{Lu}['’]\p{Lu}[\p{L}\p{M}]*"
_CASELESS = r"(?!\p{Han})\p{Lo}[\p{Lo}\p{M}]+(?:[ -](?!\p{Han})\p{Lo}[\p{Lo}\p{M}]+)?"
#: One or more titles, initials, and up to three words with a capital, up to two of a script without, or of Han characters.
NAME = regex.compile(rf"(?<![\p{{L}}\p{{M}}\p{{N}}_])((?:(?:{_ANY_TITLE})\.?[ \u00a0])+)((?:\p{{Lu}}\.[ ]?)*)((?:{_CASED})(?:[ -](?:{_CASED})){{0,2}}|{_CASELESS}|\p{{Han}}{{1,3}}(?: \p{{Han}}{{1,2}})?)")
TITLE = regex.compile(rf"(?:{_ANY_TITLE})\.?[ \u00a0]")
WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’]\p{Lu}[\p{L}\p{M}]*)*")
#: Consonants and vowels of generated names; other scripts take the letters of their own block.
SYLLABLES = {"LATIN": ("b c d f g h j k l m n p r s t v w z br dr gl kr st tr".split(), "aeiou"), "CYRILLIC": ("б в г д ж з к л м н п р с т ф х ч ш бр др кр ст тр гл".split(), "аеиоу"), "GREEK": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ κρ στ τρ".split(), "αειου")}
#: Endings of given names by gender, and of surnames (x).
ENDINGS = {
    "LATIN": {"m": ("n", "r", "s", "l", "d", "k"), "f": ("a", "ia", "ina", "ela"), "n": ("is", "en", "il"), "x": ("er", "man", "son", "ov")},
    "CYRILLIC": {"m": ("н", "р", "с", "л"), "f": ("а", "ия", "ина"), "n": ("ь",), "x": ("ов", "ин", "ев")},
    "GREEK": {"m": ("ης", "ος", "ας"), "f": ("α", "η", "ια"), "n": ("ι",), "x": ("ιδ", "ακ", "οπουλ")},
}
#: Endings of surnames that change with gender; a surrogate has the ending of the original.
GENDERED = {"CYRILLIC": re.compile(r"(?<=[оеиы][внй])а$|(?<=[сц]к)(?:ая|ий|ой)$"), "GREEK": re.compile(r"(?:ος|ου|ης|η|ας|α)$")}


def script(word: str) -> str:
    """The script of a word's first letter, as its Unicode name begins."""
    return unicodedata.name(word[0], "LATIN").split()[0]


def stem(word: str) -> tuple[str, str]:
    """A lower-case name without the ending that changes with gender, and this ending."""
    m = GENDERED[script(word)].search(word) if word and script(word) in GENDERED else None
    return (word[: m.start()], m.group()) if m and m.start() > 2 else (word, "")


def plain(word: str) -> str:
    """Lower case; in Greek without accents, which move with the ending."""
    low = word.lower()
    return "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c)) if low and script(low) == "GREEK" else low


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _ip6(text: str) -> str:
    """The full form of an IPv6 address with two groups and a digit at least; else nothing."""
    if text.count(":") < 7 and "::" not in text or len([x for x in text.split(":") if x]) < 2 or not any(c.isdigit() for c in text):
        return ""
    try:
        return ipaddress.IPv6Address(text).exploded
    except ValueError:
        return ""


def names(text: str) -> list[tuple[int, int, str, str]]:
    """Spans of the words of names: those after a form of address, and these words wherever else they stand with a capital.

    A word that the text has in lower case too is replaced only after a form of address. Initials stay.
    """
    if not TITLE.search(text):
        return []
    spans, known = [], {}
    for m in NAME.finditer(text):
        titles = m.group(1).replace(".", " ").split()
        if titles[0] in AMBIGUOUS and regex.search(r"\p{Lu}\p{L}+ $", text[max(0, m.start() - 40) : m.start()]):
            continue
        gender = next((TITLES[t] for t in titles if TITLES.get(t, "n") != "n"), "n")
        words = list(WORD.finditer(text, m.start(3), m.end(3)))
        for i, word in enumerate(words):
            canon, _ = stem(plain(word.group()))
            kind, canon = known.setdefault(canon, (f"name_{'x' if i == len(words) - 1 else gender}", canon))
            spans.append((word.start(), word.end(), kind, canon))
    if not known:
        return []
    taken, small, others = {s[0] for s in spans}, set(), []
    for m in WORD.finditer(text):
        word = m.group()
        if word[0].islower():
            small.add(plain(word))
        elif m.start() not in taken and len(word) > 1 and (hit := known.get(stem(plain(word))[0])):
            others.append((m.start(), m.end(), *hit))
    return spans + [s for s in others if plain(text[s[0] : s[1]]) not in small]


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of the entities in a text, from left to right, none over another."""
    if not text:
        return []
    spans = []
    if "@" in text:
        spans += [(m.start(), m.end(), "email", m.group().lower()) for m in EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        spans += [(m.start(1), m.end(1), "secret", m.group(1)) for m in SECRET.finditer(text) if any(c.isdigit() for c in m.group(1))]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "cloud", m.group()) for m in CLOUD.finditer(text)]
    if re.search(r"[0-9]", text):
        for m in CARD.finditer(text):
            digits = re.sub(r"\D", "", m.group())
            if digits.isascii() and luhn(digits):
                spans.append((m.start(), m.end(), "card", digits))
        for m in IBAN.finditer(text):
            value = m.group().replace(" ", "")
            if value.isascii() and _mod97(value) == 1:
                spans.append((m.start(), m.end(), "iban", value))
        spans += [(m.start(), m.end(), "ssn", m.group()) for m in SSN.finditer(text) if m.group().isascii()]
        spans += [(m.start(), m.end(), "phone", re.sub(r"\D", "", m.group())[-10:]) for m in PHONE.finditer(text) if m.group().isascii()]
        spans += [(m.start(), m.end(), "ip", ".".join(str(int(x)) for x in m.group().split("."))) for m in IP.finditer(text) if m.group().isascii()]
        if ":" in text:
            spans += [(m.start(), m.end(), "ip6", v) for m in IP6.finditer(text) if (v := _ip6(m.group()))]
    spans += names(text)
    out, end = [], 0
    for s in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if s[0] >= end:
            out.append(s)
            end = s[1]
    return out


class _Stream:
    """Keyed numbers that follow from an entity and an attempt."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int):
        self.hash = lambda i: hashlib.blake2b(f"{kind}\0{attempt}\0{i}\0{canon}".encode("utf-8", "surrogatepass"), key=key[:64], digest_size=64).digest()
        self.buffer, self.block = b"", 0

    def below(self, n: int) -> int:
        if len(self.buffer) < 4:
            self.buffer, self.block = self.hash(self.block), self.block + 1
        x, self.buffer = int.from_bytes(self.buffer[:4], "big"), self.buffer[4:]
        return x % n

    def pick(self, choices):
        return choices[self.below(len(choices))]

    def like(self, text: str, hexadecimal: bool = False) -> str:
        """The same kinds of characters: digits, small and capital letters of the same alphabet; the rest as it is."""
        small, capital, digit = ("abcdef", "ABCDEF", "0123456789") if hexadecimal else ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
        if hexadecimal:
            small, capital = small + digit, capital + digit

        def one(c: str) -> str:
            if not c.isascii():
                return self.pick(alike(c)) if c.isalpha() else c
            if hexadecimal and c.isdigit():
                return self.pick(small if text == text.lower() else capital)
            return self.pick(small if c.islower() else capital if c.isupper() else digit) if c.isalnum() else c

        return "".join(map(one, text))


_alike: dict[str, str] = {}


def alike(c: str) -> str:
    """The letters of a letter's block of 64 code points that have its case and keep to themselves in normal form; of Han and Hangul, 2048 from the start of the block."""
    if c not in _alike:
        han, hangul = "\u4e00" <= c <= "\u9fff", "\uac00" <= c <= "\ud7a3"
        start = 0x4E00 if han else 0xAC00 if hangul else ord(c) // 64 * 64
        block = map(chr, range(start, start + (2048 if han or hangul else 64)))
        _alike[c] = "".join(x for x in block if x.isalpha() and x.islower() == c.islower() and x.isupper() == c.isupper() and unicodedata.normalize("NFKC", x) == x) or c
    return _alike[c]


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical surrogate of an entity."""
    s = _Stream(key, kind, canon, attempt)
    if kind == "email":
        local, _, host = canon.partition("@")
        name, dot, top = host.rpartition(".")
        return f"{s.like(local + 'a' * (attempt // 4))}@{s.like(name)}{dot}{top}"
    if kind == "ip6":
        first, *rest = canon.split(":")
        return ":".join([first, *(g if g == "0000" else f"{s.below(0xFFFF) + 1:04x}" for g in rest)])
    if kind == "phone":
        return "".join(str(2 + s.below(8)) if i in (0, 3) else str(s.below(10)) for i in range(len(canon)))
    if kind == "ip":
        return ".".join(str(1 + s.below(223) if i == 0 else s.below(256)) for i in range(4))
    if kind == "card":
        body = canon[0] + "".join(str(s.below(10)) for _ in canon[2:])
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "ssn":
        return f"{100 + s.below(800)}-{10 + s.below(90)}-{1000 + s.below(9000)}"
    if kind == "iban":
        body = s.like(canon[4:])
        return f"{canon[:2]}{98 - _mod97(canon[:2] + '00' + body):02d}{body}"
    if kind == "cloud":
        return "AKIA" + "".join(s.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isalpha() else str(s.below(10)) for c in canon[4:])
    if kind == "secret":
        return s.like(canon, bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canon)))
    letters = script(canon)
    if letters in SYLLABLES:
        consonants, vowels = SYLLABLES[letters]
        end = canon[-2:] if kind == "name_x" and letters == "CYRILLIC" and canon.endswith(("ск", "цк")) else s.pick(ENDINGS[letters][kind[-1]])
        return "".join(s.pick(consonants) + s.pick(vowels) for _ in range(3 + attempt // 4)) + (s.pick(consonants) if end[0] not in vowels else "") * (len(end) == 1) + end
    return s.like(canon + canon[0] * (attempt // 4))


def render(kind: str, original: str, new: str) -> str:
    """The surrogate in the format of the original: its separators and capitals."""
    if kind in ("phone", "card", "iban"):
        cells = [i for i, c in enumerate(original) if c.isalnum()][-len(new) :]
        out = list(original)
        for i, c in zip(cells, new):
            out[i] = c
        return "".join(out)
    if kind == "email":
        return new.upper() if original.isupper() else "".join(n.upper() if o.isupper() else n for o, n in zip(original.ljust(len(new)), new))
    if kind == "ip6":
        short = str(ipaddress.IPv6Address(new)) if "::" in original else ":".join(f"{int(g, 16):0{len(o)}x}" for g, o in zip(new.split(":"), original.split(":")))
        return short.upper() if original.isupper() else short
    if kind.startswith("name"):
        new += stem(plain(original))[1]
        return new.upper() if original.isupper() and len(original) > 1 else new.capitalize()
    return new


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, int]:
    """The text with surrogates, and how many there are."""
    out, at, spans = [], 0, find(text)
    for a, b, kind, canon in spans:
        out += [text[at:a], render(kind, text[a:b], surrogate(key, kind, canon, attempts.get((kind, canon), 0)))]
        at = b
    return "".join(out) + text[at:] if spans else text, len(spans)


def space(kind: str) -> str:
    """The kinds whose surrogates must differ from each other: names of all kinds are one."""
    return kind.partition("_")[0]


def _scan(batches):
    for batch in batches:
        found = sorted({(k, c) for t in batch.column(0).to_pylist() for _, _, k, c in find(t)})
        if found:
            yield pa.record_batch([pa.array([x[0] for x in found]), pa.array([x[1] for x in found])], names=["kind", "canon"])


def _candidate(key: bytes, attempt: int) -> Column:
    @F.pandas_udf("string")
    def of(kinds: pd.Series, canons: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, c, attempt) for k, c in zip(kinds, canons)], dtype=object)

    return of("kind", "canon")


def value_of(kind: str, canon: str) -> str:
    """What must differ: of names, the part that no ending changes."""
    return stem(plain(canon))[0] if kind.startswith("name") else canon


def _as_value(kind: str, value: str) -> Column:
    @F.pandas_udf("string")
    def of(kinds: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([value_of(k, v) for k, v in zip(kinds, values)], dtype=object)

    return of(kind, value)


def later_attempts(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, attempt) of the entities that cannot have their first surrogate. entities: distinct (kind, canon).

    Of several entities with one candidate the least has it; a candidate that is an entity of the corpus, or that an
    earlier round gave away, nobody has.
    """
    group = F.substring_index("kind", "_", 1).alias("space")
    taken = entities.select(group, _as_value("kind", "canon").alias("value"), F.lit(0).alias("role"), F.lit("").alias("kind"), F.lit("").alias("who"))
    pending, held = entities, []
    for attempt in range(ATTEMPTS):
        asked = pending.select("kind", "canon", _candidate(key, attempt).alias("new"))
        asked = asked.select(group, _as_value("kind", "new").alias("value"), F.lit(1).alias("role"), "kind", F.col("canon").alias("who"))
        asked = materialize(asked, "pii-asked")
        met = taken.union(asked).groupBy("space", "value").agg(F.min(F.struct("role", "kind", "who")).alias("first"))
        # A left join from the asked side; each has one partner, so that a much-asked value is split like any skewed join.
        mine = (F.col("first.role") == 1) & (F.col("first.kind") == F.col("kind")) & (F.col("first.who") == F.col("who"))
        judged = materialize(asked.join(materialize(met, "pii-met"), ["space", "value"]).select("space", "value", "kind", "who", mine.alias("has")), "pii-judged")
        if attempt:
            held.append(judged.where("has").select("kind", F.col("who").alias("canon"), F.lit(attempt).alias("attempt")))
        taken = taken.union(judged.where("has").select("space", "value", F.lit(0), F.lit(""), F.lit("")))
        pending = judged.where("not has").select("kind", F.col("who").alias("canon"))
        if pending.isEmpty():
            break
    else:
        raise RuntimeError(f"surrogates still collide after {ATTEMPTS} attempts")
    out = entities.select("kind", "canon", F.lit(0).alias("attempt")).limit(0)
    for df in held:
        out = out.union(df)
    return out


def _replacer(key: bytes, held):
    """UDF: (text, its corrections) to the new text and the number of surrogates; held() gives the attempts that are not with the row."""

    @F.pandas_udf("text string, n int")
    def whole(texts: pd.Series, own: pd.Series) -> pd.DataFrame:
        attempts = held()
        rows = []
        for t, mine in zip(texts, own):
            with_mine = attempts if mine is None or not len(mine) else {(m["kind"], m["canon"]): m["attempt"] for m in mine}
            rows.append((None, 0) if t is None else replace(t, key, with_mine))
        return pd.DataFrame(rows, columns=["text", "n"])

    return whole


CORRECTIONS = "array<struct<kind:string,canon:string,attempt:int>>"


def _occurrences(batches):
    for batch in batches:
        found = [(hashlib.md5(t.encode("utf-8", "surrogatepass")).digest(), k, c) for t in batch.column(0).to_pylist() for k, c in sorted({(k, c) for _, _, k, c in find(t)})]
        if found:
            yield pa.record_batch([pa.array(x, y) for x, y in zip(zip(*found), (pa.binary(), pa.string(), pa.string()))], names=["digest", "kind", "canon"])


def surrogates(docs: DataFrame, key: bytes, text_col: str = "text", out: str = "text", count: str = "n_replaced", block: int = BLOCK) -> DataFrame:
    """The documents with surrogates in `out`, and how many in `count`; all rows and other columns stay.

    Columns named as `out` and `count` are replaced; no other name is used. Found are e-mail addresses, telephone numbers,
    IPv4 and IPv6 addresses, payment cards (Luhn), US social security numbers, IBANs, access keys, secrets named as such,
    and names (see names()). Null texts stay null (0 replaced), empty ones empty. Equal entities get equal surrogates,
    different ones different surrogates, none of them an entity of the corpus. The key is the caller's secret. If more than
    `block` entities need a later attempt, each document is given its own ones by a join on the digest of its text.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    entities = materialize(docs.select(F.col(text_col)).mapInArrow(trimmed(_scan), "kind string, canon string").distinct(), "pii-entities")
    later = materialize(later_attempts(entities, key), "pii-later")
    text, new = F.col(text_col), fresh("new")
    few = later.limit(block + 1).collect()
    if len(few) <= block:
        shared = Shared(spark, {(r[0], r[1]): r[2] for r in few})
        rows = docs.withColumn(new, _replacer(key, shared.get)(text, F.lit(None).cast(CORRECTIONS)))
        return rows.withColumns({out: F.col(f"{new}.text"), count: F.col(f"{new}.n")}).drop(new)
    places = docs.select(F.col(text_col)).mapInArrow(trimmed(_occurrences), "digest binary, kind string, canon string").distinct()
    digest, own = fresh("digest"), fresh("own")
    per_text = places.join(later, ["kind", "canon"]).groupBy(F.col("digest").alias(digest)).agg(F.collect_list(F.struct("kind", "canon", "attempt")).cast(CORRECTIONS).alias(own))
    rows = docs.withColumn(digest, F.unhex(F.md5(text.cast("binary")))).join(materialize(per_text, "pii-per-text"), digest, "left")
    rows = rows.withColumn(new, _replacer(key, dict)(text, F.col(own))).withColumns({out: F.col(f"{new}.text"), count: F.col(f"{new}.n")})
    return rows.drop(new, digest, own)
