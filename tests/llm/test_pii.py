"""Surrogates: scripts, gender, coreference, formats, collisions, and corrections by join."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from docledger.llm import pii


def new(text, attempts=None, key=b"k"):
    return pii.replace(text, key, attempts or {})[0]


def scripts(text):
    return [unicodedata.name(c).split()[0] for c in text if c.isalpha()]


@pytest.mark.parametrize("text", ["Госпожа Анна Иванова", "Herr Γιώργος Παπαδόπουλος", "Mr 王 明", "السيد أحمد منصور", "श्री राम कुमार", "Señorita López", "Mme Curie"])
def test_script_and_shape(text):
    got = new(text)
    assert got != text and got.split()[0] == text.split()[0]
    assert not set(re.findall(r"\w{2,}", text)[1:]) & set(re.findall(r"\w{2,}", got))
    assert set(scripts(got)) == set(scripts(text))


def test_gender():
    for who in ("Иванова", "Петрова", "Никитина", "Крамская"):
        got = new(f"Госпожа Анна {who}").split()
        assert got[1][-1] in "ая" and got[2].endswith(("ова", "ева", "ина", "ая"))
    him, her = new("Господин Иван Иванов").split(), new("Госпожа Анна Иванова").split()
    assert her[2] == him[2] + "а" and him[1][-1] not in "ая"
    assert new("Κυρία Παπαδοπούλου").split()[1][:-2] == new("Κύριος Παπαδόπουλος").split()[1][:-2]
    assert new("Κυρία Παπαδοπούλου").endswith("ου") and new("Κύριος Παπαδόπουλος").endswith("ος")
    assert new("Mrs Anna Smith").split()[1].endswith("a")


def test_coreference():
    got = new("Mr John Smith met us. Smith then left; John called. Smith's car. JOHN! A smith, smithy, Johnson.")
    first, last = got.split()[1:3]
    assert got == f"Mr {first} {last} met us. Smith then left; {first} called. Smith's car. {first.upper()}! A smith, smithy, Johnson."
    got = new("Mr John Smith met us. Smith then left; John called. Smith's car.")
    first, last = got.split()[1:3]
    assert got == f"Mr {first} {last} met us. {last} then left; {first} called. {last}'s car."
    assert new("Mr Smith").split()[1] == new("Mrs Smith").split()[1] == new("Prof. Dr. Smith").split()[-1]
    assert new("John called Smith.") == "John called Smith."


def test_titles_initials_and_words():
    got = new("Frau Dr. Eva Weiss")
    assert got.startswith("Frau Dr. ") and "Eva" not in got and "Weiss" not in got and len(got.split()) == 4
    assert "Brien" not in new("Mr O'Brien") and "Adams" not in new("Dr. Adams called") and new("Dr. Adams called").endswith(" called")
    assert re.fullmatch(r"Mr J\. [A-Z][a-z]+ spoke", new("Mr J. Smith spoke"))
    for clean in ("Turn into Maple Dr. Springfield ends there.", "mr smith", "the lord of manors", "Miss it. Sir, yes"):
        assert new(clean) == clean
    assert new("Mr SMITH").split()[1].isupper()


def test_addresses():
    got = new("jörg.müller@beispiel.de")
    assert re.fullmatch(r"[^\W\d_]{4}\.[^\W\d_]{6}@[a-z]{8}\.de", got) and sum(not c.isascii() for c in got) == 2
    got = new("host 2001:db8::8a2e:370:7334 is up")
    assert "2001:" in got and "::" in got and "8a2e" not in got
    assert new("at 12:30:45 std::vector a::b") == "at 12:30:45 std::vector a::b"
    assert new("2001:0db8:0000:0000:0000:8a2e:0370:7334") .count(":") == 7


def test_names_are_distinct_over_kinds(spark):
    """No surrogate is a name of another kind, and no two entities share the part that endings do not change."""
    rng = random.Random(1)
    entities = [("name_m", pii.surrogate(b"k", "name_x", f"n{i}")) for i in range(50)] + [("name_x", f"n{i}") for i in range(50)]
    entities += [("name_f", "".join(rng.choice("abcdefgh") for _ in range(6))) for _ in range(100)]
    later = {(r.kind, r.canon): r.attempt for r in pii.later_attempts(spark.createDataFrame(sorted(set(entities)), "kind string, canon string"), b"k").collect()}
    given = [pii.value_of(k, pii.surrogate(b"k", k, c, later.get((k, c), 0))) for k, c in set(entities)]
    assert len(later) >= 50 and len(set(given)) == len(given) and not set(given) & {pii.value_of(k, c) for k, c in entities}


def test_space_of_names_is_large():
    assert len({pii.surrogate(b"k", "name_m", f"n{i}") for i in range(20000)}) > 19900
    assert len(pii.surrogate(b"k", "name_m", "x", 20)) > len(pii.surrogate(b"k", "name_m", "x")) and pii.surrogate(b"k", "name_m", "王", 8) != ""


def test_corrections_by_join(spark, monkeypatch):
    """The same texts whether the corrections go to every worker or by a join to their documents; nulls, repeats and clashing columns."""
    rows = [(i, f"a{i}@x.example.com and b{i % 3}@y.example.com") for i in range(30)] + [(3, "a3@x.example.com and b0@y.example.com"), (40, None), (41, ""), (None, "b1@y.example.com")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("_new", "_spans", "digest", "kind", "n_replaced")])
    monkeypatch.setattr(pii, "later_attempts", lambda e, key: e.where("canon in ('a3@x.example.com', 'b1@y.example.com')").selectExpr("kind", "canon", "2 as attempt"))
    whole, joined = (sorted(map(tuple, pii.surrogates(df, b"k", block=n).collect()), key=str) for n in (100, 1))
    assert whole == joined and len(whole) == len(rows) and all(r[2:6] == ("x", "x", "x", "x") for r in whole)
    plain = pii.surrogate(b"k", "email", "b1@y.example.com", 2)
    assert sum(plain in (r[1] or "") for r in whole) == 11
