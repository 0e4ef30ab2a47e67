from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docledger.functions import confidence, dates, ids, money, similarity, text, words


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_gstin(spark):
    good = ["27AAPFU0939F1ZV", "29ABCDE1234F1ZW", "07AAACR5055K1Z9", "33AAACH7409R1Z8", "24AABCU9603R1ZT"]
    bad = ["27AAPFU0939F1ZX", "27AAPFU0939F1YV", "00AAPFU0939F1ZV", "27AAPFU093F91ZV", "96AAPFU0939F1ZV", None, ""]
    assert column(spark, good + bad, ids.gstin_valid) == [True] * len(good) + [False] * len(bad)
    assert column(spark, ["27 aapfu-0939F1ZV"], ids.gstin_normal) == ["27AAPFU0939F1ZV"]
    made = spark.sql("select 'Maharashtra' s, 'AAPFU0939F' p, '1' e union all select '96', 'AAPFU0939F', '1'").select(ids.make_gstin(F.col("s"), F.col("p"), F.col("e"))).collect()
    assert [r[0] for r in made] == ["27AAPFU0939F1ZV", None]


@pytest.mark.parametrize("cell,locale,value,note", [
    ("₹ 12,34,567.505", "in", "1234567.51", None), ("(1,234.50)", "in", "-1234.50", None), ("1.234,56", "eu", "1234.56", None), ("12,34,56", "in", None, "MONEY_INVALID_GROUPING"),
    ("123-45", "in", "123.45", "DASH_DECIMAL"), ("Rs. 1O0/-", "in", "100.00", "OCR_CONFUSION_USED"), ("1,23", "in", "1.23", "COMMA_DECIMAL"), ("abc", "in", None, "MONEY_INVALID"), ("", "in", None, "MONEY_EMPTY"),
    (None, "in", None, "MONEY_MISSING"), ("1e3", "in", None, "MONEY_INVALID"), ("9999999999999", "in", None, "AMOUNT_IMPLAUSIBLE"), ("500 Dr", "in", "500.00", "MAGNITUDE_SUFFIX_IGNORED"),
])
def test_money(spark, cell, locale, value, note):
    df = spark.createDataFrame([(cell, 1)], "x string, other int")
    r = money.with_money(df, "x", "m", locale).collect()[0]
    assert r["m"] == (None if value is None else Decimal(value)) and (note in r["m_notes"] if note else r["m_notes"] == [])


def test_dates(spark):
    got = column(spark, ["03/04/2025", "31/02/2025", "2025-1-5", "25 Dec 24", "1st March 2020", "13/25/2020", "04/13/2020", None, "x"], lambda c: dates.parse_date(c).cast("string"))
    assert got == ["2025-04-03", None, "2025-01-05", "2024-12-25", "2020-03-01", None, "2020-04-13", None, None]
    notes = column(spark, ["03/04/2025", "31/02/2025", "01/01/2010"], lambda c: dates.date_notes(c, F.lit("2026-01-01").cast("date")))
    assert notes == [["DATE_AMBIGUOUS_DAY_FIRST"], ["DATE_INVALID"], ["DATE_BEFORE_GST", "DATE_VERY_OLD"]]
    assert column(spark, ["2024-03-31", "2024-04-01"], lambda c: dates.fiscal_year(c.cast("date"))) == ["2023-24", "2024-25"]
    assert column(spark, ["2024-01-02T00:00:00", "5-6-2020", "05/06/70"], lambda c: dates.cell_date(c).cast("string")) == ["2024-01-02", "2020-06-05", "1970-06-05"]


def test_words():
    amount, sure = words.parse("one lakh twenty-three thousand fourty rupees and fiften paise only")
    assert amount == Decimal("123040.15") and sure >= 0.85
    assert words.parse("one unicorn rupees") == (None, 0.0) and words.parse("") == (None, 0.0)


@settings(max_examples=100, deadline=None)
@given(st.decimals(min_value=0, max_value=99_99_99_999, places=2))
def test_words_round_trip(x):
    assert words.parse(words.write(x))[0] == x


def test_similarity():
    assert similarity.indel("abc", "abc") == 100 and similarity.indel("", "") == 100 and similarity.indel("ab", "cd") == 0
    assert similarity.lcs("abcdefgh", "axcxexgx") == 4
    assert similarity.token_set("invoice no", "no invoice") == 100


def test_bound_is_necessary(spark):
    pairs = [("INV-0001", "INV-0002"), ("INV-0001", "INV0001"), ("abc", "xyz"), ("abcdefghij", "abcdefgh")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.can_reach(F.col("a"), F.col("b"), 85.0).alias("may"), similarity.ratio(F.col("a"), F.col("b")).alias("r"))
    assert all(r.may for r in df.collect() if r.r >= 85)


def test_identifiers(spark):
    assert column(spark, ["+91 98765 43210", "09876543210", "123"], ids.phone) == ["9876543210", "9876543210", "123"]
    assert column(spark, ["00123", "123", "1234567", "1234", "x"], ids.hsn_padded) == ["000123", "0123", "01234567", "1234", "x"]
    assert column(spark, ["TN", "27", "j & k", "Narnia", ""], ids.state) == ["33-Tamil Nadu", "27-Maharashtra", "01-Jammu and Kashmir", "Narnia", None]
    assert column(spark, ["Kgs.", "dozen", "foo"], ids.unit) == ["KGS", "DOZ", "FOO"]
    assert column(spark, ["INV/1", "x" * 17, None], ids.invoice_no_note) == [None, "INVOICE_NUMBER_RULE46", "INVOICE_NUMBER_MISSING"]


def test_rates(spark):
    assert column(spark, ["18%", "17.9", "17.5", "101", "x", None], lambda c: money.short(money.parse_rate(c))) == ["18", "18", "17.5", None, None, None]
    assert column(spark, ["0.09", "9%", "0.18", "1"], lambda c: money.short(money.fraction_rate(c))) == ["9", "9", "18", "1"]


def test_text(spark):
    assert column(spark, ['=HYPERLINK("x")', "-5", "-x", "a", None], text.formula_safe) == ["'=HYPERLINK(\"x\")", "-5", "'-x", "a", None]
    assert column(spark, ["ﬁne  x​", "plain  text"], lambda c: text.clean_text(c, True)) == ["fine x", "plain text"]
    assert column(spark, ["१२३"], text.ascii_digits) == ["123"]


def test_confidence(spark):
    row = spark.range(1).select(confidence.cap(F.lit(0.8), F.lit(False), F.lit(True), F.lit(True), F.lit(False)).alias("a"), confidence.source_confidence(F.lit("ocr"), F.lit(0.99), F.lit(True)).alias("b")).first()
    assert row.a == 0.92 and row.b == 0.8
    boxes = spark.range(1).select(confidence.rotate([F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(0.4)], F.lit(90)).alias("r")).first().r
    assert [round(x, 6) for x in boxes] == [0.6, 0.1, 0.8, 0.3]
