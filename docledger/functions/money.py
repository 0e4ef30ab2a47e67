"""Money, rates and quantities, with exact decimals. Functions over DataFrames add columns in steps that stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions import dims
from docledger.functions.text import ascii_digits, lookalikes, squeeze

CURRENCY = "(?:₹|rs\\.?|inr|rupees?)"


def with_money(df: DataFrame, col: str, out: str, locale: str = "in") -> DataFrame:
    """Adds `out` (decimal(18,2), half up) and `out`_notes of a money text; a text that is none gives null and a note."""
    keep = [c for c in df.columns if c not in (out, f"{out}_notes")]
    df = df.withColumn("_t", ascii_digits(squeeze(F.col(col).cast("string"))))
    df = df.withColumn("_neg", F.col("_t").startswith("-") | (F.col("_t").startswith("(") & F.col("_t").endswith(")")))
    t = F.trim(F.regexp_replace(F.regexp_replace(F.col("_t"), "^[()]+|[()]+$", ""), "^-", ""))
    t = F.regexp_replace(F.regexp_replace(t, f"(?i)^{CURRENCY}\\s*", ""), f"(?i)\\s*{CURRENCY}\\s*$", "")
    df = df.withColumn("_u", t)
    df = df.withColumn("_s", lookalikes(F.col("_u"))).withColumn("_confused", F.col("_u") != F.col("_s"))
    df = df.withColumn("_suffix", F.col("_s").rlike("(?i)(?:cr|dr)\\s*$"))
    s = F.regexp_replace(F.regexp_replace(F.col("_s"), "(?i)\\s*(?:cr|dr)\\s*$", ""), "\\s*/[-=]\\s*$", "")
    df = df.withColumn("_s", s).withColumn("_dash", F.col("_s").rlike("^\\d+[-=]\\d{2}$"))
    s = F.when(F.col("_dash"), F.translate("_s", "-=", "..")).otherwise(F.regexp_replace("_s", "[-=]\\s*$", ""))
    df = df.withColumn("_s", F.regexp_replace(F.trim(s), " ", ""))
    s = F.col("_s")
    both = F.lit(locale == "eu") & s.contains(".") & s.contains(",")
    comma = ~both & s.rlike("^\\d+,\\d{2}$")
    grouped = s.rlike("^(?:\\d{1,3}(?:,\\d{3})+|\\d{1,2}(?:,\\d{2})+,\\d{3})(?:\\.\\d+)?$")
    bad = F.when(both, ~s.rlike("^\\d{1,3}(?:\\.\\d{3})*,\\d+$")).otherwise(s.contains(",") & ~comma & ~grouped)
    number = F.when(both, F.translate(F.translate("_s", ".", ""), ",", ".")).when(comma, F.translate("_s", ",", ".")).otherwise(F.translate("_s", ",", ""))
    df = df.withColumns({"_bad": bad, "_comma": comma, "_n": number})
    df = df.withColumn("_ok", F.col("_n").rlike("^\\d+(?:\\.\\d+)?$")).withColumn("_d", F.when(F.col("_ok") & (F.length(F.substring_index("_n", ".", 1)) <= 15), F.col("_n").try_cast("decimal(38,18)")))
    error = (
        F.when(F.col(col).isNull(), "MONEY_MISSING").when(F.col("_t") == "", "MONEY_EMPTY").when(F.col("_bad"), "MONEY_INVALID_GROUPING").when(~F.col("_ok"), "MONEY_INVALID")
        .when(F.length(F.substring_index("_n", ".", 1)) > 15, "AMOUNT_TOO_LARGE").when(F.col("_d") > 1000000000000, "AMOUNT_IMPLAUSIBLE")
    )
    value = F.round(F.when(F.col("_neg"), -F.col("_d")).otherwise(F.col("_d")), 2).cast("decimal(18,2)")
    seen = F.array(F.when(F.col("_confused"), "OCR_CONFUSION_USED"), F.when(F.col("_suffix"), "MAGNITUDE_SUFFIX_IGNORED"), F.when(F.col("_dash"), "DASH_DECIMAL"), F.when(F.col("_comma"), "COMMA_DECIMAL"))
    df = df.withColumn("_error", error)
    return df.select(*keep, F.when(F.col("_error").isNull(), value).alias(out), F.when(F.col("_error").isNotNull(), F.array("_error")).otherwise(F.filter(seen, lambda n: n.isNotNull())).alias(f"{out}_notes"))


def lenient(x: Column) -> Column:
    """A number with grouping commas or a percent sign, as decimal; else null. No exponents."""
    t = F.trim(F.translate(x, ",%", ""))
    return F.when(t.rlike("^-?\\d+(\\.\\d+)?$"), t.try_cast("decimal(28,8)"))


def rates(values=dims.RATES) -> Column:
    return F.array(*[F.lit(v).cast("decimal(28,8)") for v in values])


def nearest_rate(x: Column) -> Column:
    """The known rate nearest to a decimal, the smaller of two."""
    return F.array_min(F.transform(rates(), lambda r: F.struct(F.abs(r - x).alias("gap"), r.alias("rate"))))["rate"]


def parse_rate(x: Column) -> Column:
    """A rate in percent (decimal), snapped to a known one within 0.15; null outside 0 to 100."""
    t = lookalikes(F.trim(F.translate(ascii_digits(squeeze(x)), ",%", ".")))
    d = F.when(t.rlike("^-?\\d*\\.?\\d+$"), t.try_cast("decimal(28,8)"))
    near = nearest_rate(d)
    return F.when(d.between(0, 100), F.when(F.abs(near - d) <= F.lit(dims.SNAP).cast("decimal(28,8)"), near).otherwise(d)).cast("decimal(12,4)")


def fraction_rate(x: Column) -> Column:
    """A rate cell: 0.18 means 18 where that is a known rate."""
    d = lenient(x)
    whole = (d * 100).cast("decimal(28,8)")
    return F.when((d <= 1) & F.array_contains(rates(dims.FRACTION_RATES), whole), whole).otherwise(d).cast("decimal(12,4)")


def quantity(x: Column) -> Column:
    return F.round(lenient(lookalikes(ascii_digits(squeeze(x)))), 4).cast("decimal(18,4)")


def short(x: Column) -> Column:
    """A decimal as text without trailing zeros."""
    t = x.cast("string")
    return F.when(t.contains("."), F.regexp_replace(F.regexp_replace(t, "0+$", ""), "\\.$", "")).otherwise(t)
