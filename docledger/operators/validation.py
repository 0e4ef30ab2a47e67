"""Validation rules over wide header and line tables: each rule is one expression that gives a check or nothing.

All checks of a row are one array, exploded once; a record's score, status and review need are then one aggregation.
Headers: record (key), invoice_no, invoice_date, due_date, document_type, supplier_gstin, buyer_gstin, pos (state code),
taxable, discount, cgst, sgst, igst, cess, total_tax, round_off, total, words_amount (decimal or null), reverse_charge,
price_includes_tax, n_lines. Lines: record, line_idx, quantity, unit_price, discount, taxable, rate, cgst, sgst, igst,
cess, line_total. A column that a table lacks counts as null. Decimals throughout; a null operand gives no check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions import confidence, dims, ids

HARD, SOFT = "0.02", "1.00"
WEIGHTS = {"error": 3, "warning": 1, "info": 0}
CHECK = "struct<code:string,severity:string,passed:boolean,path:string,expected:decimal(24,6),actual:decimal(24,6)>"

HEADER_TYPES = {
    "invoice_no": "string", "invoice_date": "date", "due_date": "date", "document_type": "string", "supplier_gstin": "string", "buyer_gstin": "string", "pos": "string",
    **{c: "decimal(18,2)" for c in ("taxable", "discount", "cgst", "sgst", "igst", "cess", "total_tax", "round_off", "total", "words_amount")},
    "words_text": "string", "reverse_charge": "string", "price_includes_tax": "string", "n_lines": "long", "qr_conflict": "boolean",
}
LINE_TYPES = {"line_idx": "int", "quantity": "decimal(18,4)", "unit_price": "decimal(18,4)", "rate": "decimal(9,4)", **{c: "decimal(18,2)" for c in ("discount", "taxable", "cgst", "sgst", "igst", "cess", "line_total")}}


def conform(df: DataFrame, types: dict[str, str], key: str = "record") -> DataFrame:
    have = set(df.columns)
    return df.select(key, *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def _dec(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("decimal(24,6)")


def _zero(name: str) -> Column:
    return F.coalesce(_dec(F.col(name)), _dec("0"))


def check(code, severity, passed, path, expected=None, actual=None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(code).alias("code"), lit(severity).alias("severity"), lit(passed).alias("passed"), lit(path).alias("path"), _dec(expected).alias("expected"), _dec(actual).alias("actual"))


#: Bits of each count in a tally: weight, lost weight, unresolved errors, warnings. A row has some forty checks at most.
TALLY_BITS = 8


def tally(code, severity, passed, path, expected=None, actual=None) -> Column:
    """A check as one number that adds up over the checks of a row, for scores that need no rows."""
    kind, fine = (x if isinstance(x, Column) else F.lit(x) for x in (severity, passed))
    weight = F.when(kind == "error", WEIGHTS["error"]).when(kind == "warning", WEIGHTS["warning"]).otherwise(WEIGHTS["info"])
    lost = F.when(fine, 0).otherwise(weight)
    unresolved = F.when((kind == "error") & ~fine, 1).otherwise(0)
    return weight + F.shiftleft(lost, TALLY_BITS) + F.shiftleft(unresolved, 2 * TALLY_BITS) + F.shiftleft(F.when(kind == "warning", 1).otherwise(0), 3 * TALLY_BITS)


def money_check(code: str, actual: Column, expected: Column, path, make=check) -> Column:
    """Equal within 0.02: passed. Within 1.00: passed as a warning of its own. Else a failed error."""
    gap = F.abs(_dec(actual) - _dec(expected))
    return (
        F.when(gap <= _dec(HARD), make(code, "error", True, path, expected, actual))
        .when(gap <= _dec(SOFT), make(f"{code}_ROUNDING", "warning", True, path, expected, actual))
        .when(gap.isNotNull(), make(code, "error", False, path, expected, actual))
    )


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name).cast("string") == "")


def with_gstin(head: DataFrame) -> DataFrame:
    """What the rules ask of both tax numbers, once: formed, state known, checksum right."""
    for party in ("supplier", "buyer"):
        head = head.withColumn(f"_{party}_n", ids.gstin_normal(F.col(f"{party}_gstin")))
        x = F.col(f"_{party}_n")
        head = head.withColumns({
            f"_{party}_formed": F.coalesce(x.rlike(ids.GSTIN), F.lit(False)),
            f"_{party}_state": F.coalesce(F.substring(x, 1, 2).isin(*dims.STATE_CODES), F.lit(False)),
            f"_{party}_sum": F.coalesce(ids.gstin_check(F.substring(x, 1, 14)) == F.substring(x, 15, 1), F.lit(False)),
        })
    return head


def header_checks(as_of: Column, check=check) -> list[Column]:
    """For headers with the columns of with_gstin()."""
    c = F.col
    no_tax_doc = F.coalesce(c("document_type").isin("bill_of_supply", "composition"), F.lit(False))
    out = []
    for party in ("supplier", "buyer"):
        path, given, formed = f"invoice.{party}_gstin", ~_blank(f"{party}_gstin"), c(f"_{party}_formed")
        out.append(F.when(given, check("GSTIN_FORMAT", "error", formed, path)))
        out.append(F.when(given & formed, check("GSTIN_STATE_CODE", "error", c(f"_{party}_state"), path)))
        out.append(F.when(given, check("GSTIN_CHECKSUM", "error", formed & c(f"_{party}_sum"), path)))
    out.append(F.when(_blank("supplier_gstin") & ~no_tax_doc, check("SUPPLIER_GSTIN_MISSING", "error", False, "invoice.supplier_gstin")))
    out.append(F.when(_blank("buyer_gstin"), check("BUYER_GSTIN_MISSING", "info", True, "invoice.buyer_gstin")))
    out.append(F.when(_blank("invoice_no"), check("INVOICE_NUMBER_MISSING", "error", False, "invoice.invoice_no")))
    out.append(F.when(c("invoice_date").isNull(), check("DATE_MISSING", "error", False, "invoice.invoice_date")))
    out.append(F.when(c("qr_conflict"), check("QR_MISMATCH", "error", False, "invoice")))
    out.append(F.when(F.length("invoice_no") > 16, check("INVOICE_NUMBER_RULE46", "warning", True, "invoice.invoice_no")))
    out.append(F.when(c("due_date") < c("invoice_date"), check("DUE_BEFORE_INVOICE", "warning", True, "invoice.due_date")))
    out.append(F.when(c("invoice_date") < F.lit("2017-07-01").cast("date"), check("DATE_BEFORE_GST", "warning", True, "invoice.invoice_date")))
    out.append(F.when(c("invoice_date") > F.date_add(as_of, 1), check("DATE_IN_FUTURE", "warning", True, "invoice.invoice_date")))
    out.append(F.when(c("invoice_date") < F.add_months(as_of, -96), check("DATE_VERY_OLD", "warning", True, "invoice.invoice_date")))
    out.append(F.when(_blank("pos"), check("POS_MISSING", "info", True, "invoice.place_of_supply")))
    taxes = _zero("cgst") + _zero("sgst") + _zero("igst") + _zero("cess")
    expected = _dec(c("taxable")) - _zero("discount") + taxes + _zero("round_off")
    both = c("taxable").isNotNull() & c("total").isNotNull()
    out.append(F.when(both, money_check("GRAND_TOTAL", c("total"), expected, "invoice.total_amount", check)))
    out.append(F.when(both, money_check("TOTAL_TAX", c("total_tax"), taxes, "invoice.total_tax", check)))
    fits = F.coalesce(F.abs(_dec(c("total")) - expected) <= _dec(SOFT), F.lit(False))
    words = ~_blank("words_text") & c("total").isNotNull()
    out.append(F.when(words & (c("words_amount") != c("total")), check(F.when(fits, "WORDS_MISMATCH").otherwise("WORDS_TOTAL"), F.when(fits, "warning").otherwise("error"), fits, "invoice.amount_in_words", c("total"), c("words_amount"))))
    out.append(F.when(words & c("words_amount").isNull(), check("WORDS_UNPARSEABLE", "warning", True, "invoice.amount_in_words")))
    home = F.substring("supplier_gstin", 1, 2)
    over = lambda n: F.coalesce(c(n) > _dec(HARD), F.lit(False))
    wrong = F.when(c("pos") == home, over("igst")).otherwise(over("cgst") | over("sgst"))
    taxed = F.greatest(F.coalesce(c("cgst"), F.lit(0)), F.coalesce(c("sgst"), F.lit(0)), F.coalesce(c("igst"), F.lit(0))) > 0
    out.append(F.when(~_blank("pos") & ~_blank("supplier_gstin") & taxed, check("TAX_TYPE_MISMATCH", "error", ~wrong, "invoice.place_of_supply")))
    out.append(F.when(no_tax_doc, check("TAX_ON_BILL_OF_SUPPLY", "error", ~(over("cgst") | over("sgst") | over("igst") | over("cess") | over("total_tax")), "invoice.igst")))
    out.append(F.when(c("reverse_charge") == "true", check("REVERSE_CHARGE", "info", True, "invoice.reverse_charge")))
    out.append(F.when((F.coalesce(c("n_lines"), F.lit(0)) == 0) & ~F.coalesce(c("document_type") == "gstr_layout_c", F.lit(False)), check("LINE_ITEMS_MISSING", "warning", True, "line_items")))
    return out


def line_checks(check=check) -> list[Column]:
    """For lines joined with their header's pos, supplier_gstin, invoice_date and price_includes_tax."""
    c = F.col
    path = lambda name: F.concat(F.lit("line_items["), (c("line_idx") - 1).cast("string"), F.lit(f"].{name}"))
    known = c("rate").isin(*[F.lit(r).cast("decimal(9,4)") for r in dims.RATES])
    regime = F.lit(dims.REGIME_DATE).cast("date")
    off = (c("rate").isin(*[F.lit(r).cast("decimal(9,4)") for r in dims.RETIRED]) & (c("h_date") >= regime)) | (c("rate").isin(*[F.lit(r).cast("decimal(9,4)") for r in dims.INTRODUCED]) & (c("h_date") < regime))
    out = [
        F.when(~known, check("RATE_UNKNOWN", "error", False, path("tax_rate"))),
        F.when(known & off, check("RATE_NOT_EFFECTIVE", "warning", True, path("tax_rate"))),
    ]
    priced = c("quantity").isNotNull() & c("unit_price").isNotNull() & c("taxable").isNotNull()
    plain = (c("quantity") * c("unit_price")).cast("decimal(30,6)") - _zero("discount")
    net = F.when((c("h_inclusive") == "true") & c("rate").isNotNull(), _dec(plain * 100 / (100 + c("rate")))).otherwise(_dec(plain))
    out.append(F.when(priced, money_check("LINE_TAXABLE", c("taxable"), net, path("taxable_value"), check)))
    for tax in ("cgst", "sgst", "igst", "cess"):
        out.append(F.when(priced & (c(tax) < 0), check("NEGATIVE_AMOUNT", "warning", True, path(tax))))
    pos, home = F.coalesce(c("h_pos"), F.lit("")), F.coalesce(F.substring("h_supplier", 1, 2), F.lit(""))
    intra = (pos == home) & (pos != "96")
    half, whole = F.round(_dec(c("taxable")) * c("rate") / 200, 2), F.round(_dec(c("taxable")) * c("rate") / 100, 2)
    for tax in ("cgst", "sgst", "igst"):
        mine = intra if tax != "igst" else ~intra
        expected = F.when(mine, _dec(half if tax != "igst" else whole)).otherwise(_dec("0"))
        out.append(F.when(priced & c("rate").isNotNull() & (c(tax).isNotNull() | (expected > _dec(HARD))), money_check(f"LINE_TAX_{tax.upper()}", _zero(tax), expected, path(tax), check)))
    out.append(F.when(priced & c("line_total").isNotNull(), money_check("LINE_TOTAL", c("line_total"), _dec(c("taxable")) + _zero("cgst") + _zero("sgst") + _zero("igst") + _zero("cess"), path("line_total"), check)))
    return out


def _exploded(df: DataFrame, checks: list[Column]) -> DataFrame:
    rows = df.select("record", F.explode(F.array_compact(F.array(*checks))).alias("c"))
    return rows.select("record", "c.*").withColumn("difference", F.abs(F.col("actual") - F.col("expected")))


def checks(headers: DataFrame, lines: DataFrame, as_of: str) -> DataFrame:
    """record, code, severity, passed, path, expected, actual and difference, a row for each check of each record.

    Records of `headers` only; a line's checks need its header. Lines meet headers by one shuffle on the record.
    """
    head, body = conform(headers, HEADER_TYPES), conform(lines, LINE_TYPES)
    sums = body.groupBy("record").agg(F.sum("taxable").alias("lines_taxable"))
    whole = with_gstin(head.join(sums, "record", "left"))
    of_head = _exploded(whole, [*header_checks(F.lit(as_of).cast("date")), money_check("SUM_TAXABLE", F.col("lines_taxable"), F.col("taxable"), "invoice.taxable_value")])
    slim = head.select("record", F.col("pos").alias("h_pos"), F.col("supplier_gstin").alias("h_supplier"), F.col("invoice_date").alias("h_date"), F.col("price_includes_tax").alias("h_inclusive"))
    return of_head.unionByName(_exploded(body.join(slim, "record"), line_checks()))


def summary(found: DataFrame) -> DataFrame:
    """record, score, errors, warnings and unresolved of each record with checks: the share of weight that passed."""
    weight = F.when(F.col("severity") == "error", 3).when(F.col("severity") == "warning", 1).otherwise(0)
    lost = F.sum(F.when(~F.col("passed"), weight).otherwise(0))
    return found.groupBy("record").agg(
        F.when(F.sum(weight) == 0, F.lit(1.0)).otherwise(F.lit(1.0) - lost / F.sum(weight)).alias("score"),
        F.count_if((F.col("severity") == "error") & ~F.col("passed")).alias("unresolved"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )


#: Fields that decide, and their weights; the supplier's number unless the document bears no tax, the buyer's if given.
CRITICAL = (("invoice_no", 2), ("invoice_date", 2), ("taxable", 2), ("total", 3))
#: Below CONF_OK a field is reviewed, below CONF_LOW a record.
CONF_OK, CONF_LOW, GIVEN = 0.90, 0.70, 0.97


def _confidence(df: DataFrame, name: str) -> Column:
    """A field's confidence: its `<name>_confidence` column, else GIVEN for a value that is there and 0 for none."""
    default = F.when(_blank(name), 0.0).otherwise(GIVEN)
    return F.coalesce(F.col(f"{name}_confidence").cast("double"), default) if f"{name}_confidence" in df.columns else default


def judged(headers: DataFrame, lines: DataFrame, as_of: str) -> DataFrame:
    """Of every header: score, unresolved, warnings, confidence (weighted over the fields that decide), missing, too_low and present.

    One join of lines with their headers and one aggregation on the same key: no check becomes a row. Confidences of fields
    come from `<field>_confidence` columns of headers (invoice_no, invoice_date, taxable, total, supplier_gstin, buyer_gstin)
    and lines (taxable), where they are there.
    """
    critical = [n for n, _ in CRITICAL] + ["supplier_gstin", "buyer_gstin"]
    head, body = conform(headers, HEADER_TYPES), conform(lines, LINE_TYPES)
    wide = headers.withColumns({f"{n}_c": _confidence(headers, n) for n in critical if n in headers.columns})
    head = conform(wide, HEADER_TYPES | {f"{n}_c": "double" for n in critical})
    head = head.withColumns({f"{n}_c": F.coalesce(f"{n}_c", F.lit(0.0)) for n in critical})
    line_c = F.coalesce(F.col("taxable_confidence").cast("double"), F.when(F.col("taxable").isNull(), 0.0).otherwise(GIVEN)) if "taxable_confidence" in lines.columns else F.when(F.col("taxable").isNull(), 0.0).otherwise(GIVEN)
    body = lines.withColumn("line_c", line_c)
    body = conform(body, LINE_TYPES | {"line_c": "double"}).select("record", F.struct(*LINE_TYPES, "line_c").alias("line"))
    met = head.select("record", F.struct(*[c for c in head.columns if c != "record"]).alias("head")).join(body, "record", "left")
    flat = met.select("record", "head", "line.*", F.col("line").isNotNull().alias("is_line"), F.col("head.pos").alias("h_pos"), F.col("head.supplier_gstin").alias("h_supplier"), F.col("head.invoice_date").alias("h_date"), F.col("head.price_includes_tax").alias("h_inclusive"))
    total = lambda found: sum((F.coalesce(c, F.lit(0)) for c in found[1:]), F.coalesce(found[0], F.lit(0)))
    flat = flat.withColumn("tally", F.when(F.col("is_line"), total(line_checks(tally))).otherwise(0))
    count = lambda i, c="tally": F.shiftright(c, i * TALLY_BITS).bitwiseAND(F.lit((1 << TALLY_BITS) - 1))
    per = flat.groupBy("record").agg(
        F.first("head").alias("head"), F.sum("taxable").alias("lines_taxable"), F.count_if("is_line").alias("lines"), F.count("taxable").alias("good"),
        F.coalesce(F.sum("line_c"), F.lit(0.0)).alias("lines_c"), F.count_if(F.col("is_line") & (F.col("taxable").isNull() | (F.col("line_c") < CONF_OK))).alias("lines_low"),
        *[F.sum(count(i)).alias(f"t{i}") for i in range(4)],
    )
    whole = with_gstin(per.select("record", "head.*", "lines_taxable", "lines", "good", "lines_c", "lines_low", "t0", "t1", "t2", "t3"))
    found = [*header_checks(F.lit(as_of).cast("date"), tally), money_check("SUM_TAXABLE", F.col("lines_taxable"), F.col("taxable"), "invoice.taxable_value", tally)]
    whole = whole.withColumn("tally", total(found))
    weight, lost, unresolved, warned = (F.col(f"t{i}") + count(i) for i in range(4))
    no_tax = F.coalesce(F.col("document_type").isin("bill_of_supply", "composition"), F.lit(False))
    no_lines = (F.col("lines") == 0) & ~F.coalesce(F.col("document_type") == "gstr_layout_c", F.lit(False))
    asked = [(n, F.lit(w)) for n, w in CRITICAL] + [("supplier_gstin", F.when(no_tax, 0).otherwise(2)), ("buyer_gstin", F.when(_blank("buyer_gstin"), 0).otherwise(2))]
    sum_w = sum((w for _, w in asked[1:]), asked[0][1]) + F.col("lines") + F.when(no_lines, 1).otherwise(0)
    sum_c = sum((F.col(f"{n}_c") * w for n, w in asked[1:]), F.col(f"{asked[0][0]}_c") * asked[0][1]) + F.col("lines_c")
    any_of = lambda conds: F.exists(F.array(*conds), lambda x: x)
    missing = any_of([(w > 0) & _blank(n) for n, w in asked]) | no_lines | (F.col("good") < F.col("lines"))
    low = missing | any_of([(w > 0) & (F.col(f"{n}_c") < CONF_OK) for n, w in asked]) | (F.col("lines_low") > 0)
    present = any_of([(w > 0) & ~_blank(n) for n, w in asked]) | (F.col("good") > 0)
    return whole.select(
        "record", F.when(weight == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - lost / weight)).alias("score"), unresolved.alias("unresolved"), warned.alias("warnings"),
        (sum_c / sum_w).alias("confidence"), missing.alias("missing"), low.alias("too_low"), present.alias("present"),
    )


def validate(headers: DataFrame, lines: DataFrame, as_of: str, duplicates: DataFrame | None = None) -> DataFrame:
    """record, score, overall, status and review_required of every header.

    duplicates: records (a column `record`) with a possible duplicate; such a record is to be reviewed whatever its status.
    """
    x = judged(headers, lines, as_of)
    overall = F.col("confidence") * F.col("score")
    low = F.col("missing") | F.col("too_low") | (F.col("unresolved") > 0) | (overall < CONF_LOW)
    status = F.when(~F.col("present"), "failed").when(low, "needs_review").when(F.col("warnings") > 0, "valid_with_warnings").otherwise("valid")
    out = x.select("record", "score", overall.alias("overall"), status.alias("status"), (status != "valid").alias("review_required"))
    if duplicates is None:
        return out
    again = duplicates.select("record").distinct().withColumn("_again", F.lit(True))
    return out.join(again, "record", "left").withColumn("review_required", F.col("review_required") | F.coalesce("_again", F.lit(False))).drop("_again")


def possible_duplicates(matches: DataFrame, job: str = "a_job_id") -> DataFrame:
    """record, code, severity, passed, path: the warning that a match raises, once for each document."""
    return matches.select(F.col(job).alias("record")).distinct().select("record", F.lit("POSSIBLE_DUPLICATE").alias("code"), F.lit("warning").alias("severity"), F.lit(False).alias("passed"), F.lit("invoice").alias("path"))


def field_status(confidence: Column, value: Column, old: Column) -> Column:
    """A field's status after validation: work by hand stays, else missing, accepted or needs_review."""
    return F.when(old.isin("corrected", "derived", "human_verified"), old).when(value.isNull(), "missing").when(confidence >= CONF_OK, "accepted").otherwise("needs_review")


def refreshed(fields: DataFrame, level: str = "header") -> DataFrame:
    """Fields (field, value, confidence, status, note) with the confidence and status that they have after validation.

    Of header fields a tax number's confidence is lifted to 0.95 if it is valid and held to 0.60 if not, and an ambiguous
    date's held to 0.92; line fields (level "line") keep theirs.
    """
    c = F.col
    if level == "header":
        tax = c("field").isin("supplier_gstin", "buyer_gstin") & (F.coalesce(c("value"), F.lit("")) != "")
        valid = F.when(tax, ids.gstin_valid(c("value")))
        doubtful = c("field").isin("invoice_date", "due_date") & F.coalesce(c("note").contains("DATE_AMBIGUOUS_DAY_FIRST"), F.lit(False))
        fields = fields.withColumn("confidence", confidence.cap(c("confidence").cast("double"), F.lit(False), valid, doubtful, F.lit(False)))
    return fields.withColumn("status", field_status(c("confidence"), c("value"), c("status")))
