"""Field values: normalised by field, with raw text, confidence, status, sources and alternatives; edits by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions import confidence, dates, dims, ids, money
from docledger.functions.text import ascii_digits, lookalikes, squeeze
from docledger.operators import merge
from docledger.operators.validation import CONF_OK, GIVEN

#: Which fields hold money, dates, tax numbers, truth values and plain text.
MONEY_FIELDS = ("subtotal", "discount", "taxable_value", "cgst", "sgst", "igst", "cess", "total_tax", "round_off", "total_amount", "unit_price", "line_total")
DATE_FIELDS = ("invoice_date", "due_date")
GSTIN_FIELDS = ("supplier_gstin", "buyer_gstin")
BOOLEAN_FIELDS = ("reverse_charge", "price_includes_tax")
TEXT_FIELDS = ("purchase_order_no", "supplier_name", "supplier_address", "buyer_name", "buyer_address", "amount_in_words", "description", "line_no")
YES, NO = ("yes", "y", "true", "1", "是", "included", "applicable"), ("no", "n", "false", "0", "not applicable", "not applicable.")
DOCUMENT_TYPES = {"invoice": "tax_invoice", "composition": "bill_of_supply"}


def boolean(x: Column) -> Column:
    """'true', 'false' or null of a word that says yes or no."""
    t = F.lower(squeeze(F.coalesce(x, F.lit(""))))
    return F.when(t.isin(*YES), "true").when(t.isin(*NO), "false")


def document_kind(x: Column) -> Column:
    """A document type by name: lower case, underscores, and what other names it has."""
    t = F.replace(F.lower(squeeze(x)), F.lit(" "), F.lit("_"))
    return F.coalesce(F.element_at(dims.mapping(DOCUMENT_TYPES), t), t)


def _notes(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, note) for cond, note in pairs]))


def normalised(rows: DataFrame, field: str, raw: str, as_of: Column, out: str = "value", notes: str = "notes") -> DataFrame:
    """Adds `out`, the text of the field's value in normal form, and `notes` (array<string>) of what is wrong with it.

    field: a column of field names, or of paths that end in one. What a field holds decides how it is read; a null raw
    text gives VALUE_MISSING, an unknown field its trimmed text and FIELD_UNRECOGNIZED.
    """
    name, x = F.lower(F.substring_index(F.col(field), ".", -1)), F.col(raw)
    df = money.with_money(rows.withColumns({"_k": name, "_m": F.when(name.isin(*MONEY_FIELDS), x)}), "_m", "_money")
    # What is used more than once is a column of its own, so that its expression is there once.
    # Each is read only where its field asks for it.
    of = lambda *names: F.when(F.col("_k").isin(*names), x)
    quantity = of("quantity")
    df = df.withColumns({
        "_text": squeeze(x), "_amount": F.translate(lookalikes(ascii_digits(squeeze(quantity))), ",", ""), "_date": dates.parse_date(of(*DATE_FIELDS)), "_hsn": ids.hsn(of("hsn_sac")),
        "_state": ids.state_of(of("place_of_supply")), "_unit": ids.unit(of("unit")), "_rate": money.parse_rate(of("tax_rate")), "_bool": boolean(of(*BOOLEAN_FIELDS)),
    })
    k, text, amount = F.col("_k"), F.col("_text"), F.col("_amount")
    date, tax, state, unit, hsn, rate, said_so = F.col("_date"), ids.gstin_normal(x), F.col("_state"), F.col("_unit"), F.col("_hsn"), F.col("_rate"), F.col("_bool")
    quantity = F.when(amount.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), amount.try_cast("decimal(38,10)"))
    no_text = F.coalesce(text, F.lit("")) == ""
    cases = [
        (k.isin(*MONEY_FIELDS), F.col("_money").cast("string"), F.col("_money_notes")),
        (k.isin(*DATE_FIELDS), date.cast("string"), dates.date_notes(x, as_of, date)),
        (k.isin(*GSTIN_FIELDS), tax, _notes((tax.isNull(), "GSTIN_EMPTY"))),
        (k == "tax_rate", money.short(rate), _notes((no_text, "RATE_MISSING"), (~no_text & rate.isNull(), "RATE_INVALID"))),
        (k == "quantity", money.short(quantity), _notes((quantity.isNull(), "QUANTITY_INVALID"))),
        (k == "hsn_sac", hsn, F.array_compact(F.array(ids.hsn_note(x)))),
        (k == "place_of_supply", F.nullif(F.coalesce(state, text), F.lit("")), _notes((no_text, "POS_MISSING"), (~no_text & state.isNull(), "STATE_UNKNOWN"))),
        (k == "unit", unit, _notes((~F.coalesce(unit.isin(*dims.UNITS), F.lit(False)), "UOM_UNKNOWN"))),
        (k.isin(*BOOLEAN_FIELDS), said_so, _notes((said_so.isNull(), "BOOLEAN_INVALID"))),
        (k == "invoice_no", ids.invoice_no(x), F.array_compact(F.array(ids.invoice_no_note(x)))),
        (k == "document_type", document_kind(x), _notes()),
        (k.isin(*TEXT_FIELDS), F.nullif(text, F.lit("")), _notes()),
    ]
    value, said = F.when(x.isNull(), F.lit(None).cast("string")), F.when(x.isNull(), F.array(F.lit("VALUE_MISSING")))
    for cond, v, n in cases:
        value, said = value.when(cond, v), said.when(cond, n.cast("array<string>"))
    value, said = value.otherwise(F.nullif(text, F.lit(""))), said.otherwise(F.array(F.lit("FIELD_UNRECOGNIZED")))
    return df.withColumns({out: value, notes: said}).drop("_k", "_m", "_money", "_money_notes", "_text", "_amount", "_date", "_hsn", "_state", "_unit", "_rate", "_bool")


def cell_fields(cells: DataFrame, field: str, raw: str, source: str, ref: str, as_of: Column) -> DataFrame:
    """Cells of a table as fields: adds value, confidence (0.97), status, sources, source_ref, evidence and note.

    Rates may be fractions, quantities have four places, codes are padded to 4, 6 or 8 digits (HSN_PADDED). A cell that
    cannot be read keeps its raw text and is to be reviewed; an empty one is missing.
    """
    x = F.nullif(F.col(raw), F.lit(""))
    df = normalised(cells.withColumn("_x", x), field, "_x", as_of)
    k = F.lower(F.substring_index(F.col(field), ".", -1))
    rates = k.isin("tax_rate", "cgst_rate", "sgst_rate", "igst_rate", "cess_rate")
    number = money.lenient(F.col("_x"))
    quantity = F.round(number, 4).cast("decimal(18,4)")
    code, plain = ids.hsn_padded(F.col("_x")), (k == "hsn_sac") & F.trim("_x").rlike("^[0-9]+$") & ~F.length("_x").isin(4, 6, 8)
    date = dates.cell_date(F.col("_x"))
    value = (
        F.when(rates, money.short(money.fraction_rate(F.col("_x")))).when(k == "quantity", money.short(quantity)).when(plain, code)
        .when(k.isin(*DATE_FIELDS), date.cast("string")).when(k == "description", F.trim("_x")).otherwise(F.col("value"))
    )
    bad = F.when(rates | (k == "quantity"), number.isNull()).when(plain | (k == "description"), False).when(k.isin(*DATE_FIELDS), date.isNull()).otherwise(F.size("notes") > 0)
    note = F.when(plain & (code != F.col("_x")), "HSN_PADDED").when(k.isin(*MONEY_FIELDS), F.nullif(F.array_join("notes", ","), F.lit("")))
    out = df.withColumns({"_v": value, "_bad": bad, "note": note})
    none = F.col("_x").isNull()
    return out.withColumns({
        "value": F.when(~none, F.col("_v")), "confidence": F.when(none, 0.0).otherwise(GIVEN), "status": F.when(none, "missing").when(F.col("_bad"), "needs_review").otherwise("accepted"),
        "sources": F.when(none, F.array().cast("array<string>")).otherwise(F.array(F.lit(source))), "source_ref": F.when(~none, F.col(ref)), "evidence": F.col("_x"),
    }).drop("_x", "_v", "_bad", "notes")


def merged_fields(hyps: DataFrame, key: str, as_of: Column, alternatives: int = 3) -> DataFrame:
    """One value for each key and field of hypotheses (field, value, confidence, source, evidence): hypotheses alike in normal form
    support each other.

    key, field, value, raw, confidence, status, sources, alternatives, ambiguous, note and evidence (those of the surest
    hypothesis of the winning value, the first of equals), qr_conflict (a code's value stands against others).
    """
    known = hyps.where(F.col(key).isNotNull() & F.col("field").isNotNull()).withColumnRenamed("value", "raw")
    x = normalised(known, "field", "raw", as_of).withColumn("note", F.nullif(F.array_join("notes", ","), F.lit("")))
    # A condition on the value itself would be pushed down with all that the value is made of, thousands of expressions for each row.
    x = x.select(F.col(key).alias("doc_id"), "field", "source", "confidence", F.explode(F.array(F.struct("value", "raw", "note", "evidence"))).alias("t"))
    x = x.where("t.value is not null").select("doc_id", "field", "t.value", "source", "confidence", "t")
    out = merge.merge(x, alternatives=alternatives, carried="t", order=F.struct("confidence", "t.raw"))
    invalid = F.when(F.col("field").isin(*GSTIN_FIELDS), ids.gstin_valid(F.col("value")))
    sure = confidence.cap(F.col("score"), F.lit(False), invalid, F.coalesce(F.col("t.note").contains("DATE_AMBIGUOUS_DAY_FIRST"), F.lit(False)), F.lit(False))
    return out.select(
        F.col("doc_id").alias(key), "field", "value", F.col("t.raw").alias("raw"), sure.alias("confidence"), F.when((sure >= CONF_OK) & ~F.col("ambiguous"), "accepted").otherwise("needs_review").alias("status"),
        "sources", "alternatives", "ambiguous", F.col("t.note").alias("note"), F.col("t.evidence").alias("evidence"), (F.array_contains("sources", "qr") & (F.size("alternatives") > 0)).alias("qr_conflict"),
    )


#: Fixed value: the path of a field of the header, or of a line.
PATH = r"^(?:invoice\.([a-z_]+)|line_items\[(\d+)\]\.([a-z_]+))$"


def parsed_path(path: Column) -> Column:
    """struct<field, line>: the field that a path names, and its line (from 0; null: the header); null for another text."""
    line = F.nullif(F.regexp_extract(path, PATH, 2), F.lit("")).cast("int")
    field = F.coalesce(F.nullif(F.regexp_extract(path, PATH, 1), F.lit("")), F.regexp_extract(path, PATH, 3))
    return F.when(path.rlike(PATH), F.struct(field.alias("field"), line.alias("line")))


def prepended(old: Column, alternatives: Column, most: int = 3) -> Column:
    """Alternatives with an old value before them, `most` at most; a null old value is none."""
    return F.when(old.isNull(), alternatives).otherwise(F.slice(F.concat(F.array(old), F.coalesce(alternatives, F.array().cast("array<string>"))), 1, most))


def edited(fields: DataFrame, edits: DataFrame, key: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(fields after edits by hand, edits that were turned away).

    fields: key, line (null: header), field, value, raw, confidence, status, sources, alternatives. edits: key, seq, path, new.
    The last valid edit of a path counts; its value is human_verified with confidence 1, and the old value becomes the first
    alternative. Turned away are unknown paths (INVALID_PATCH) and values that cannot be read.
    """
    x = normalised(edits.withColumn("_p", parsed_path(F.col("path"))).withColumns({"field": F.col("_p.field"), "line": F.col("_p.line")}), "field", "new", as_of, "_new", "_notes")
    known = fields.select(key, F.coalesce("line", F.lit(-1)).alias("_line"), "field", F.lit(True).alias("_known"))
    x = x.withColumn("_line", F.coalesce("line", F.lit(-1))).join(known, [key, "_line", "field"], "left")
    bad = F.col("_p").isNull() | F.col("_known").isNull() | ((F.size("_notes") > 0) & F.col("new").isNotNull())
    away = x.where(bad).select(key, "seq", "path", F.lit("INVALID_PATCH").alias("code"), F.when(F.col("_known").isNotNull(), F.col("_notes")).alias("issues"))
    last = x.where(~bad).groupBy(key, "_line", "field").agg(F.max_by(F.struct(F.col("_new").alias("value"), F.col("new").alias("raw")), "seq").alias("e"), F.lit(True).alias("_edited"))
    out = fields.withColumn("_line", F.coalesce("line", F.lit(-1))).join(last, [key, "_line", "field"], "left")
    on = F.coalesce("_edited", F.lit(False))
    return out.withColumns({
        "alternatives": F.when(on, prepended(F.col("value"), F.col("alternatives"))).otherwise(F.col("alternatives")), "value": F.when(on, F.col("e.value")).otherwise(F.col("value")), "raw": F.when(on, F.col("e.raw")).otherwise(F.col("raw")),
        "status": F.when(on, "human_verified").otherwise(F.col("status")), "confidence": F.when(on, 1.0).otherwise(F.col("confidence")), "sources": F.when(on, F.array_union("sources", F.array(F.lit("human")))).otherwise(F.col("sources")),
    }).drop("_line", "e", "_edited"), away


#: The options of a job, and how an extractor may be chosen.
OPTIONS, MODES, MOST_SECONDS = ("extractor_mode", "expect_handwritten", "pdf_password", "force", "timeout_s"), ("auto", "vlm", "rules"), 300


def options_error(json: Column) -> Column:
    """What is wrong with a job's options (a JSON object), or null."""
    keys, mode = F.json_object_keys(json), F.get_json_object(json, "$.extractor_mode")
    seconds = F.get_json_object(json, "$.timeout_s")
    empty = F.coalesce(json, F.lit("")) == ""
    whole = seconds.rlike("^-?[0-9]+$") & seconds.try_cast("int").between(1, MOST_SECONDS)
    return (
        F.when(empty, F.lit(None).cast("string")).when(keys.isNull(), "options must be a JSON object").when(F.size(F.array_except(keys, F.array(*[F.lit(o) for o in OPTIONS]))) > 0, "Unsupported processing option")
        .when(mode.isNotNull() & ~mode.isin(*MODES), "extractor_mode must be auto, vlm or rules").when(seconds.isNotNull() & ~F.coalesce(whole, F.lit(False)), f"timeout_s must be between 1 and {MOST_SECONDS}")
    )


def canonical_options(json: Column) -> Column:
    """The options with sorted keys and without the password, as JSON: what jobs alike in options share."""
    entries = F.map_entries(F.from_json(F.coalesce(F.nullif(json, F.lit("")), F.lit("{}")), "map<string,string>"))
    kept = F.array_sort(F.filter(entries, lambda e: e["key"] != "pdf_password"))
    bare = lambda e: e["value"].rlike(r"^(true|false|null|-?\d+(\.\d+)?)$")
    pairs = F.transform(kept, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.when(bare(e), e["value"]).otherwise(F.concat(F.lit('"'), e["value"], F.lit('"')))))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def allowed_output(json: Column, fields: tuple[str, ...]) -> Column:
    """Of a model's answer (a JSON object) the known fields with scalar values, as a map; anything else gives an empty map."""
    got = F.from_json(json, "map<string,string>")
    known = F.map_filter(got, lambda k, v: k.isin(*fields) & ~F.coalesce(v.rlike(r"^\s*[\[{]"), F.lit(False)))
    return F.coalesce(known, F.create_map().cast("map<string,string>"))


def qr_fields(payload: Column) -> Column:
    """array<struct<field, value, confidence, source>> of a decoded e-invoice payload; the type by its code."""
    kind = F.element_at(dims.mapping({"INV": "tax_invoice", "CRN": "credit_note", "DBN": "debit_note"}), F.upper(payload["DocTyp"]))
    named = (("supplier_gstin", payload["SellerGstin"]), ("buyer_gstin", payload["BuyerGstin"]), ("invoice_no", payload["DocNo"]), ("invoice_date", payload["DocDt"]), ("total_amount", payload["TotInvVal"]), ("document_type", kind))
    every = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value"), F.lit(0.99).alias("confidence"), F.lit("qr").alias("source")) for f, v in named])
    return F.filter(every, lambda e: F.coalesce(e["value"], F.lit("")) != "")
