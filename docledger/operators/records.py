"""Whole records from the texts of documents: hypotheses of all readers, one value for each field, line items, and what the rules take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.operators import extract, fields, items

#: Header columns of the rules, and the fields that they come from.
HEADER = {
    "invoice_no": "invoice_no", "invoice_date": "invoice_date", "due_date": "due_date", "document_type": "document_type", "supplier_gstin": "supplier_gstin", "buyer_gstin": "buyer_gstin",
    "pos": "place_of_supply", "taxable": "taxable_value", "discount": "discount", "cgst": "cgst", "sgst": "sgst", "igst": "igst", "cess": "cess", "total_tax": "total_tax", "round_off": "round_off",
    "total": "total_amount", "words_text": "amount_in_words", "reverse_charge": "reverse_charge", "price_includes_tax": "price_includes_tax",
}
BODY = {"quantity": "quantity", "unit_price": "unit_price", "discount": "discount", "taxable": "taxable_value", "rate": "tax_rate", "cgst": "cgst", "sgst": "sgst", "igst": "igst", "cess": "cess", "line_total": "line_total"}
#: What the rules' confidence of a line's field is.
LINE_SURE = 0.80


def line_fields(rows: DataFrame, key: str, as_of: Column) -> DataFrame:
    """key, item_no, field, raw, value and notes of the texts in line items (key, item_no, item)."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"item.{f}").alias("raw")) for f in items.FIELDS])
    long = rows.select(key, "item_no", F.explode(F.filter(parts, lambda p: p["raw"].isNotNull())).alias("p")).select(key, "item_no", "p.*")
    return fields.normalised(long, "field", "raw", as_of)


def from_texts(docs: DataFrame, key: str, text: str, as_of: str, model: DataFrame | None = None) -> dict[str, DataFrame]:
    """fields, lines, headers and body of documents (key, text).

    fields: a row for each document and field, as of fields.merged_fields(). lines: key, item_no and a column for each field of
    a line in normal form. headers and body: what validation.validate() takes, with the fields' confidences. model: further
    hypotheses (key, field, value, confidence, source), such as the layout model's or a code's.
    """
    day = F.lit(as_of).cast("date")
    said = extract.hypotheses(docs, key, text)
    if model is not None:
        said = extract.with_model(said, model)
    won = fields.merged_fields(said, key, day)
    wide = won.groupBy(key).agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(c) for c, f in HEADER.items()],
        *[F.max(F.when(F.col("field") == HEADER[c], F.col("confidence"))).alias(f"{c}_confidence") for c in ("invoice_no", "invoice_date", "taxable", "total", "supplier_gstin", "buyer_gstin")],
        F.max("qr_conflict").alias("qr_conflict"),
    )
    long = line_fields(items.line_items(docs, key, text), key, day)
    lines = long.groupBy(key, "item_no").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in items.FIELDS])
    counted = lines.groupBy(key).agg(F.count("*").alias("n_lines"))
    heads = docs.select(key).join(wide, key, "left").join(counted, key, "left").withColumn("pos", F.substring("pos", 1, 2)).withColumnRenamed(key, "record")
    body = lines.select(F.col(key).alias("record"), F.col("item_no").cast("int").alias("line_idx"), *[F.col(f).alias(c) for c, f in BODY.items()], F.when(F.col("taxable_value").isNotNull(), LINE_SURE).otherwise(0.0).alias("taxable_confidence"))
    return {"fields": won, "lines": lines, "headers": heads, "body": body}
