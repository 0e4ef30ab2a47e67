"""Queries of field values, the layout model, results, repairs and job state."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.operators import dedupe, extract, fields, layout, merge, repair, results, spatial, validation
from docledger.plans.catalog import AS_OF, query
from docledger.plans.views import VIEWS

#: A page of tokens for each order: (token, text, x0, y0, x1).
_TOKENS = (
    (1, "'Invoice no:'", 0.05, 0.05, 0.15), (2, "invoice_no", 0.16, 0.05, 0.30), (3, "concat('Date of issue: 0', cast(o_orderkey % 9 + 1 as string), '/06/2024')", 0.05, 0.08, 0.30), (4, "'Due date'", 0.05, 0.11, 0.15),
    (5, "'07/08/2024'", 0.16, 0.11, 0.30), (6, "'Seller:'", 0.05, 0.20, 0.12), (7, "'Client:'", 0.55, 0.20, 0.60), (8, "'Acme'", 0.05, 0.24, 0.10), (9, "concat('No', cast(o_orderkey % 7 as string))", 0.11, 0.245, 0.20),
    (10, "'Zeta Co'", 0.55, 0.24, 0.70), (11, "'12 Main Street'", 0.05, 0.28, 0.20), (12, "'Town'", 0.05, 0.31, 0.10), (13, "concat('Tax Id: 12-', cast(o_orderkey as string))", 0.05, 0.34, 0.20), (14, "'IBAN: GB1'", 0.05, 0.37, 0.20),
    (15, "'Tax Id: 99-K'", 0.55, 0.34, 0.70), (16, "'ITEMS'", 0.05, 0.45, 0.10), (17, "'Description'", 0.12, 0.50, 0.20), (18, "'1.'", 0.05, 0.55, 0.07), (19, "'Widget'", 0.15, 0.55, 0.20), (20, "concat('X', cast(o_orderkey % 5 as string))", 0.21, 0.55, 0.25),
    (21, "'2,00'", 0.39, 0.55, 0.43), (22, "'each'", 0.46, 0.55, 0.50), (23, "'10,00'", 0.55, 0.55, 0.60), (24, "'10%'", 0.75, 0.55, 0.80), (25, "'1 022,00'", 0.85, 0.55, 0.92), (26, "'long'", 0.15, 0.58, 0.20), (27, "'2.'", 0.05, 0.61, 0.07),
    (28, "'Bolt'", 0.15, 0.61, 0.20), (29, "'7,50'", 0.55, 0.64, 0.60), (30, "'SUMMARY'", 0.05, 0.70, 0.20), (31, "'Total'", 0.05, 0.75, 0.10),
)
VIEWS["page_tokens"] = "select o_orderkey, cast(token_id as bigint) as token_id, case token_id " + " ".join(f"when {i} then {t}" for i, t, *_ in _TOKENS) + " end as text, cast(x0 as double) as x0, cast(y0 as double) as y0, cast(x1 as double) as x1, cast(y0 + 0.01 as double) as y1 from inv_headers cross join (" + " union all ".join(f"select {i} as token_id, {x0} as x0, {y0} as y0, {x1} as x1" for i, _, x0, y0, x1 in _TOKENS) + ") s"
VIEWS["page_layouts"] = "select o_orderkey, case when o_orderkey % 2 = 0 then concat('Total $ 1 000,00 $ 100,00 $ 1 1', cast(o_orderkey % 10 as string), '0,00') else concat('Invoice number: A', cast(o_orderkey as string), ' Grand Total: 55.5', cast(o_orderkey % 10 as string)) end as text from inv_headers"


def long_sql(key: str, table: str, *pairs: tuple[str, str]) -> str:
    return " union all ".join(f"select {key}, '{f}' as field, {v} as value from {table}" for f, v in pairs)


@query("d13_header_tokens", long_sql("o_orderkey", "inv_headers", ("invoice_no", "invoice_no"), ("invoice_date", "'0' || cast(o_orderkey % 9 + 1 as varchar) || '/06/2024'"), ("due_date", "'07/08/2024'")))
def _(t, spark):
    return layout.header_fields(t("page_tokens"), "o_orderkey", t("page_layouts")).select("o_orderkey", "field", "value")


@query("d14_parties", long_sql("o_orderkey", "inv_headers", ("supplier_name", "'Acme No' || cast(o_orderkey % 7 as varchar)"), ("supplier_address", "'12 Main Street' || chr(10) || 'Town'"), ("supplier_gstin", "'12-' || cast(o_orderkey as varchar)"), ("buyer_name", "'Zeta Co'"), ("buyer_gstin", "'99-K'")))
def _(t, spark):
    return layout.party_fields(t("page_tokens"), "o_orderkey", "long").select("o_orderkey", "field", "value")


@query("d15_totals", "select o_orderkey, field, value, conf as confidence from (" + " union all ".join(f"select o_orderkey, '{f}' as field, {v} as value, {c} as conf from inv_headers where o_orderkey % 2 = {m}" for f, v, c, m in (("subtotal", "'1000.00'", 0.94, 0), ("total_tax", "'100.00'", 0.93, 0), ("total_amount", "'11' || cast(o_orderkey % 10 as varchar) || '0.00'", 0.96, 0), ("total_amount", "'55.5' || cast(o_orderkey % 10 as varchar)", 0.96, 1))) + ") a")
def _(t, spark):
    return layout.total_fields(t("page_layouts"), "o_orderkey").select("o_orderkey", "field", "value", "confidence")


@query("d16_items", "select o_orderkey, 1 as item_no, '1' as line_no, 'Widget X' || cast(o_orderkey % 5 as varchar) || ' long' as description, '2.00' as quantity, 'each' as unit, '10.00' as unit_price, '10%' as tax_rate, '1022.00' as line_total from inv_headers union all select o_orderkey, 2, '2', 'Bolt', null, null, '7.50', null, null from inv_headers")
def _(t, spark):
    return layout.item_fields(t("page_tokens"), "o_orderkey", "long")


@query("w03_bands", "select o_orderkey, token_id, dense_rank() over (partition by o_orderkey order by case when token_id = 9 then 0.24 else y0 end) as line_id from page_tokens")
def _(t, spark):
    return layout.bands(t("page_tokens"), "o_orderkey", "long")


@query("j18_value_tokens", "select o_orderkey, 'n' as field, token_id from page_tokens where token_id in (8, 9) union all select o_orderkey, 'n', token_id from page_tokens where (token_id = 18 and o_orderkey % 7 = 1) or (token_id = 27 and o_orderkey % 7 = 2) union all select o_orderkey, 'street', 11 from page_tokens where token_id = 11")
def _(t, spark):
    v = t("inv_headers").select("o_orderkey", F.explode(F.array(F.struct(F.lit("n").alias("field"), F.expr("concat('Acme No', cast(o_orderkey % 7 as string))").alias("value")), F.struct(F.lit("street").alias("field"), F.lit("the Main road").alias("value")))).alias("v")).select("o_orderkey", "v.*")
    return layout.tokens_for_value(v, t("page_tokens"), ["o_orderkey"])


@query("s17_column_grid", "select o_orderkey, 1 as line_id, 'Qty,Description,Amount' as cells from inv_headers union all select o_orderkey, 2, '2,Blue Widget ' || cast(o_orderkey as varchar) || ',10.00' from inv_headers")
def _(t, spark):
    words = ((1, 1, "'Qty'", 0.1, 0.2), (1, 2, "'Description'", 0.3, 0.5), (1, 3, "'Amount'", 0.7, 0.9), (2, 4, "'2'", 0.12, 0.15), (2, 5, "'Blue'", 0.3, 0.35), (2, 6, "'Widget'", 0.36, 0.4), (2, 7, "cast(o_orderkey as string)", 0.41, 0.45), (2, 8, "'10.00'", 0.6, 0.8), (3, 9, "'Subtotal'", 0.1, 0.2), (4, 10, "'after'", 0.1, 0.2))
    rows = F.array(*[F.struct(F.lit(line).alias("line_id"), F.lit(i).cast("long").alias("token_id"), F.expr(text).alias("text"), F.lit(x0).alias("x0"), F.lit(x1).alias("x1")) for line, i, text, x0, x1 in words])
    return layout.column_grid(t("inv_headers").select("o_orderkey", F.explode(rows).alias("w")).select("o_orderkey", "w.*"), ["o_orderkey"])


@query("d12_table_bands", "select o_orderkey, case token_id when 18 then 'line_no' when 19 then 'description' when 20 then 'description' when 21 then 'quantity' when 22 then 'quantity' when 23 then 'unit_price' when 24 then 'line_total' else 'line_total' end as col, string_agg(text, ' ' order by x0) as text from page_tokens where token_id between 18 and 25 group by 1, 2")
def _(t, spark):
    heads = spark.sql("select * from values ('line_no', 0.06d), ('description', 0.2d), ('quantity', 0.41d), ('unit_price', 0.57d), ('line_total', 0.88d) as h(col, center)").withColumn("one", F.lit(1))
    tokens = t("page_tokens").where("token_id between 18 and 25").withColumn("one", F.lit(1))
    placed = spatial.into_bands(tokens, spatial.bands(heads, ["one"]), ["one"])
    return spatial.joined_cells(placed, ["o_orderkey", "col"])


@query("f66_normal_box", "select event_id, round(least(1.0, (10 + event_id % 300 / 2.0) / 150.0), 9) as x0, round(least(1.0, (20 + 5.0) / 100.0), 9) as y0 from events")
def _(t, spark):
    v = (F.col("event_id") % 300).cast("double")
    b = layout.normal_box([v, F.lit(10.0), v, F.lit(10.0)], F.lit(2.0), F.lit(10.0), F.lit(20.0), F.lit(150.0), F.lit(100.0))
    return t("events").select("event_id", F.round(b[0], 9).alias("x0"), F.round(b[1], 9).alias("y0"))


@query("f62_heuristic_score", "select event_id, round(case when event_id % 3 = 0 then (c + 0.5 + 0.25) / 3 else (c + 0.75 + case when event_id % 10 > 5 then 1 else 0 end) / 4 end, 9) as score from (select event_id, event_id % 10 / 10.0 as c from events) a")
def _(t, spark):
    c = (F.col("event_id") % 10) / 10
    s = layout.heuristic_score(c, F.lit(0.5), F.lit(0.25), F.when(F.col("event_id") % 3 != 0, c))
    return t("events").select("event_id", F.round(s, 9).alias("score"))


@query("d20_line_kinds", "select event_id, case when s >= 0.55 then 'handwritten' when s >= 0.40 then 'mixed' else 'printed' end as kind, case when s >= 0.55 then 0.8 else 0.95 end as conf from (select event_id, event_id % 10 / 10.0 as s from events) a")
def _(t, spark):
    e = t("events").select("event_id", F.lit(0.95).alias("conf"))
    return layout.classified(e, t("events").select("event_id", (F.col("event_id") % 10 / 10).alias("score")), ["event_id"]).select("event_id", "kind", "conf")


@query("a25_noise", "select user_id, max(event_id % 50 = 0) as noisy from events group by 1")
def _(t, spark):
    e = t("events").select("user_id", F.expr("case when event_id % 50 = 0 then 'a %unclear% b' else 'plain % text' end").alias("text"))
    return layout.noisy_lines(e, ["user_id"])


@query("d21_interpreted", "select event_id, case when event_id % 3 = 0 then 'amount' when event_id % 3 = 1 then 'text' end as role, case when event_id % 3 = 0 then '₹ 120.50' when event_id % 3 = 1 then 'lOose' else 'l0' end as reading from events")
def _(t, spark):
    from docledger.functions.text import interpreted

    e = t("events").select("event_id", F.expr("case event_id % 3 when 0 then '%sc% ₹ 120.50' when 1 then 'lOose' else 'l0' end").alias("text"), F.expr("case when event_id % 3 < 2 then 'handwritten' else 'printed' end").alias("kind"))
    return interpreted(e).select("event_id", "role", "reading")


@query("p25_input_kind", "select user_id, case when user_id % 2 = 0 then case when h < 0.15 then 'image_printed' when h >= 0.5 then 'image_handwritten' else 'image_mixed' end when k = 'digital' then 'pdf_digital' when k = 'scanned' then 'pdf_scanned' else 'pdf_mixed' end as input_kind from (select user_id, max(user_id % 10) / 10.0 as h, string_agg(distinct kind, ',' order by kind) as k from (select user_id, case when user_id % 3 = 0 then 'digital' when user_id % 3 = 1 then 'scanned' else case when event_id % 2 = 0 then 'digital' else 'mixed' end end as kind from events) a group by 1) b")
def _(t, spark):
    e = t("events").select("user_id", (F.col("user_id") % 2 == 0).alias("is_image"), F.expr("case user_id % 3 when 0 then 'digital' when 1 then 'scanned' else case when event_id % 2 = 0 then 'digital' else 'mixed' end end").alias("kind"), (F.col("user_id") % 10 / 10).alias("handwriting"))
    skipped = e.withColumn("kind", F.lit("skipped"))
    return layout.input_kind(e.union(skipped), "user_id")


_RAW = (
    ("total_amount", "concat('Rs. ', cast(o_orderkey as string), '.50')", "cast(o_orderkey as varchar) || '.50'", ""), ("invoice_date", "'2024-03-05'", "'2024-03-05'", ""), ("due_date", "'31-31-2024'", "null", "DATE_INVALID"),
    ("line_items[0].tax_rate", "'18 %'", "'18'", ""), ("tax_rate", "'x'", "null", "RATE_INVALID"), ("quantity", "'1,000.500'", "'1000.5'", ""), ("quantity", "'few'", "null", "QUANTITY_INVALID"),
    ("hsn_sac", "'12 34'", "'1234'", ""), ("place_of_supply", "'maharashtra'", "'27-Maharashtra'", ""), ("place_of_supply", "'nowhere'", "'nowhere'", "STATE_UNKNOWN"), ("unit", "'kgs'", "'KGS'", ""),
    ("reverse_charge", "' YES '", "'true'", ""), ("reverse_charge", "'maybe'", "null", "BOOLEAN_INVALID"), ("invoice_no", "' A  1 '", "'A 1'", ""), ("document_type", "'Composition'", "'bill_of_supply'", ""),
    ("document_type", "'Credit Note'", "'credit_note'", ""), ("supplier_gstin", "'27 aapfu-0939f1zv'", "'27AAPFU0939F1ZV'", ""), ("supplier_name", "' A   b '", "'A b'", ""), ("color", "' red '", "'red'", "FIELD_UNRECOGNIZED"), ("subtotal", "null", "null", "VALUE_MISSING"),
)


@query("f76_normalised", " union all ".join(f"select o_orderkey, {i} as n, {v} as value, '{n}' as notes from orders" for i, (_, _, v, n) in enumerate(_RAW)))
def _(t, spark):
    rows = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(f).alias("field"), F.expr(r).cast("string").alias("raw")) for i, (f, r, _, _) in enumerate(_RAW)])
    x = t("orders").select("o_orderkey", F.explode(rows).alias("r")).select("o_orderkey", "r.*")
    return fields.normalised(x, "field", "raw", F.lit(AS_OF).cast("date")).select("o_orderkey", "n", "value", F.array_join("notes", ",").alias("notes"))


@query("f77_boolean", "select o_orderkey, case o_orderkey % 5 when 0 then 'true' when 1 then 'false' when 2 then 'true' when 3 then 'false' end as b from orders")
def _(t, spark):
    return t("orders").select("o_orderkey", fields.boolean(F.expr("case o_orderkey % 5 when 0 then 'Y' when 1 then 'Not applicable.' when 2 then '是' when 3 then ' 0 ' else 'x' end")).alias("b"))


@query("f78_document_kind", "select o_orderkey, case o_orderkey % 3 when 0 then 'tax_invoice' when 1 then 'bill_of_supply' else 'export_invoice' end as kind from orders")
def _(t, spark):
    return t("orders").select("o_orderkey", fields.document_kind(F.expr("case o_orderkey % 3 when 0 then ' Invoice' when 1 then 'COMPOSITION' else 'Export invoice' end")).alias("kind"))


_CELLS = (
    ("tax_rate", "'0.18'", "'18'", "accepted", ""), ("quantity", "'2.50000'", "'2.5'", "accepted", ""), ("quantity", "'two'", "null", "needs_review", ""), ("hsn_sac", "'123'", "'0123'", "accepted", "HSN_PADDED"),
    ("taxable_value", "'1,234.5'", "'1234.50'", "accepted", ""), ("invoice_date", "'05/06/2024'", "'2024-06-05'", "accepted", ""), ("invoice_date", "'soon'", "null", "needs_review", ""), ("description", "' a  b '", "'a  b'", "accepted", ""), ("unit", "''", "null", "missing", ""),
)


@query("p17_cell_fields", " union all ".join(f"select o_orderkey, {i} as n, {v} as value, '{s}' as status, {0.0 if s == 'missing' else 0.97} as confidence, '{n}' as note from orders" for i, (_, _, v, s, n) in enumerate(_CELLS)))
def _(t, spark):
    rows = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(f).alias("field"), F.expr(r).cast("string").alias("raw")) for i, (f, r, *_) in enumerate(_CELLS)])
    x = t("orders").select("o_orderkey", F.explode(rows).alias("r")).select("o_orderkey", "r.*").withColumn("ref", F.lit("S!R1"))
    return fields.cell_fields(x, "field", "raw", "csv", "ref", F.lit(AS_OF).cast("date")).select("o_orderkey", "n", "value", "status", "confidence", F.coalesce("note", F.lit("")).alias("note"))


@query("p21_document_at", "select o_custkey, case when n > 1 then second end as doc from (select o_custkey, count(*) as n, min(o_orderkey) filter (r = 2) as second from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as r from orders) a group by 1) b")
def _(t, spark):
    g = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("d"))
    return g.select("o_custkey", F.coalesce(results.document_at(F.col("d"), F.lit(-1)), results.document_at(F.col("d"), F.lit(1))).alias("doc"))


@query("p22_edits", "select o_orderkey, 'invoice_no' as field, 'N2' as value, 'human_verified' as status, '' || cast(o_orderkey as varchar) as alternatives from orders where o_orderkey % 2 = 0 union all select o_orderkey, 'invoice_no', cast(o_orderkey as varchar), 'accepted', '' from orders where o_orderkey % 2 = 1 union all select o_orderkey, 'quantity', '3', 'human_verified', '2' from orders")
def _(t, spark):
    o = t("orders")
    old = o.select("o_orderkey", F.lit(None).cast("int").alias("line"), F.lit("invoice_no").alias("field"), F.col("o_orderkey").cast("string").alias("value")).union(o.select("o_orderkey", F.lit(0), F.lit("quantity"), F.lit("2")))
    old = old.select("*", F.col("value").alias("raw"), F.lit(0.97).alias("confidence"), F.lit("accepted").alias("status"), F.array(F.lit("csv")).alias("sources"), F.array().cast("array<string>").alias("alternatives"))
    said = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(p).alias("path"), F.lit(v).alias("new")) for i, (p, v) in enumerate((("invoice.invoice_no", "N1"), ("invoice.invoice_no", " N2 "), ("line_items[0].quantity", "3.0"), ("line_items[0].quantity", "many"), ("invoice.nothing", "x"), ("what", "y")))])
    edits = o.select("o_orderkey", F.explode(said).alias("e")).select("o_orderkey", "e.*").where("o_orderkey % 2 = 0 or path not like 'invoice.inv%'")
    done, _ = fields.edited(old, edits, "o_orderkey", F.lit(AS_OF).cast("date"))
    return done.select("o_orderkey", "field", "value", "status", F.array_join("alternatives", ",").alias("alternatives"))


@query("p22_rejected_edits", "select o_orderkey, case n when 0 then 'invoice.nothing' when 1 then 'what' else 'invoice.total_amount' end as path, 'INVALID_PATCH' as code from orders cross join (select unnest([0, 1, 2]) as n) s")
def _(t, spark):
    o = t("orders")
    old = o.select("o_orderkey", F.lit(None).cast("int").alias("line"), F.lit("total_amount").alias("field"), F.lit("1").alias("value"), F.lit("1").alias("raw"), F.lit(0.97).alias("confidence"), F.lit("accepted").alias("status"), F.array(F.lit("csv")).alias("sources"), F.array().cast("array<string>").alias("alternatives"))
    said = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(p).alias("path"), F.lit("x").alias("new")) for i, p in enumerate(("invoice.nothing", "what", "invoice.total_amount"))])
    return fields.edited(old, o.select("o_orderkey", F.explode(said).alias("e")).select("o_orderkey", "e.*"), "o_orderkey", F.lit(AS_OF).cast("date"))[1].select("o_orderkey", "path", "code")


@query("f80_prepended", "select o_orderkey, case when o_orderkey % 2 = 0 then 'v,a,b' else 'a,b,c' end as alternatives from orders")
def _(t, spark):
    old = F.when(F.col("o_orderkey") % 2 == 0, "v")
    return t("orders").select("o_orderkey", fields.prepended(old, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("alternatives"))


_OPTIONS = (("", ""), ("[1]", "options must be a JSON object"), ('{"a":1}', "Unsupported processing option"), ('{"extractor_mode":"x"}', "extractor_mode must be auto, vlm or rules"), ('{"timeout_s":301}', "timeout_s must be between 1 and 300"), ('{"timeout_s":5,"force":true,"extractor_mode":"rules"}', ""))


@query("p23_options", "select o_orderkey, case o_orderkey % 6 " + " ".join(f"when {i} then '{e}'" for i, (_, e) in enumerate(_OPTIONS)) + " end as error from orders")
def _(t, spark):
    json = F.expr("case o_orderkey % 6 " + " ".join(f"when {i} then '{j}'" for i, (j, _) in enumerate(_OPTIONS)) + " end")
    return t("orders").select("o_orderkey", F.coalesce(fields.options_error(json), F.lit("")).alias("error"))


@query("f74_canonical_options", """select o_orderkey, '{"expect_handwritten":true,"extractor_mode":"auto","timeout_s":' || cast(o_orderkey % 300 as varchar) || '}' as json from orders""")
def _(t, spark):
    json = F.concat(F.lit('{"timeout_s": '), (F.col("o_orderkey") % 300).cast("string"), F.lit(', "pdf_password": "p", "extractor_mode": "auto", "expect_handwritten": true}'))
    return t("orders").select("o_orderkey", fields.canonical_options(json).alias("json"))


@query("p24_allowed_output", "select o_orderkey, 'invoice_no' as field, cast(o_orderkey as varchar) as value from orders union all select o_orderkey, 'total_amount', '1.5' from orders")
def _(t, spark):
    json = F.concat(F.lit('{"invoice_no": "'), F.col("o_orderkey").cast("string"), F.lit('", "total_amount": 1.5, "secret": "x", "invoice_date": {"a": 1}, "buyer_name": ["b"]}'))
    m = fields.allowed_output(json, ("invoice_no", "total_amount", "invoice_date", "buyer_name"))
    return t("orders").select("o_orderkey", F.explode(m).alias("field", "value"))


@query("f72_qr_fields", "select o_orderkey, 'invoice_no' as field, cast(o_orderkey as varchar) as value, 0.99 as confidence from orders union all select o_orderkey, 'document_type', 'credit_note', 0.99 from orders")
def _(t, spark):
    none = F.lit(None).cast("string")
    p = F.struct(none.alias("SellerGstin"), none.alias("BuyerGstin"), F.col("o_orderkey").cast("string").alias("DocNo"), F.lit("crn").alias("DocTyp"), F.lit("").alias("DocDt"), none.alias("TotInvVal"))
    return t("orders").select("o_orderkey", F.explode(fields.qr_fields(p)).alias("f")).select("o_orderkey", "f.field", "f.value", "f.confidence")


@query("d18_merged_fields", "select o_orderkey, 'total_amount' as field, cast(o_orderkey as varchar) || '.00' as value, round(0.85, 6) as confidence, 'needs_review' as status, o_orderkey % 2 = 0 as qr_conflict from orders where false union all select o_orderkey, 'total_amount', cast(o_orderkey as varchar) || '.00', case when o_orderkey % 2 = 0 then 0.99 else round(1 - 0.2 * 0.25, 6) end, 'accepted', o_orderkey % 2 = 0 from orders")
def _(t, spark):
    o = t("orders")
    say = lambda v, s, c: F.struct(F.expr(v).alias("value"), F.lit(s).alias("source"), F.lit(c).alias("confidence"))
    rows = F.array(say("concat('Rs ', cast(o_orderkey as string))", "rules", 0.8), say("concat(cast(o_orderkey as string), '.00')", "vlm", 0.75), F.when(F.col("o_orderkey") % 2 == 0, say("concat(cast(o_orderkey as string), '/-')", "qr", 0.99)), F.when(F.col("o_orderkey") % 2 == 0, say("'7'", "trocr", 0.5)))
    x = o.select("o_orderkey", F.explode(F.array_compact(rows)).alias("h")).select("o_orderkey", F.lit("total_amount").alias("field"), "h.*", F.lit("e").alias("evidence"))
    return fields.merged_fields(x, "o_orderkey", F.lit(AS_OF).cast("date")).select("o_orderkey", "field", "value", F.round("confidence", 6).alias("confidence"), "status", "qr_conflict")


@query("a12_representative", "select doc_id, arg_max(source, (confidence, -k)) as source from (select *, case source when 'ocr' then 1 when 'rules' then 2 when 'vlm' then 3 else 4 end as k from hypotheses) a group by 1")
def _(t, spark):
    x = t("hypotheses").withColumn("k", F.expr("case source when 'ocr' then 1 when 'rules' then 2 when 'vlm' then 3 else 4 end"))
    return merge.representative(x, ["doc_id"], "k", ["source"])


@query("a22_prf", "select source, count(*) as n, round(avg(cast(p = t as int)), 9) as accuracy, round(sum(cast(p and t as int)) / sum(cast(p as int)), 9) as prec, round(sum(cast(p and t as int)) / sum(cast(t as int)), 9) as recall, round(2.0 * sum(cast(p and t as int)) / (sum(cast(p as int)) + sum(cast(t as int))), 9) as f1 from (select source, doc_id % 3 = 0 as t, doc_id % 4 <> 1 as p from hypotheses) a group by 1")
def _(t, spark):
    x = t("hypotheses").select("source", (F.col("doc_id") % 3 == 0).alias("t"), (F.col("doc_id") % 4 != 1).alias("p"))
    g = results.scores(x, ["source"], "t", "p")
    return g.select("source", "n", *[F.round(c, 9).alias(a) for c, a in (("accuracy", "accuracy"), ("precision", "prec"), ("recall", "recall"), ("f1", "f1"))])


@query("d19_grounded", "select o_orderkey as doc_id, case when o_orderkey % 3 = 0 then 0.375 else 0.9 end as confidence, o_orderkey % 3 > 0 as grounded, case when o_orderkey % 3 > 0 then 0.5 end as x0 from orders")
def _(t, spark):
    o = t("orders").withColumnRenamed("o_orderkey", "doc_id")
    v = o.select("doc_id", F.lit("invoice_no").alias("field"), F.lit(1).alias("page"), F.concat(F.lit("NO-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("value"), F.lit(0.9).alias("confidence"))
    word = F.expr("case doc_id % 3 when 1 then concat('NO-', lpad(cast(doc_id as string), 8, '0'), 'x') when 2 then concat('n0-', lpad(cast(doc_id as string), 8, '0'), 'x') else concat('NO-', lpad(cast(doc_id as string), 8, '0'), 'xyz') end")
    k = o.select("doc_id", F.lit(1).alias("page"), word.alias("token"), F.lit(1).alias("pos"), F.expr("case when doc_id % 3 = 2 then 'handwritten' else 'printed' end").alias("kind"), *[F.lit(0.5).alias(c) for c in ("x0", "y0", "x1", "y1")])
    other = k.withColumns({"page": F.lit(2), "token": F.concat(F.lit("NO-"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))})
    return merge.ground(v, k.union(other)).select("doc_id", "confidence", "grounded", "x0")


@query("v07_qr_mismatch", "select o_orderkey as record, 'QR_MISMATCH' as code, 'error' as severity from inv_headers where o_orderkey % 4 = 0")
def _(t, spark):
    h = t("inv_headers").withColumn("qr_conflict", F.col("o_orderkey") % 4 == 0).withColumnRenamed("o_orderkey", "record")
    return validation.checks(h, t("inv_line_tax").withColumnRenamed("l_orderkey", "record"), AS_OF).where("code = 'QR_MISMATCH'").select("record", "code", "severity")


@query("v09_due_before", "select o_orderkey as record, 'DUE_BEFORE_INVOICE' as code, 'warning' as severity, true as passed from inv_headers where o_orderkey % 3 = 0 and invoice_date is not null")
def _(t, spark):
    h = t("inv_headers").withColumn("due_date", F.date_add("invoice_date", F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(0))).withColumnRenamed("o_orderkey", "record")
    return validation.checks(h, t("inv_line_tax").withColumnRenamed("l_orderkey", "record"), AS_OF).where("code = 'DUE_BEFORE_INVOICE'").select("record", "code", "severity", "passed")


@query("v11_invalid_date", "select o_orderkey as record, 'DATE_MISSING' as code from inv_headers where o_orderkey % 5 = 0 or invoice_date is null")
def _(t, spark):
    h = t("inv_headers").withColumn("invoice_date", F.expr("try_cast(case when o_orderkey % 5 = 0 then '2024-13-45' else cast(invoice_date as string) end as date)")).withColumnRenamed("o_orderkey", "record")
    return validation.checks(h, t("inv_line_tax").withColumnRenamed("l_orderkey", "record"), AS_OF).where("code = 'DATE_MISSING'").select("record", "code")


@query("v29_refreshed", "select s_suppkey, case s_suppkey % 3 when 0 then 'supplier_gstin' when 1 then 'invoice_date' else 'invoice_no' end as field, round(case s_suppkey % 3 when 0 then case when s_suppkey % 2 = 0 then 0.95 else 0.6 end when 1 then 0.92 else 0.97 end, 6) as confidence, case when s_suppkey % 3 = 0 and s_suppkey % 2 = 1 then 'needs_review' else 'accepted' end as status from sup_ids")
def _(t, spark):
    f = t("sup_ids").select("s_suppkey", F.expr("case s_suppkey % 3 when 0 then 'supplier_gstin' when 1 then 'invoice_date' else 'invoice_no' end").alias("field"), F.expr("case when s_suppkey % 2 = 0 then gstin else concat(substr(gstin, 1, 14), '_') end").alias("value"), F.expr("case when s_suppkey % 3 = 0 and s_suppkey % 2 = 0 then 0.7 else 0.97 end").alias("confidence"), F.lit("accepted").alias("status"), F.expr("case when s_suppkey % 3 = 1 then 'DATE_AMBIGUOUS_DAY_FIRST' end").alias("note"))
    return validation.refreshed(f).select("s_suppkey", "field", F.round("confidence", 6).alias("confidence"), "status")


@query("v28_low_confidence", "select o_orderkey as record, status from (select o_orderkey, 'needs_review' as status from inv_headers where o_orderkey % 2 = 0) a")
def _(t, spark):
    h = t("inv_headers").withColumnRenamed("o_orderkey", "record").withColumn("total_confidence", F.when(F.col("record") % 2 == 0, 0.89).otherwise(0.97))
    return validation.validate(h, t("inv_line_tax").withColumnRenamed("l_orderkey", "record"), AS_OF).where("record % 2 = 0").select("record", "status")


@query("v31_review", "select k.job_id as record, 'POSSIBLE_DUPLICATE' as code, 'warning' as severity, false as passed from doc_keys k where k.job_id in (select a.job_id from doc_keys a join doc_keys b on a.sha256 = b.sha256 and a.job_id <> b.job_id)")
def _(t, spark):
    return validation.possible_duplicates(dedupe.exact_file(t("doc_keys"))).select("record", "code", "severity", "passed")


@query("j02_exact_classes", "select job_id, doc_index, first_job, members from (select job_id, doc_index, min(job_id) over (partition by sha256) as first_job, count(*) over (partition by sha256) as members from doc_keys) a where members > 1")
def _(t, spark):
    return dedupe.exact_classes(t("doc_keys")).select("job_id", "doc_index", "first_job", "members")


@query("so02_with_batch", "select job_id, doc_index, arg_min(o, f) as origin from (select job_id, doc_index, 'old' as o, 0 as f from doc_keys where job_id like 'job%' union all select job_id, doc_index, 'new', 1 from doc_keys where job_id like '%5') a group by 1, 2")
def _(t, spark):
    k = t("doc_keys").select("job_id", "doc_index")
    old, new = k.where("job_id like 'job%'").withColumn("origin", F.lit("old")), k.where("job_id like '%5'").withColumn("origin", F.lit("new"))
    return dedupe.with_batch(old, new)


@query("j21_segment_pages", "select conv_id, min(turn) over (partition by conv_id) as segment, turn as page, role from conversations")
def _(t, spark):
    c = t("conversations").withColumnRenamed("turn", "page")
    s = c.groupBy("conv_id").agg(F.min("page").alias("segment"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    return results.segment_pages(s, c, "conv_id").select("conv_id", "segment", "page", "role")


@query("k02_envelopes", """select o_custkey, '{"export_version":"1.0","exported_at":"2026-01-01T00:00:00Z","documents":[' || string_agg('{"o_orderkey":' || cast(o_orderkey as varchar) || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' order by o_orderkey) || ']}' as json from orders group by 1""")
def _(t, spark):
    return results.envelopes(t("orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey", "2026-01-01T00:00:00Z")


_NESTED = "transform(sequence(1, cast(o_orderkey % 3 + 1 as int)), i -> named_struct({}))"


@query("k08_checks", "select cast(o_orderkey as bigint) as record_id, 'CODE' || cast(i as varchar) as code, 'error' as severity, case when i % 2 = 0 then 'true' else 'false' end as passed from orders, (select unnest([1, 2, 3]) as i) s where i <= o_orderkey % 3 + 1")
def _(t, spark):
    x = t("orders").select("o_orderkey", F.expr(_NESTED.format("'code', concat('CODE', cast(i as string)), 'severity', 'error', 'passed', i % 2 = 0")).alias("checks"))
    return results.check_table(x, "o_orderkey").select("record_id", "code", "severity", "passed")


@query("k08_audit", "select cast(o_orderkey as bigint) as record_id, 'edit' as action, cast(i as varchar) as new, cast(null as varchar) as old from orders, (select unnest([1, 2, 3]) as i) s where i <= o_orderkey % 3 + 1")
def _(t, spark):
    x = t("orders").select("o_orderkey", F.expr(_NESTED.format("'action', 'edit', 'new', cast(i as string)")).alias("history"))
    return results.audit_table(x, "o_orderkey").select("record_id", "action", "new", "old")


@query("k09_job_results", """select id, n as n_documents, '{"job_id":"' || id || '","status":"' || status || '","documents":' || case when n = 0 then '[]' else '[{"doc_index":0}]' end || '}' as result from (select j.id, j.status, (select count(*) from doc_keys k where k.job_id = j.id and k.job_id like '%1') as n from jobs j) a""")
def _(t, spark):
    k = t("doc_keys").where("job_id like '%1'").select(F.col("job_id").alias("id"), "doc_index")
    return results.job_results(t("jobs").select("id", "status"), k, "id", "doc_index")


@query("k10_ocr_artifact", """select conv_id, '{"pages":[' || string_agg('{"page":' || cast(turn as varchar) || ',"tokens":[{"token_id":' || cast(turn as varchar) || ',"text":"' || role || '"}]}', ',' order by turn) || ']}' as json from (select distinct conv_id, turn, role from conversations) a group by 1""")
def _(t, spark):
    c = t("conversations").select("conv_id", F.col("turn").alias("page"), "role").distinct()
    return results.ocr_artifact(c.select("conv_id", "page"), c.select("conv_id", "page", F.col("page").alias("token_id"), F.col("role").alias("text")), "conv_id")


@query("o11_artifacts", "select o_custkey, string_agg(distinct 'p' || cast(o_orderkey % 4 as varchar) || '.png', ',' order by 'p' || cast(o_orderkey % 4 as varchar) || '.png') as names from orders group by 1")
def _(t, spark):
    return results.artifacts(t("orders").select("o_custkey", F.expr("concat('/a/b', cast(o_orderkey as string), '/p', cast(o_orderkey % 4 as string), '.png')").alias("path")), "o_custkey", "path")


@query("o03_queue", "select id, row_number() over (order by created_at, id) as place from jobs where status = 'queued'")
def _(t, spark):
    q = results.queue(t("jobs")).select("id", "created_at")
    return results.places(q, ["created_at", "id"]).select("id", "place")


@query("o04_events", "select event_id as id, event_type from events where user_id = 7")
def _(t, spark):
    e = t("events").select(F.col("event_id").alias("id"), "user_id", "event_type")
    return results.events_of(e, "user_id", 7).select("id", "event_type")


@query("o12_evidence", "select doc_id, length(substr('IRN ' || text, 1, 1200)) as n from documents where text is not null")
def _(t, spark):
    return t("documents").where("text is not null").select("doc_id", F.length(F.substring(F.concat(F.lit("IRN "), "text"), 1, extract.EVIDENCE)).alias("n"))


@query("o13_line_order", "select l_orderkey, line_idx, case when line_idx % 3 = 0 then 0 else line_idx end as place from inv_lines")
def _(t, spark):
    n = F.expr("case when line_idx % 3 = 0 then 'x' when line_idx % 3 = 1 then concat(' ', cast(line_idx as string)) else concat(cast(line_idx as string), '.0') end")
    return t("inv_lines").select("l_orderkey", "line_idx", results.line_order(n).alias("place"))


@query("o13_by_severity", "select o_orderkey, case when i % 2 = 0 then 'error' else 'warning' end as severity, count(*) as n, string_agg('C' || cast(i as varchar), ',' order by i) as codes from orders, (select unnest([1, 2, 3]) as i) s where i <= o_orderkey % 3 + 1 group by 1, 2")
def _(t, spark):
    x = t("orders").select("o_orderkey", F.explode(F.expr(_NESTED.format("'code', concat('C', cast(i as string)), 'severity', case when i % 2 = 0 then 'error' else 'warning' end"))).alias("c")).select("o_orderkey", "c.*")
    return results.checks_by_severity(x, "o_orderkey")


@query("m01_insert", "select id, status, cast(null as bigint) as n_events from jobs where id like '%1' union all select id, 'queued', 1 from jobs where id not like '%1'")
def _(t, spark):
    j = t("jobs").select("id", "status", "created_at")
    none = spark.createDataFrame([], "job_id string, ts timestamp, stage string, level string, message string")
    jobs, events = results.inserted(j.where("id like '%1'"), none, j.where("id not like '%1'").select("id", "created_at"))
    return jobs.join(events.groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("n_events")), "id", "left").select("id", "status", "n_events")


@query("v34_repaired", "select s_suppkey, 'gstin_checksum' as method, gstin as corrected, 0.85 as confidence_after from sup_ids where gstin like '%0%' and substr(gstin, 8, 1) = '0'")
def _(t, spark):
    ids_ = t("sup_ids").groupBy("s_suppkey").agg(F.max("gstin").alias("gstin"))  # a column, not the expression that makes it
    f = ids_.where("gstin like '%0%' and substr(gstin, 8, 1) = '0'").select("s_suppkey", F.lit("supplier_gstin").alias("field"), F.expr("concat(substr(gstin, 1, 7), 'O', substr(gstin, 9))").alias("value"), F.lit(0.97).alias("confidence"), F.lit("needs_review").alias("status"), F.array("gstin").alias("alternatives"))
    _, done, _ = repair.repaired_fields(f, "s_suppkey")
    return done.select("s_suppkey", "method", "corrected", "confidence_after")


@query("v35_total_from_words", "select o_orderkey, case when o_orderkey % 4 = 0 then total else total + 1 end as total, o_orderkey % 4 = 0 as corrected from inv_headers where total is not null")
def _(t, spark):
    h = t("inv_headers").where("total is not null").select("o_orderkey", (F.col("total") + 1).cast("decimal(18,2)").alias("total"), F.expr("cast(case when o_orderkey % 4 = 2 then total + 7 else total end as decimal(18,2))").alias("expected"), F.col("total").alias("words_amount"), F.expr("case when o_orderkey % 4 = 1 then 0.5 else 0.9 end").alias("certainty"), F.expr("case when o_orderkey % 4 = 3 then 'csv' else 'pdf_scanned' end").alias("input_kind"))
    return repair.total_from_words(h).select("o_orderkey", "total", "corrected")
