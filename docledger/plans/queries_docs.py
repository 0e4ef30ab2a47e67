"""Queries of document text and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.operators import extract, items, labels
from docledger.plans.catalog import query
from docledger.plans.views import VIEWS

#: An invoice as text, for each order: labels in the middle of lines, abbreviated and misread ones, two in a line, a buyer, a grid.
TEXT = """concat_ws(chr(10), 'L001| Tax Invoice Original', concat('L002| Tax Invoice   ', case o_orderkey % 4 when 0 then 'Invoice No: ' when 1 then 'Inv. No. ' when 2 then 'INVOICE NUMBER - ' else 'Invoce No ' end, invoice_no, case when o_orderkey % 4 < 3 then concat('  Invoice Date: ', coalesce(cast(invoice_date as string), '')) else '' end),
 case when o_orderkey % 3 = 0 then concat('Supplier GSTIN: ', coalesce(supplier_gstin, '')) else concat('sold by GST: ', coalesce(supplier_gstin, ''), '.') end,
 concat('Place of supply: ', coalesce(pos, ''), ' | Our Supplier Services | fromage 12'),
 case when o_orderkey % 4 = 0 then 'Reverse charge: No' when o_orderkey % 4 = 1 then 'Reverse charge: Yes' else 'Thank you, prices are inclusive of GST' end,
 case when o_orderkey % 5 = 0 then concat('Original Invoice Ref: OLD/', cast(o_orderkey as string)) else 'No reference' end,
 '| HSN Code | Description of goods | Qty | Taxable Amount |', concat('| ', cast(1000 + o_orderkey % 9000 as string), ' | Widget ', cast(o_orderkey as string), ' | 2 | ', coalesce(cast(taxable as string), '0.00'), ' |'),
 '| in a box | and | more |', '| Carried forward | 7 | 7 | 1.00 |', concat('| ', cast(2000 + o_orderkey % 8000 as string), ' | Bolt |  | 9.50 |'), '| Sub total or subtotal | 3 | 3 | 3 |', '| of steel | or | so |',
 concat('Taxable Value: ', coalesce(cast(taxable as string), '0.00')), concat('Total   Amount Rs. ', coalesce(cast(total as string), '0.00'), ' only 5.5'), concat('Grand Total:  ', coalesce(cast(total as string), '0.00')), 'Total pages 3')"""
#: The same for DuckDB, whose casts and functions agree.
VIEWS["inv_texts"] = f"select *, {TEXT} as text from inv_headers"
_BUYER = "concat('27AABCU9603R1Z', substr('ABCDEFGHJK', cast(o_orderkey % 10 + 1 as int), 1))"
VIEWS["inv_pairs"] = f"select o_orderkey, supplier_gstin, {_BUYER} as buyer, concat('Supplier Alpha: ', coalesce(supplier_gstin, 'none'), '; of a long street in the town of somewhere; ', case when o_orderkey % 2 = 0 then 'Bill to: ' else 'ref: ' end, substr({_BUYER}, 1, 5), ' ', substr({_BUYER}, 6), '.') as text from inv_headers"


def texts(t):
    return t("inv_texts")


@query("d01_lines", "select o_orderkey, count(*) as n, min(l) as first_line from (select o_orderkey, trim(regexp_replace(unnest(string_split(text, chr(10))), '^L[0-9]+[|] *', '')) as l from inv_texts) a where l <> '' group by 1")
def _(t, spark):
    return extract.lines(texts(t), "o_orderkey", "text").groupBy("o_orderkey").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


_LABELLED = """select o_orderkey, 'invoice_no' as field, invoice_no as value from inv_headers
 union all select o_orderkey, 'invoice_date', cast(invoice_date as varchar) from inv_headers where o_orderkey % 4 < 3 and invoice_date is not null
 union all select o_orderkey, 'supplier_gstin', supplier_gstin from inv_headers where o_orderkey % 3 = 0 and supplier_gstin is not null
 union all select o_orderkey, 'place_of_supply', coalesce(pos || ' | ', '') || 'Our' from inv_headers
 union all select o_orderkey, 'supplier_name', case when supplier_gstin is null then 'GSTIN' else 'GSTIN: ' || supplier_gstin end from inv_headers where o_orderkey % 3 = 0
 union all select o_orderkey, 'taxable_value', coalesce(cast(taxable as varchar), '0.00') from inv_headers
 union all select o_orderkey, 'total_amount', 'pages 3' from inv_headers"""


@query("d02_label_fields", _LABELLED)
def _(t, spark):
    x = labels.label_fields(extract.lines(texts(t), "o_orderkey", "text"), "o_orderkey")
    return x.where(F.col("field").isin("invoice_no", "invoice_date", "supplier_gstin", "place_of_supply", "taxable_value", "total_amount", "supplier_name", "buyer_name")).select("o_orderkey", "field", "value")


@query("j16_misread_labels", "select o_orderkey, 'invoice_no' as field, 'invoice no' as label, invoice_no as value from inv_headers where o_orderkey % 4 = 3 union all select o_orderkey, 'total_amount', 'grand total', 'x ' || cast(o_orderkey as varchar) from inv_headers where o_orderkey % 4 = 1")
def _(t, spark):
    line = F.expr("case o_orderkey % 4 when 3 then concat('Invoce No ', invoice_no) when 1 then concat('our Grand Totall x ', cast(o_orderkey as string)) else concat('Nothing here ', cast(o_orderkey as string)) end")
    x = t("inv_headers").select("o_orderkey", F.lit(0).alias("line_no"), line.alias("line"))
    return labels.anchored(x, "o_orderkey").select("o_orderkey", "field", "label", "value")


@query("f15_cut_at_next_label", "select o_orderkey, 'value ' || cast(o_orderkey as varchar) as value from inv_headers")
def _(t, spark):
    v = F.expr("concat('value ', cast(o_orderkey as string), case o_orderkey % 3 when 0 then '  Invoice  Date: 5' when 1 then ' | PO No. 7 Total 3' else '' end)")
    return t("inv_headers").select("o_orderkey", labels.cut_at_next_label(v).alias("value"))


@query("d03_gstin_roles", """select o_orderkey, coalesce(supplier_gstin, buyer) as gstin, 'supplier' as role from inv_pairs
 union all select o_orderkey, buyer, 'buyer' from inv_pairs where supplier_gstin is not null or o_orderkey % 2 = 0""")
def _(t, spark):
    return extract.gstin_roles(t("inv_pairs"), "o_orderkey", "text")


@query("d04_gstin_candidates", "select o_orderkey, 1 as pos, '27AABCU9603R1' || lpad(cast(o_orderkey % 100 as varchar), 2, '0') as candidate from inv_headers where o_orderkey % 3 <> 0")
def _(t, spark):
    x = t("inv_headers").select("o_orderkey", F.expr("case when o_orderkey % 3 = 0 then 'no. 27AABCU9603R1ZM' else concat('ab: 27AABCU-9603R1', lpad(cast(o_orderkey % 100 as string), 2, '0'), ', 1234 5678') end").alias("text"))
    return extract.gstin_candidates(x, "o_orderkey", "text")


@query("d05_first_date", "select o_orderkey, case when o_orderkey % 2 = 0 then '05/06/2024' else cast(cast(o_orderdate as date) as varchar) end as value from orders where o_orderkey % 3 < 2")
def _(t, spark):
    x = t("orders").select("o_orderkey", F.expr("concat_ws(chr(10), 'one', case when o_orderkey % 3 = 2 then 'none' when o_orderkey % 2 = 0 then 'of 05/06/2024 or 1-2-20' else concat('on ', cast(cast(o_orderdate as date) as string)) end, 'and 7/8/2021')").alias("text"))
    x = x.withColumn("text", F.when(F.col("o_orderkey") % 3 == 2, "none").otherwise(F.col("text")))
    return extract.first_date(extract.lines(x, "o_orderkey", "text"), "o_orderkey").select("o_orderkey", "value")


@query("d06_irn", "select o_orderkey, case when o_orderkey % 2 = 0 then sha256(cast(o_orderkey as varchar)) end as irn from orders")
def _(t, spark):
    h = F.sha2(F.col("o_orderkey").cast("string"), 256)
    x = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("IRN: "), h, F.lit(" end"))).otherwise(F.concat(F.lit("IRN: "), h, F.lit("0")))
    return t("orders").select("o_orderkey", extract.irn(x).alias("irn"))


@query("d07_totals", "select o_orderkey, 'total_amount' as field, coalesce(cast(total as varchar), '0.00') as value from inv_headers union all select o_orderkey, 'taxable_value', coalesce(cast(taxable as varchar), '0.00') from inv_headers")
def _(t, spark):
    return extract.totals(extract.lines(texts(t), "o_orderkey", "text"), "o_orderkey").select("o_orderkey", "field", "value")


@query("p18_hypotheses", f"""select o_orderkey, field, value, 0.8 as confidence from ({_LABELLED}) a where field not in ('total_amount', 'supplier_name')
 union all select o_orderkey, 'total_amount', coalesce(cast(total as varchar), '0.00'), 0.8 from inv_headers
 union all select o_orderkey, 'taxable_value', coalesce(cast(taxable as varchar), '0.00'), 0.8 from inv_headers
 union all select o_orderkey, 'supplier_gstin', supplier_gstin, 0.65 from inv_headers where o_orderkey % 3 <> 0 and supplier_gstin is not null
 union all select o_orderkey, 'purchase_order_no', 'OLD/' || cast(o_orderkey as varchar), 0.65 from inv_headers where o_orderkey % 5 = 0
 union all select o_orderkey, 'price_includes_tax', 'true', 0.65 from inv_headers where o_orderkey % 4 > 1""")
def _(t, spark):
    x = extract.hypotheses(texts(t), "o_orderkey", "text")
    return x.where(F.col("field").isin("invoice_no", "invoice_date", "supplier_gstin", "place_of_supply", "taxable_value", "total_amount", "purchase_order_no", "price_includes_tax")).where("confidence > 0.5 and not (field = 'invoice_date' and confidence < 0.7)").select("o_orderkey", "field", "value", "confidence")


@query("d08_document_type", "select o_orderkey, case o_orderkey % 4 when 0 then 'tax_invoice' when 1 then 'credit_note' when 2 then 'bill_of_supply' end as kind from orders")
def _(t, spark):
    x = F.expr("case o_orderkey % 4 when 0 then 'Tax Invoice' when 1 then 'CREDIT NOTE against tax invoice' when 2 then 'Bill of Supply' else 'Letter' end")
    return t("orders").select("o_orderkey", extract.document_type(x).alias("kind"))


@query("d09_flags", "select o_orderkey, case o_orderkey % 4 when 0 then 'false' when 1 then 'true' end as reverse_charge, o_orderkey % 4 > 1 as tax_inclusive, case when o_orderkey % 5 = 0 then 'OLD/' || cast(o_orderkey as varchar) end as original_invoice from inv_headers")
def _(t, spark):
    return texts(t).select("o_orderkey", extract.flags(F.col("text")).alias("f")).select("o_orderkey", "f.*")


@query("d10_grid_items", """select o_orderkey, 1 as item_no, cast(1000 + o_orderkey % 9000 as varchar) as hsn_sac, 'Widget ' || cast(o_orderkey as varchar) || ' in a box' as description, '2' as quantity, coalesce(cast(taxable as varchar), '0.00') as taxable_value, coalesce(cast(taxable as varchar), '0.00') as line_total from inv_headers
 union all select o_orderkey, 2, cast(2000 + o_orderkey % 8000 as varchar), 'Bolt of steel', null, '9.50', '9.50' from inv_headers""")
def _(t, spark):
    x = items.line_items(texts(t), "o_orderkey", "text")
    return x.select("o_orderkey", "item_no", "item.hsn_sac", "item.description", "item.quantity", "item.taxable_value", "item.line_total")


@query("d10_carried_rows", "select o_orderkey, 1 as n from inv_headers")
def _(t, spark):
    return items.carried_rows(items.grid(texts(t), "o_orderkey", "text"), "o_orderkey")


_LAYOUT = """concat_ws(chr(10), concat('L001| ', cast(o_orderkey % 99 + 1 as string), '  Bolt M8  ', cast(1000 + o_orderkey % 9000 as string), '  ', case when o_orderkey % 3 = 0 then '' else '4 ' end, '2.50 10.00'), 'no bar 1 x 1234 5 6', 'L002| x 1234',
 concat('L003| Taxable Value 1,000.00'), case when o_orderkey % 2 = 0 then 'L004| CGST 9% 90.00' else 'L004| nothing' end, case when o_orderkey % 2 = 0 then 'L005| SGST 90.00' else 'L005| nothing' end)"""


@query("d11_layout_items", """select o_orderkey, 1 as item_no, cast(o_orderkey % 99 + 1 as varchar) as line_no, 'Bolt M8' as description, cast(1000 + o_orderkey % 9000 as varchar) as hsn_sac, case when o_orderkey % 3 = 0 then '1' else '4' end as quantity, '2.50' as unit_price, '10.00' as taxable_value,
 case when o_orderkey % 2 = 0 then '18' end as tax_rate, case when o_orderkey % 2 = 0 then '11.80' end as line_total from orders""")
def _(t, spark):
    x = items.layout_items(t("orders").select("o_orderkey", F.expr(_LAYOUT).alias("text")), "o_orderkey", "text")
    return x.select("o_orderkey", "item_no", *[F.col(f"item.{f}").alias(f) for f in ("line_no", "description", "hsn_sac", "quantity", "unit_price", "taxable_value", "tax_rate", "line_total")])


@query("f64_header_tax_rate", "select o_orderkey, case when o_orderkey % 2 = 0 then 18.0 else 0.0 end as tax_rate from orders")
def _(t, spark):
    return items.header_tax_rate(t("orders").select("o_orderkey", F.expr(_LAYOUT).alias("text")), "o_orderkey", "text")


@query("so06_items_with_model", "select o_orderkey, case when o_orderkey % 2 = 0 then 'rules' else 'model' end as source from orders")
def _(t, spark):
    o = t("orders")
    return extract.items_with_model(o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("rules").alias("source")), o.select("o_orderkey", F.lit("model").alias("source")), "o_orderkey")


@query("p18_skipped", "select doc_id, length(trim(text)) = 0 as skipped from documents")
def _(t, spark):
    return t("documents").select("doc_id", extract.skipped(F.col("text")).alias("skipped"))


@query("p19_gate", "select o_orderkey, true as invoice from inv_headers")
def _(t, spark):
    return texts(t).select("o_orderkey", extract.gate(F.col("text")).alias("invoice"))


@query("p20_useful_line", "select l_orderkey, line_idx, (d <> '' and (h <> '' or q <> '')) or (h <> '' and q <> '') as useful from (select l_orderkey, line_idx, case when l_partkey % 2 = 0 then 'x' else '' end as d, case when l_partkey % 3 = 0 then hsn else '' end as h, case when l_partkey % 5 = 0 then '1' else '' end as q from inv_lines) a")
def _(t, spark):
    pick = lambda n, v: F.expr(f"case when l_partkey % {n} = 0 then {v} else '' end")
    none = F.lit(None).cast("string")
    item = F.struct(pick(2, "'x'").alias("description"), pick(3, "hsn").alias("hsn_sac"), pick(5, "'1'").alias("quantity"), none.alias("taxable_value"), none.alias("line_total"))
    return t("inv_lines").select("l_orderkey", "line_idx", items.useful(item).alias("useful"))


@query("s14_page_class", "select doc_id, case when c >= 50 and g < 0.10 and i < 0.85 then 'digital' when c < 20 or g >= 0.30 or (i >= 0.85 and c < 50) then 'scanned' else 'mixed' end as kind from (select doc_id, doc_id % 80 as c, (doc_id % 40) / 100.0 as g, (doc_id % 11) / 10.0 as i from documents) a")
def _(t, spark):
    d = F.col("doc_id")
    return t("documents").select("doc_id", extract.page_class(d % 80, d % 40 / 100, d % 11 / 10).alias("kind"))


@query("w06_segments", "select conv_id, turn, sum(new) over (partition by conv_id order by turn rows between unbounded preceding and current row) as segment from (select conv_id, turn, case when lag(turn) over (partition by conv_id order by turn) is null then 0 when no is not null and last_value(no ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) <> no then 1 else 0 end as new from (select conv_id, turn, case when turn % 2 = 0 then 'N' || cast((turn // 4) as varchar) end as no from conversations) a) b")
def _(t, spark):
    x = t("conversations").selectExpr("conv_id", "turn", "case when turn % 2 = 0 then concat('N', cast(turn div 4 as string)) end as no", "cast(null as string) as sup", "'page' as text")
    return extract.segments(x, "conv_id", "turn", "no", "sup", "text").select("conv_id", "turn", "segment")


@query("f58_clean_amount", "select o_orderkey, cast(cast(o_totalprice as decimal(18,2)) as varchar) as v from orders")
def _(t, spark):
    v = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    eu = F.concat(F.lit("₹ "), F.when(F.length(v) > 6, F.concat(F.expr("substr(cast(cast(o_totalprice as decimal(18,2)) as string), 1, length(cast(cast(o_totalprice as decimal(18,2)) as string)) - 6)"), F.lit("."), F.translate(F.right(v, F.lit(6)), ".", ","))).otherwise(F.translate(v, ".", ",")), F.lit("/-"))
    us = F.concat(F.lit("$"), F.when(F.length(v) > 6, F.concat(F.expr("substr(cast(cast(o_totalprice as decimal(18,2)) as string), 1, length(cast(cast(o_totalprice as decimal(18,2)) as string)) - 6)"), F.lit(" "), F.right(v, F.lit(6)))).otherwise(v))
    return t("orders").select("o_orderkey", extract.clean_amount(F.when(F.col("o_orderkey") % 2 == 0, eu).otherwise(us)).alias("v"))


@query("f73_upi", "select c_custkey, 'shop' || cast(c_custkey as varchar) || '@bank' as payee, cast(c_custkey as varchar) || '.50' as amount from customer")
def _(t, spark):
    u = F.expr("concat('upi://pay?pa=shop', cast(c_custkey as string), '%40bank&am=', cast(c_custkey as string), '.50')")
    return t("customer").select("c_custkey", extract.upi(u).alias("u")).select("c_custkey", "u.payee", "u.amount")


@query("d14_party_side", "select event_id, case when (event_id % 100) / 100.0 < 0.48 then 'seller' else 'client' end as side from events")
def _(t, spark):
    x = F.col("event_id") % 100 / 100
    return t("events").select("event_id", extract.party_side(x, x).alias("side"))
