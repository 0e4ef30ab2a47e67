"""Queries of the validation rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.functions import dims
from docledger.operators import grouping, validation
from docledger.plans.catalog import AS_OF, query
from docledger.plans.queries_functions import _PARSED, _SUM, CODES


def invoices(t):
    """Headers and lines in the shape that the rules take."""
    h = t("inv_headers").withColumnRenamed("o_orderkey", "record")
    lines = t("inv_line_tax").withColumnRenamed("l_orderkey", "record").withColumn("unit_price", (F.col("gross") / F.col("quantity")).cast("decimal(18,4)"))
    return h, lines


#: The SQL of the checks that the tables can show, for scores.
_PARTS: list[str] = []


def rule(name: str, codes: tuple[str, ...], sql: str):
    """One query for the checks of some codes: record, code, severity, passed, path. Spark drops the other rules' expressions where it can."""

    _PARTS.append(sql)

    @query(name, sql)
    def _(t, spark):
        h, lines = invoices(t)
        return validation.checks(h, lines, AS_OF).where(F.col("code").isin(*codes)).select("record", "code", "severity", "passed", "path")


H = "select o_orderkey as record, {code} as code, '{sev}' as severity, {passed} as passed, '{path}' as path from inv_headers where {cond}"
_G = "(supplier_gstin is not null)"
_CHK = f"(substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast((36 - ({_SUM}) % 36) % 36 as int) + 1, 1) = substr(supplier_gstin, 15, 1))"


def money(code: str, actual: str, expected: str, cond: str, path: str, key: str, table: str) -> str:
    gap = f"abs(cast({actual} as decimal(24,6)) - cast({expected} as decimal(24,6)))"
    return f"select {key} as record, case when {gap} <= 0.02 or {gap} > 1 then '{code}' else '{code}_ROUNDING' end as code, case when {gap} <= 0.02 or {gap} > 1 then 'error' else 'warning' end as severity, {gap} <= 1 as passed, {path} as path from {table} where ({cond}) and {gap} is not null"


rule("v01_gstin_format", ("GSTIN_FORMAT",), H.format(code="'GSTIN_FORMAT'", sev="error", passed=_PARSED, path="invoice.supplier_gstin", cond=_G))
rule("v02_state_code", ("GSTIN_STATE_CODE",), H.format(code="'GSTIN_STATE_CODE'", sev="error", passed=f"substr(supplier_gstin, 1, 2) in ({CODES})", path="invoice.supplier_gstin", cond=_PARSED))
rule("v03_gstin_checksum", ("GSTIN_CHECKSUM",), H.format(code="'GSTIN_CHECKSUM'", sev="error", passed=_CHK, path="invoice.supplier_gstin", cond=_G))
rule("v04_supplier_missing", ("SUPPLIER_GSTIN_MISSING",), H.format(code="'SUPPLIER_GSTIN_MISSING'", sev="error", passed="false", path="invoice.supplier_gstin", cond="supplier_gstin is null and document_type <> 'bill_of_supply'"))
rule("v05_buyer_missing", ("BUYER_GSTIN_MISSING",), H.format(code="'BUYER_GSTIN_MISSING'", sev="info", passed="true", path="invoice.buyer_gstin", cond="true"))
rule("v06_required", ("INVOICE_NUMBER_MISSING", "DATE_MISSING"), H.format(code="'DATE_MISSING'", sev="error", passed="false", path="invoice.invoice_date", cond="invoice_date is null"))
rule("v08_rule46", ("INVOICE_NUMBER_RULE46",), H.format(code="'INVOICE_NUMBER_RULE46'", sev="warning", passed="true", path="invoice.invoice_no", cond="length(invoice_no) > 16"))
rule("v10_dates", ("DATE_BEFORE_GST", "DATE_IN_FUTURE", "DATE_VERY_OLD"), " union all ".join(H.format(code=f"'{c}'", sev="warning", passed="true", path="invoice.invoice_date", cond=k) for c, k in (("DATE_BEFORE_GST", "invoice_date < date '2017-07-01'"), ("DATE_VERY_OLD", f"invoice_date < date '{AS_OF}' - interval '96' month"))))
rule("v12_pos_missing", ("POS_MISSING",), H.format(code="'POS_MISSING'", sev="info", passed="true", path="invoice.place_of_supply", cond="pos is null"))
_TAX = "(coalesce(cgst, 0) + coalesce(sgst, 0) + coalesce(igst, 0))"
rule("v13_grand_total", ("GRAND_TOTAL", "GRAND_TOTAL_ROUNDING"), money("GRAND_TOTAL", "total", f"(taxable + {_TAX})", "true", "'invoice.total_amount'", "o_orderkey", "inv_headers"))
rule("v14_total_tax", ("TOTAL_TAX", "TOTAL_TAX_ROUNDING"), money("TOTAL_TAX", "total_tax", _TAX, "taxable is not null", "'invoice.total_tax'", "o_orderkey", "inv_headers"))
rule("v17_tax_type", ("TAX_TYPE_MISMATCH",), H.format(code="'TAX_TYPE_MISMATCH'", sev="error", passed="not case when pos = substr(supplier_gstin, 1, 2) then coalesce(igst, 0) > 0.02 else coalesce(cgst, 0) > 0.02 or coalesce(sgst, 0) > 0.02 end", path="invoice.place_of_supply", cond="pos is not null and supplier_gstin is not null and greatest(coalesce(cgst, 0), coalesce(sgst, 0), coalesce(igst, 0)) > 0"))
rule("v18_bill_of_supply", ("TAX_ON_BILL_OF_SUPPLY",), H.format(code="'TAX_ON_BILL_OF_SUPPLY'", sev="error", passed="not (coalesce(cgst, 0) > 0.02 or coalesce(sgst, 0) > 0.02 or coalesce(igst, 0) > 0.02 or coalesce(total_tax, 0) > 0.02)", path="invoice.igst", cond="document_type = 'bill_of_supply'"))
rule("v19_reverse_charge", ("REVERSE_CHARGE",), H.format(code="'REVERSE_CHARGE'", sev="info", passed="true", path="invoice.reverse_charge", cond="reverse_charge = 'true'"))
_PATH = "'line_items[' || cast(line_idx - 1 as varchar) || '].{}'"
RATES = ", ".join(dims.RATES)
rule("v20_rate_unknown", ("RATE_UNKNOWN",), f"select l_orderkey as record, 'RATE_UNKNOWN' as code, 'error' as severity, false as passed, {_PATH.format('tax_rate')} as path from inv_line_tax where rate not in ({RATES})")
_LH = "(select l.*, cast(gross / quantity as decimal(18,4)) as unit_price, h.pos as h_pos, h.supplier_gstin, h.invoice_date from inv_line_tax l join inv_headers h on h.o_orderkey = l.l_orderkey) x"
rule("v22_line_taxable", ("LINE_TAXABLE", "LINE_TAXABLE_ROUNDING"), money("LINE_TAXABLE", "taxable", "(cast(quantity * unit_price as decimal(24,6)) - discount)", "true", _PATH.format("taxable_value"), "l_orderkey", _LH))


@query("v23_negative", f"select l_orderkey as record, 'NEGATIVE_AMOUNT' as code, {_PATH.format('igst')} as path from inv_line_tax where igst > 0 and l_partkey % 30 = 0")
def _(t, spark):
    h, lines = invoices(t)
    lines = lines.withColumn("igst", F.when(F.col("l_partkey") % 30 == 0, -F.col("igst")).otherwise(F.col("igst")))
    return validation.checks(h, lines, AS_OF).where("code = 'NEGATIVE_AMOUNT'").select("record", "code", "path")


_INTRA = "(coalesce(h_pos, '') = coalesce(substr(supplier_gstin, 1, 2), '') and coalesce(h_pos, '') <> '96')"
_HALF, _WHOLE = "round(taxable * rate * 0.005, 2)", "round(taxable * rate * 0.01, 2)"
rule(
    "v24_line_tax", tuple(f"LINE_TAX_{x}{r}" for x in ("CGST", "SGST", "IGST") for r in ("", "_ROUNDING")),
    " union all ".join(money(f"LINE_TAX_{x.upper()}", f"coalesce({x}, 0)", f"case when {'not ' if x == 'igst' else ''}{_INTRA} then {_WHOLE if x == 'igst' else _HALF} else 0 end", f"{x} is not null or case when {'not ' if x == 'igst' else ''}{_INTRA} then {_WHOLE if x == 'igst' else _HALF} else 0 end > 0.02", _PATH.format(x), "l_orderkey", _LH) for x in ("cgst", "sgst", "igst")),
)
rule("v25_line_total", ("LINE_TOTAL", "LINE_TOTAL_ROUNDING"), money("LINE_TOTAL", "line_total", "(taxable + coalesce(cgst, 0) + coalesce(sgst, 0) + coalesce(igst, 0))", "true", _PATH.format("line_total"), "l_orderkey", _LH))
rule("v26_sum_taxable", ("SUM_TAXABLE", "SUM_TAXABLE_ROUNDING"), money("SUM_TAXABLE", "s", "taxable", "true", "'invoice.taxable_value'", "o_orderkey", "(select h.o_orderkey, h.taxable, sum(l.taxable) as s from inv_headers h join inv_line_tax l on l.l_orderkey = h.o_orderkey group by 1, 2) q"))
rule("v27_no_lines", ("LINE_ITEMS_MISSING",), H.format(code="'LINE_ITEMS_MISSING'", sev="warning", passed="true", path="line_items", cond="n_lines = 0"))


@query("v21_rate_regime", f"select l_orderkey as record, line_idx, rate2 as rate, (rate2 in (12, 28) and d >= date '{dims.REGIME_DATE}') or (rate2 = 40 and d < date '{dims.REGIME_DATE}') as off from (select l_orderkey, line_idx, case l_partkey % 4 when 0 then 12 when 1 then 28 when 2 then 40 else 18 end as rate2, cast(ship_date + interval '27' year as date) as d from inv_lines) a")
def _(t, spark):
    lines = t("inv_lines").select(F.concat_ws("-", "l_orderkey", "line_idx").alias("record"), "l_orderkey", "line_idx", F.lit(1).alias("one"), F.expr("cast(case l_partkey % 4 when 0 then 12 when 1 then 28 when 2 then 40 else 18 end as decimal(9,4))").alias("rate"), F.expr("cast(ship_date + interval '27' year as date)").alias("h_date"))
    known = F.col("rate").isin(*[F.lit(r).cast("decimal(9,4)") for r in dims.RATES])
    off = validation.line_checks()[1]
    shaped = lines.withColumns({c: F.lit(None).cast(v) for c, v in validation.LINE_TYPES.items() if c not in ("line_idx", "rate")} | {"h_pos": F.lit(None).cast("string"), "h_supplier": F.lit(None).cast("string"), "h_inclusive": F.lit(None).cast("string")})
    return shaped.where(known).select(F.col("l_orderkey").alias("record"), "line_idx", F.col("rate").cast("long").alias("rate"), off.isNotNull().alias("off"))


_ALL = " union all ".join(f"select record, code, severity, passed from ({p}) u{i}" for i, p in enumerate(_PARTS))
_W = "case severity when 'error' then 3 when 'warning' then 1 else 0 end"
_SCORED = f"select record, case when sum({_W}) = 0 then 1.0 else 1.0 - sum(case when passed then 0 else {_W} end) * 1.0 / sum({_W}) end as score, count(*) filter (severity = 'error' and not passed) as unresolved, count(*) filter (severity = 'warning') as warnings from ({_ALL}) c group by record"
_BILL = "document_type = 'bill_of_supply'"
_GIVEN = f"(2 + case when invoice_date is null then 0 else 2 end + case when taxable is null then 0 else 2 end + case when total is null then 0 else 3 end + case when {_BILL} or supplier_gstin is null then 0 else 2 end + n_lines)"
_WEIGHT = f"(9 + case when {_BILL} then 0 else 2 end + greatest(n_lines, 1))"
_DECIDED = f"""select h.o_orderkey as record, s.score, {_GIVEN} * 0.97 / {_WEIGHT} * s.score as overall,
 case when {_GIVEN} < {_WEIGHT} or s.unresolved > 0 or {_GIVEN} * 0.97 / {_WEIGHT} * s.score < 0.70 then 'needs_review' when s.warnings > 0 then 'valid_with_warnings' else 'valid' end as status from inv_headers h join ({_SCORED}) s on s.record = h.o_orderkey"""


@query("a07_score", f"select record, round(score, 9) as score, unresolved, warnings from ({_SCORED}) s")
def _(t, spark):
    h, lines = invoices(t)
    return validation.summary(validation.checks(h, lines, AS_OF)).select("record", F.round("score", 9).alias("score"), "unresolved", "warnings")


@query("a08_weighted_confidence", f"select o_orderkey as record, round({_GIVEN} * 0.97 / {_WEIGHT}, 9) as confidence, {_GIVEN} < {_WEIGHT} as missing from inv_headers")
def _(t, spark):
    return validation.judged(*invoices(t), AS_OF).select("record", F.round("confidence", 9).alias("confidence"), "missing")


@query("v28_validate", f"select record, round(score, 9) as score, round(overall, 9) as overall, status, status <> 'valid' as review_required from ({_DECIDED}) d")
def _(t, spark):
    h, lines = invoices(t)
    out = validation.validate(h, lines, AS_OF)
    return out.select("record", F.round("score", 9).alias("score"), F.round("overall", 9).alias("overall"), "status", "review_required")


@query("a09_status", f"select status, count(*) as n, round(avg(score), 6) as mean_score from ({_DECIDED}) d group by status")
def _(t, spark):
    h, lines = invoices(t)
    return validation.validate(h, lines, AS_OF).groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


_FITS = f"abs(total - (taxable + {_TAX})) <= 1"


@query("v15_words", f"select o_orderkey as record, case when {_FITS} then 'WORDS_MISMATCH' else 'WORDS_TOTAL' end as code, case when {_FITS} then 'warning' else 'error' end as severity, {_FITS} as passed from inv_headers where total is not null and o_orderkey % 4 = 0 union all select o_orderkey, 'WORDS_UNPARSEABLE', 'warning', true from inv_headers where total is not null and o_orderkey % 4 = 1")
def _(t, spark):
    from docledger.functions import words

    said = words.words_of(F.expr("cast(total + case when o_orderkey % 4 = 0 then 1 else 0 end as decimal(18,2))"))
    x = t("inv_headers").where("total is not null").withColumn("words_text", F.when(F.col("o_orderkey") % 4 == 1, "no such words at all").otherwise(said))
    x = x.withColumn("words_amount", words.amount_of(F.col("words_text"))["amount"]).withColumnRenamed("o_orderkey", "record")
    return validation.checks(x, t("inv_line_tax").withColumnRenamed("l_orderkey", "record"), AS_OF).where("code like 'WORDS%'").select("record", "code", "severity", "passed")


@query("v29_field_status", "select doc_id, source, case when doc_id % 9 = 0 then 'human_verified' when doc_id % 10 = 0 then 'missing' when confidence >= 0.90 then 'accepted' else 'needs_review' end as status from hypotheses")
def _(t, spark):
    d = F.col("doc_id")
    s = validation.field_status(F.col("confidence").cast("double"), F.when(d % 10 != 0, F.col("value")), F.when(d % 9 == 0, "human_verified").otherwise("missing"))
    return t("hypotheses").select("doc_id", "source", s.alias("status"))


@query("v30_declared", """select record, field, cast(expected as double) as expected, cast(actual as double) as actual, cast(abs(actual - expected) as double) as difference from (
 select o_orderkey as record, 'taxable_value' as field, s as expected, taxable as actual, 0.01 as tol from inv_headers h join (select l_orderkey, sum(taxable) as s from inv_line_tax group by 1) x on x.l_orderkey = h.o_orderkey
 union all select o_orderkey, 'total_amount', s, total, 0.02 from inv_headers h join (select l_orderkey, sum(line_total) as s from inv_line_tax group by 1) x on x.l_orderkey = h.o_orderkey) y where abs(actual - expected) > tol""")
def _(t, spark):
    d = t("inv_headers").select(F.col("o_orderkey").alias("record"), F.col("taxable").alias("d_taxable"), F.col("total").alias("d_total"))
    return grouping.declared_mismatch(d, t("inv_line_tax").withColumnRenamed("l_orderkey", "record"), "record")


@query("v31_possible_duplicate", "select a.job_id, count(*) as n from doc_keys a join doc_keys b on a.supplier_gstin = b.supplier_gstin and a.invoice_no_norm = b.invoice_no_norm and a.job_id <> b.job_id and (a.invoice_date = b.invoice_date or a.total_amount = b.total_amount) group by 1")
def _(t, spark):
    from docledger.operators import dedupe

    return dedupe.business_key(t("doc_keys")).groupBy(F.col("a_job_id").alias("job_id")).agg(F.count("*").alias("n"))
