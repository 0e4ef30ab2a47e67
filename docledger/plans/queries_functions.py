"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.functions import confidence, dates, dims, ids, money, similarity, text, words
from docledger.plans import oracle_parts
from docledger.plans.catalog import AS_OF, query
from docledger.plans.views import check_sum_sql

S = "cast({} as varchar)"
STATE_CASE = "case " + " ".join(f"when k in ({', '.join(repr(x) for x, v in dims.state_keys().items() if v == value)}) then '{value}'" for value in dict.fromkeys(dims.state_keys().values())) + " end"
UNIT_CASE = "case " + " ".join(f"when k = '{k}' then '{v}'" for k, v in dims.UNIT_NAMES.items()) + " else upper(k) end"
CODES, CHAPTERS = ", ".join(map(repr, dims.STATE_CODES)), ", ".join(map(repr, dims.HSN_CHAPTERS))


@query("f01_clean_text", "select doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(text), '[\u200b\u200c\u200d\ufeff]', '', 'g'), '[\\s\u00a0]+', ' ', 'g')) as cleaned from documents")
def _(t, spark):
    return t("documents").select("doc_id", text.clean_text(F.col("text"), unicode_form=True).alias("cleaned"))


@query("f03_lookalikes", "select p_partkey, translate(p_name, 'OoIl|SsBb', '001115588') as digits, translate(p_name, 'OoIl|SsBb', '001115588') <> p_name as changed from part")
def _(t, spark):
    x = text.lookalikes(F.col("p_name"))
    return t("part").select("p_partkey", x.alias("digits"), (x != F.col("p_name")).alias("changed"))


@query("f05_label", "select p_partkey, trim(regexp_replace(lower(p_name || ' #' || p_brand || '-%'), '[^a-z0-9%]+', ' ', 'g')) as label, trim(regexp_replace(lower(p_name || ' #' || p_brand || '-%'), '[^a-z0-9]+', ' ', 'g')) as plain from part")
def _(t, spark):
    x = F.concat("p_name", F.lit(" #"), "p_brand", F.lit("-%"))
    return t("part").select("p_partkey", text.label(x).alias("label"), text.plain_label(x).alias("plain"))


@query("f07_compact", "select o_orderkey, regexp_replace(upper(invoice_no || '/a.b'), '[^A-Z0-9]', '', 'g') as k from inv_headers")
def _(t, spark):
    return t("inv_headers").select("o_orderkey", text.compact(F.concat("invoice_no", F.lit("/a.b"))).alias("k"))


@query("f08_indel_ratio", f"select p_partkey, r.ratio from part join {oracle_parts.ratio('select lower(p_name) as x, lower(p_type) as y from part', 'x', 'y')} r on r.a = lower(p_name) and r.b = lower(p_type)")
def _(t, spark):
    return t("part").select("p_partkey", similarity.ratio(F.lower("p_name"), F.lower("p_type")).alias("ratio"))


_WORDS = "select p_partkey, list_sort(list_distinct(string_split(lower(p_name), ' '))) as x, list_sort(list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))) as y0, case when p_partkey % 3 = 0 then list_sort(list_distinct(string_split(lower(p_type), ' '))) when p_partkey % 3 = 1 then list_sort(list_distinct(string_split('extra ' || substr(lower(p_name), 1, 9) || ' word', ' '))) else list_sort(list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))) end as y from part"
_SETS = f"select p_partkey, c <> '' as common, trim(c || ' ' || array_to_string(list_filter(x, lambda w: not list_contains(y, w)), ' ')) as l, trim(c || ' ' || array_to_string(list_filter(y, lambda w: not list_contains(x, w)), ' ')) as r, c, len(list_filter(x, lambda w: not list_contains(y, w))) = 0 or len(list_filter(y, lambda w: not list_contains(x, w))) = 0 as inside from (select *, array_to_string(list_filter(x, lambda w: list_contains(y, w)), ' ') as c from ({_WORDS}) a) b"
_THREE = f"select l as a, r as b from ({_SETS}) s union select c, l from ({_SETS}) s union select c, r from ({_SETS}) s"


@query("f09_token_set", f"select p_partkey, case when common and inside then 100.0 when common then greatest(p.ratio, q.ratio, v.ratio) else p.ratio end as ratio from ({_SETS}) s join {oracle_parts.ratio(_THREE, 'a', 'b')} p on p.a = s.l and p.b = s.r join {oracle_parts.ratio(_THREE, 'a', 'b')} q on q.a = s.c and q.b = s.l join {oracle_parts.ratio(_THREE, 'a', 'b')} v on v.a = s.c and v.b = s.r")
def _(t, spark):
    other = F.expr("case p_partkey % 3 when 0 then lower(p_type) when 1 then concat('extra ', substr(lower(p_name), 1, 9), ' word') else lower(concat(p_name, ' ', p_type)) end")
    return t("part").select("p_partkey", similarity.token_set_ratio(F.lower("p_name"), other).alias("ratio"))


@query("f11_bounded_distance", "select p_partkey, levenshtein(p_brand, 'Brand#12') as d from part where levenshtein(p_brand, 'Brand#12') <= 2")
def _(t, spark):
    d = F.levenshtein(F.col("p_brand"), F.lit("Brand#12"), 2)
    return t("part").select("p_partkey", d.alias("d")).where("d >= 0")


@query("f12_semantic_role", r"""select l_orderkey, line_idx, v, case when v = '' then 'empty' when regexp_matches(v, '\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b') then 'date'
 when regexp_matches(v, '(?i)^((?:[₹$€£]|INR|Rs\.?)\s*-?\d[\d,]*(?:\.\d{1,2})?|-?\d[\d,]*(?:\.\d{1,2})?\s*(?:/-)?$)') then 'amount' when regexp_matches(v, '(?i)^\d+(?:\.\d+)?\s*(?:nos|pcs|qty|units?|kgs?)?$') then 'quantity' when regexp_matches(lower(v), 'invoice|bill|tax|total|date') then 'label'
 when regexp_matches(v, '(?i)^[A-Z0-9][A-Z0-9/\-_]{3,24}$') and regexp_matches(v, '\d') then 'identifier' else 'text' end as role
 from (select l_orderkey, line_idx, case line_idx % 5 when 0 then amount_cell when 1 then date_cell when 2 then hsn || ' pcs' when 3 then 'REF-' || hsn else description_cell end as v from raw_rows) r""")
def _(t, spark):
    v = F.expr("case line_idx % 5 when 0 then amount_cell when 1 then date_cell when 2 then concat(hsn, ' pcs') when 3 then concat('REF-', hsn) else description_cell end")
    return t("raw_rows").select("l_orderkey", "line_idx", v.alias("v"), text.semantic_role(v).alias("role"))


@query("f20_gstin_normal", "select s_suppkey, upper(regexp_replace(lower(substr(gstin, 1, 2) || ' ' || substr(gstin, 3, 8) || '-' || substr(gstin, 11)), '[\\s-]+', '', 'g')) as g from sup_ids")
def _(t, spark):
    g = F.expr("lower(concat(substr(gstin, 1, 2), ' ', substr(gstin, 3, 8), '-', substr(gstin, 11)))")
    return t("sup_ids").select("s_suppkey", ids.gstin_normal(g).alias("g"))


@query("f21_gstin_check", "select s_suppkey, substr(gstin, 15, 1) as c from sup_ids")
def _(t, spark):
    return t("sup_ids").select("s_suppkey", ids.gstin_check(F.col("g14")).alias("c"))


_PARSED = "regexp_full_match(supplier_gstin, '[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]')"


@query("f22_gstin_parse", f"select o_orderkey, case when {_PARSED} then substr(supplier_gstin, 1, 2) end as state_code, case when {_PARSED} then substr(supplier_gstin, 3, 10) end as pan, case when {_PARSED} then substr(supplier_gstin, 13, 1) end as entity, case when {_PARSED} then substr(supplier_gstin, 15, 1) end as check_char from inv_parties")
def _(t, spark):
    return t("inv_parties").select("o_orderkey", ids.gstin_parts(F.col("supplier_gstin")).alias("p")).select("o_orderkey", "p.*")


_SUM = check_sum_sql("supplier_gstin")
_VALID = f"coalesce({_PARSED} and substr(supplier_gstin, 1, 2) in ({CODES}) and substr(supplier_gstin, 1, 2) <> '96' and substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast((36 - ({_SUM}) % 36) % 36 as int) + 1, 1) = substr(supplier_gstin, 15, 1), false)"


@query("f23_gstin_valid", f"select o_orderkey, {_VALID} as valid from inv_parties")
def _(t, spark):
    return t("inv_parties").select("o_orderkey", ids.gstin_valid(F.col("supplier_gstin")).alias("valid"))


@query("f24_make_gstin", "select s_suppkey, gstin as made from sup_ids")
def _(t, spark):
    return t("sup_ids").select("s_suppkey", ids.make_gstin(F.substring("g14", 1, 2), F.substring("g14", 3, 10), F.lit("1")).alias("made"))


@query("f25_pan", "select s_suppkey, substr(g14, 3, 10) as pan, case when substr(g14, 6, 1) not in ('P','C','H','F','A','T','B','L','J','G') then 'PAN_ENTITY_TYPE' end as note from sup_ids")
def _(t, spark):
    p = F.lower(F.substring("g14", 3, 10))
    return t("sup_ids").select("s_suppkey", ids.pan(p).alias("pan"), ids.pan_note(p).alias("note"))


@query("f26_invoice_no", "select o_orderkey, invoice_no, case when length(invoice_no) > 16 then 'INVOICE_NUMBER_RULE46' end as note from inv_headers")
def _(t, spark):
    x = F.concat(F.lit(" "), "invoice_no", F.lit(" "))
    return t("inv_headers").select("o_orderkey", ids.invoice_no(x).alias("invoice_no"), ids.invoice_no_note(x).alias("note"))


@query("f27_hsn", f"select l_orderkey, line_idx, hsn, case when substr(hsn, 1, 2) not in ({CHAPTERS}) then 'HSN_FORMAT' end as note from inv_lines")
def _(t, spark):
    x = F.concat(F.substring("hsn", 1, 2), F.lit("."), F.substring("hsn", 3, 2))
    return t("inv_lines").select("l_orderkey", "line_idx", ids.hsn(x).alias("hsn"), ids.hsn_note(x).alias("note"))


@query("f28_hsn_padded", "select p_partkey, case when length(cast(p_partkey as string)) < 4 then lpad(cast(p_partkey as string), 4, '0') when length(cast(p_partkey as string)) = 5 then lpad(cast(p_partkey as string), 6, '0') else cast(p_partkey as string) end as hsn from part")
def _(t, spark):
    return t("part").select("p_partkey", ids.hsn_padded(F.col("p_partkey").cast("string")).alias("hsn"))


@query("f29_pincode", "select o_custkey, lpad(cast(o_custkey % 1000000 as string), 6, '1') as pin, regexp_full_match(lpad(cast(o_custkey % 1000000 as string), 6, '1'), '[1-9][0-9]{5}') as ok from orders")
def _(t, spark):
    x = F.translate(F.lpad((F.col("o_custkey") % 1000000).cast("string"), 6, "1"), "1", "l")
    return t("orders").select("o_custkey", ids.pincode(x).alias("pin"), ids.pincode_ok(x).alias("ok"))


@query("f30_phone", "select c_custkey, case when c_custkey % 10 >= 6 then cast(c_custkey % 10 as string) || lpad(cast(c_custkey as string), 9, '0') else '+91 ' || cast(c_custkey % 10 as string) || lpad(cast(c_custkey as string), 9, '0') end as phone from customer")
def _(t, spark):
    return t("customer").select("c_custkey", ids.phone(F.expr("concat('+91 ', cast(c_custkey % 10 as string), lpad(cast(c_custkey as string), 9, '0'))")).alias("phone"))


@query("f31_ifsc", "select s_suppkey, 'BANK0' || lpad(cast(s_suppkey as string), 6, '0') as ifsc, s_suppkey % 3 <> 0 as ok from supplier where s_suppkey % 3 <> 0 union all select s_suppkey, 'BAN10' || lpad(cast(s_suppkey as string), 6, '0'), false from supplier where s_suppkey % 3 = 0")
def _(t, spark):
    x = F.expr("concat(case when s_suppkey % 3 = 0 then 'ban1 0' else 'bank 0' end, lpad(cast(s_suppkey as string), 6, '0'))")
    return t("supplier").select("s_suppkey", ids.ifsc(x).alias("ifsc"), ids.ifsc_ok(x).alias("ok"))


@query("f32_state", f"select x as given, coalesce({STATE_CASE}, x) as state from (select x, regexp_replace(upper(x), '[^A-Z0-9]', '', 'g') as k from (select lpad(cast(n_nationkey as string), 2, '0') as x from nation union all select n_name from nation union all select 'tamil nadu' union all select 'j&k') a) b")
def _(t, spark):
    given = t("nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("x")).union(t("nation").select("n_name")).union(spark.sql("select * from values ('tamil nadu'), ('j&k') as v(x)"))
    return given.select(F.col("x").alias("given"), ids.state(F.col("x")).alias("state"))


@query("f33_unit", f"select p_partkey, {UNIT_CASE} as unit from (select p_partkey, case p_size % 6 when 0 then 'pcs' when 1 then 'kg' when 2 then 'dozen' when 3 then 'sqft' when 4 then 'bag' else 'foo' end as k from part) a")
def _(t, spark):
    u = F.expr("case p_size % 6 when 0 then 'Pcs.' when 1 then ' KG' when 2 then 'dozen' when 3 then 'sq.ft' when 4 then 'bag' else 'foo' end")
    return t("part").select("p_partkey", ids.unit(u).alias("unit"))


@query("f34_patterns", r"select doc_id, len(regexp_extract_all(text, '\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b')) as emails, len(regexp_extract_all(text, '\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})\b')) as dates, len(regexp_extract_all(text, '(?:\+91[\s-]?)?[6-9]\d{9}\b')) as phones, len(regexp_extract_all(text, '\b[1-9]\d{5}\b')) as pincodes from documents where text is not null")
def _(t, spark):
    n = lambda k: F.size(ids.found(F.col("text"), k)).cast("long")
    return t("documents").where("text is not null").select("doc_id", n("email").alias("emails"), n("date").alias("dates"), n("phone").alias("phones"), n("pincode").alias("pincodes"))


@query("f34_amounts", "select o_orderkey, 'Rs. ' || cast(o_orderkey as varchar) || '.50,1,200/-,$ 5,-7.25' as found from orders")
def _(t, spark):
    text = F.concat(F.lit("a Rs. "), F.col("o_orderkey").cast("string"), F.lit(".50 b 1,200/- c $ 5 X7 -7.25"))
    return t("orders").select("o_orderkey", F.array_join(ids.found(text, "amount"), ",").alias("found"))


@query("f40_parse_date", "select l_orderkey, line_idx, cast(ship_date as varchar) as d, extract(day from ship_date) <= 12 and extract(day from ship_date) <> extract(month from ship_date) as ambiguous from raw_rows")
def _(t, spark):
    return t("raw_rows").select("l_orderkey", "line_idx", dates.parse_date(F.col("date_cell")).alias("d"), dates.is_ambiguous(F.col("date_cell")).alias("ambiguous"))


@query("f41_date_notes", f"select o_orderkey, case when invoice_date is null then 'DATE_MISSING' else concat_ws(',', case when invoice_date < date '2017-07-01' then 'DATE_BEFORE_GST' end, case when invoice_date > date '{AS_OF}' + interval '1' day then 'DATE_IN_FUTURE' end, case when invoice_date < date '{AS_OF}' - interval '96' month then 'DATE_VERY_OLD' end) end as notes from inv_headers")
def _(t, spark):
    notes = dates.date_notes(F.col("invoice_date").cast("string"), F.lit(AS_OF).cast("date"))
    return t("inv_headers").select("o_orderkey", F.array_join(notes, ",").alias("notes"))


@query("f42_fiscal_year", "select o_orderkey, case when month(o_orderdate) >= 4 then cast(year(o_orderdate) as varchar) || '-' || lpad(cast((year(o_orderdate) + 1) % 100 as varchar), 2, '0') else cast(year(o_orderdate) - 1 as varchar) || '-' || lpad(cast(year(o_orderdate) % 100 as varchar), 2, '0') end as fy from orders")
def _(t, spark):
    return t("orders").select("o_orderkey", dates.fiscal_year(F.col("o_orderdate").cast("date")).alias("fy"))


@query("f43_cell_date", "select l_orderkey, line_idx, cast(ship_date as varchar) as d from raw_rows")
def _(t, spark):
    return t("raw_rows").select("l_orderkey", "line_idx", dates.cell_date(F.col("date_cell")).alias("d"))


@query("f44_key_date", "select o_orderkey, cast(cast(o_orderdate as date) as varchar) as d from orders")
def _(t, spark):
    return t("orders").select("o_orderkey", dates.key_date(F.col("o_orderdate").cast("string")).alias("d"))


@query("f50_parse_money", "select l_orderkey, line_idx, cast(amount as double) as amount, case when amount is null then 'MONEY_INVALID_GROUPING' when l_partkey % 5 = 3 then 'DASH_DECIMAL' else '' end as amount_notes from raw_rows")
def _(t, spark):
    return money.with_money(t("raw_rows").select("l_orderkey", "line_idx", "amount_cell"), "amount_cell", "amount").drop("amount_cell")


@query("f51_parse_rate", "select o_orderkey, cast(case when r > 100 then null when g <= 0.15 then n else r end as double) as rate from (select o_orderkey, r, unnest(list_sort(list_transform([0,0.1,0.25,1,1.5,3,5,7.5,12,18,28,40], lambda k: {'g': abs(cast(k as decimal(12,4)) - r), 'n': cast(k as decimal(12,4))}))[1:1], recursive := true) from (select o_orderkey, cast(o_orderkey % 1105 as decimal(12,4)) / 10 as q, cast(cast(o_orderkey % 1105 as decimal(12,4)) * 0.1 as decimal(12,4)) as r from orders) a) b")
def _(t, spark):
    cell = F.expr("concat(cast(cast(o_orderkey % 1105 * 0.1bd as decimal(8,1)) as string), '%')")
    return t("orders").select("o_orderkey", money.parse_rate(cell).alias("rate"))


@query("f52_quantity", "select l_orderkey, line_idx, cast(quantity as double) as q from inv_lines")
def _(t, spark):
    return t("inv_lines").select("l_orderkey", "line_idx", money.quantity(F.concat(F.lit(" "), F.col("quantity").cast("string"), F.lit(" "))).alias("q"))


@query("f53_fraction_rate", "select l_orderkey, line_idx, cast(case when l_partkey % 3 = 2 and cast(rate as int) in (0,1,3,4,5,6,7,2,8) then case when cast(rate as int) in (0,1,3,4,5,6) then rate else rate * 0.01 end when rate = 1 then case when l_partkey % 3 = 2 then 1 else 1 end else rate end as double) as rate from raw_rows")
def _(t, spark):
    return t("raw_rows").select("l_orderkey", "line_idx", money.fraction_rate(F.col("rate_cell")).alias("rate"))


@query("f55_words", f"select o_orderkey, cast(total as double) as total, {oracle_parts.rupees('total')} as words, cast(total as double) as amount, 1.0 as certainty from inv_headers where total is not null")
def _(t, spark):
    x = t("inv_headers").where("total is not null").select("o_orderkey", "total", words.words_of(F.col("total")).alias("words"))
    return x.select("o_orderkey", "total", "words", words.amount_of(F.col("words")).alias("a")).select("o_orderkey", "total", "words", "a.amount", "a.certainty")


@query("f59_source_confidence", "select doc_id, source, case source when 'ocr' then least(0.97, case when doc_id % 2 = 0 then 0.8 else 1 end, cast(confidence as double)) when 'rules' then least(0.80, cast(confidence as double)) when 'vlm' then least(0.75, cast(confidence as double)) when 'qr' then least(0.99, cast(confidence as double)) end as c from hypotheses")
def _(t, spark):
    return t("hypotheses").select("doc_id", "source", confidence.source_confidence(F.col("source"), F.col("confidence").cast("double"), F.col("doc_id") % 2 == 0).alias("c"))


@query("f60_cap_confidence", "select doc_id, source, least(1.0, greatest(0.0, case when doc_id % 11 = 0 then 0.5 else 1 end * case when doc_id % 7 = 0 then least(v, 0.92) else v end)) as c from (select doc_id, source, case when doc_id % 3 = 0 then greatest(w, 0.95) when doc_id % 3 = 1 then least(w, 0.60) else w end as v from (select doc_id, source, cast(confidence as double) * case when doc_id % 5 = 0 then 0.5 else 1 end as w from hypotheses) a) b")
def _(t, spark):
    d = F.col("doc_id")
    c = confidence.cap(F.col("confidence").cast("double"), d % 5 == 0, F.when(d % 3 == 0, True).when(d % 3 == 1, False), d % 7 == 0, d % 11 == 0)
    return t("hypotheses").select("doc_id", "source", c.alias("c"))


@query("f61_logistic", "select event_id, round(1 / (1 + exp(-greatest(-25, least(25, (value - 50) / 25 * 1.5 + (user_id % 7 - 3) / 2.0 * -0.5 + 0.25)))), 9) as p from events")
def _(t, spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    f = F.array(F.col("value"), (F.col("user_id") % 7).cast("double"))
    return t("events").select("event_id", F.round(confidence.logistic(f, arr(50, 3), arr(25, 2), arr(1.5, -0.5), F.lit(0.25)), 9).alias("p"))


@query("f63_iou", "select event_id, round(i / greatest(1.0 + 1.0 - i, 1e-12), 9) as iou from (select event_id, greatest(0.0, 1 - (user_id % 10) / 10.0) * greatest(0.0, 1 - (event_id % 10) / 10.0) as i from events) a")
def _(t, spark):
    x, y = (F.col("user_id") % 10) / 10, (F.col("event_id") % 10) / 10
    one = [F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)]
    return t("events").select("event_id", F.round(confidence.iou(one, [x, y, x + 1, y + 1]), 9).alias("iou"))


@query("f65_rotate", "select event_id, round(case event_id % 4 when 0 then a when 1 then 0.6 when 2 then 1 - a - 0.2 else 0.2 end, 9) as x0 from (select event_id, user_id % 50 / 100.0 as a from events) e")
def _(t, spark):
    a = (F.col("user_id") % 50) / 100
    box = confidence.rotate([a, F.lit(0.2), a + 0.2, F.lit(0.4)], (F.col("event_id") % 4 * 90).cast("int"))
    return t("events").select("event_id", F.round(F.element_at(box, 1), 9).alias("x0"))


@query("f70_repair", "select s_suppkey, substr(gstin, 8, 1) not in ('3', '4') as found from sup_ids")
def _(t, spark):
    from docledger.operators import repair

    bad = t("sup_ids").select("s_suppkey", "gstin").withColumn("seen", F.expr("concat(substr(gstin, 1, 7), translate(substr(gstin, 8, 1), '0123456789', 'OIZEASGTBQ'), substr(gstin, 9))"))
    fixed = repair.candidates(bad.select("s_suppkey", "seen"), "s_suppkey", "seen")
    return bad.join(fixed.groupBy("s_suppkey").agg(F.collect_set("candidate").alias("c")), "s_suppkey", "left").select("s_suppkey", (F.coalesce(F.array_contains("c", F.col("gstin")), F.lit(False)) | (F.col("seen") == F.col("gstin"))).alias("found"))


@query("f71_einvoice", "select o_orderkey, invoice_no as doc_no, supplier_gstin as seller, cast(total as double) as total from inv_headers")
def _(t, spark):
    from docledger.operators import extract

    data = F.to_json(F.struct(F.to_json(F.struct(F.col("supplier_gstin").alias("SellerGstin"), F.col("invoice_no").alias("DocNo"), F.col("total").cast("string").alias("TotInvVal"))).alias("data")))
    url = lambda x: F.regexp_replace(F.translate(F.regexp_replace(F.base64(F.encode(x, "utf-8")), "\\s", ""), "+/", "-_"), "=+$", "")
    jwt = F.concat(url(F.lit('{"alg":"none"}')), F.lit("."), url(data), F.lit(".sig"))
    return t("inv_headers").select("o_orderkey", extract.einvoice(jwt).alias("q")).select("o_orderkey", F.col("q.DocNo").alias("doc_no"), F.col("q.SellerGstin").alias("seller"), F.col("q.TotInvVal").cast("double").alias("total"))


@query("f75_sha256", "select doc_id, sha256(text) as h from documents")
def _(t, spark):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("h"))


@query("k05_formula_safe", "select l_orderkey, line_idx, case when regexp_matches(v, '^[=+@\\t\\r]') or (v like '-%' and not regexp_full_match(v, '-[0-9]+(\\.[0-9]+)?')) then '''' || v else v end as safe from (select l_orderkey, line_idx, case line_idx % 4 when 0 then '=' || hsn when 1 then '-' || hsn when 2 then '-x' || hsn else hsn end as v from inv_lines) a")
def _(t, spark):
    v = F.expr("case line_idx % 4 when 0 then concat('=', hsn) when 1 then concat('-', hsn) when 2 then concat('-x', hsn) else hsn end")
    return t("inv_lines").select("l_orderkey", "line_idx", text.formula_safe(v).alias("safe"))


@query("p26_safe_filename", "select doc_id, coalesce(nullif(substr(trim(regexp_replace(regexp_extract(text, '[^/\\\\]*$'), '[^A-Za-z0-9._ -]', '_', 'g'), ' .'), 1, 120), ''), 'upload') as name from documents")
def _(t, spark):
    return t("documents").select("doc_id", text.safe_filename(F.col("text")).alias("name"))


