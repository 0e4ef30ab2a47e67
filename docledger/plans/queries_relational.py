"""Queries of joins, aggregations, windows, sorts, sets and state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.functions import dims, ids, money
from docledger.operators import dedupe, export, grouping, jobs, merge, spatial
from docledger.plans import oracle_parts
from docledger.plans.catalog import query
from docledger.streaming import jobs as streams

PAIR = "a.job_id as a_job_id, b.job_id as b_job_id"


@query("j01_candidates", "select k.job_id, k.sha256 from doc_keys k join jobs j on j.id = k.job_id where j.status = 'completed'")
def _(t, spark):
    return dedupe.candidates(t("doc_keys"), t("jobs")).select("job_id", "sha256")


@query("j02_exact_file", f"select {PAIR} from doc_keys a join doc_keys b on a.sha256 = b.sha256 and a.job_id <> b.job_id")
def _(t, spark):
    return dedupe.exact_file(t("doc_keys")).select("a_job_id", "b_job_id")


_BK = "a.supplier_gstin = b.supplier_gstin and a.invoice_no_norm = b.invoice_no_norm and a.job_id <> b.job_id and (a.invoice_date = b.invoice_date or a.total_amount = b.total_amount)"


@query("j03_business_key", f"select {PAIR}, case when a.invoice_date = b.invoice_date then 'invoice_date' else 'total_amount' end as reason from doc_keys a join doc_keys b on {_BK}")
def _(t, spark):
    return dedupe.business_key(t("doc_keys")).select("a_job_id", "b_job_id", "reason")


_CLOSE = "a.job_id <> b.job_id and abs(date_diff('day', a.invoice_date, b.invoice_date)) <= 3 and abs(a.total_amount - b.total_amount) <= 0.01"
_NEAR = f"select a.job_id as a_job_id, b.job_id as b_job_id, a.invoice_no_norm as x, b.invoice_no_norm as y from doc_keys a join doc_keys b on a.supplier_gstin = b.supplier_gstin and {_CLOSE}"
_SCORED = f"select n.a_job_id, n.b_job_id, round(greatest(0.60, least(0.90, r.ratio / 100)), 6) as score from ({_NEAR}) n join {oracle_parts.ratio(_NEAR, 'x', 'y')} r on r.a = n.x and r.b = n.y where r.ratio >= 85"


@query("j04_near", _SCORED)
def _(t, spark):
    return dedupe.near(t("doc_keys")).select("a_job_id", "b_job_id", F.round("score", 6).alias("score"))


_BARE = "select a.job_id as a_job_id, b.job_id as b_job_id, a.invoice_no_norm as x, b.invoice_no_norm as y, a.supplier_name as n, b.supplier_name as m from doc_keys a join doc_keys b on coalesce(a.supplier_gstin, '') = '' and coalesce(b.supplier_gstin, '') = '' and a.job_id <> b.job_id and abs(a.total_amount - b.total_amount) <= 0.01"
_OPEN = "select a.job_id as a_job_id, b.job_id as b_job_id, a.invoice_no_norm as x, b.invoice_no_norm as y, a.supplier_name as n, b.supplier_name as m from doc_keys a join doc_keys b on coalesce(a.supplier_gstin, '') = '' and coalesce(b.supplier_gstin, '') = '' and a.job_id <> b.job_id and (a.total_amount is null or b.total_amount is null) and levenshtein(a.invoice_no_norm, b.invoice_no_norm) <= 4 and levenshtein(a.supplier_name, b.supplier_name) <= 4"
_BOTH = f"{_BARE} union {_OPEN}"
_ALONE = f"select p.a_job_id, p.b_job_id, round(greatest(0.60, least(0.90, (r.ratio + s.ratio) / 200)), 6) as score from ({_BOTH}) p join {oracle_parts.ratio(_BOTH, 'x', 'y')} r on r.a = p.x and r.b = p.y join {oracle_parts.ratio(_BOTH, 'n', 'm')} s on s.a = p.n and s.b = p.m where r.ratio >= 85 and s.ratio >= 90"


@query("j05_near_no_supplier", _ALONE)
def _(t, spark):
    return dedupe.near_without_supplier(t("doc_keys")).select("a_job_id", "b_job_id", F.round("score", 6).alias("score"))


@query("j06_precedence", f"""select a_job_id, b_job_id, arg_min(kind, r) as kind, arg_min(score, r) as score from (
 select {PAIR}, 'exact_file' as kind, 1.0 as score, 1 as r from doc_keys a join doc_keys b on a.sha256 = b.sha256 and a.job_id <> b.job_id
 union all select {PAIR}, 'business_key', 0.95, 2 from doc_keys a join doc_keys b on {_BK}
 union all select a_job_id, b_job_id, 'near', score, 3 from ({_SCORED}) u union all select a_job_id, b_job_id, 'near', score, 3 from ({_ALONE}) v) w group by 1, 2""")
def _(t, spark):
    return dedupe.matches(t("doc_keys")).select("a_job_id", "b_job_id", "kind", F.round("score", 6).alias("score"))


_BATCH = "(select o_custkey % 50 as batch, o_orderkey as seq, o_orderkey % 3 as g, o_orderkey % 40 as n, o_orderkey % 2 as d, o_orderkey % 7 as total from orders)"


@query("j07_within_batch", f"select a.batch, a.seq as a_seq, b.seq as b_seq from {_BATCH} a join {_BATCH} b on a.batch = b.batch and a.seq > b.seq and a.g = b.g and a.n = b.n and (a.d = b.d or a.total = b.total)")
def _(t, spark):
    k = t("orders").selectExpr("o_custkey % 50 as batch", "o_orderkey as seq", "cast(o_orderkey % 3 as string) as supplier_gstin", "cast(o_orderkey % 40 as string) as invoice_no_norm", "o_orderkey % 2 as invoice_date", "o_orderkey % 7 as total_amount")
    return dedupe.within_batch(k, "batch")


@query("j11_hsn_semi", f"select l_orderkey, line_idx, hsn from inv_lines where substr(hsn, 1, 2) in ({', '.join(map(repr, dims.HSN_CHAPTERS))})")
def _(t, spark):
    chapters = spark.sql("select * from values " + ", ".join(f"('{c}')" for c in dims.HSN_CHAPTERS) + " as c(chapter)")
    return t("inv_lines").join(F.broadcast(chapters), F.substring("hsn", 1, 2) == F.col("chapter"), "left_semi").select("l_orderkey", "line_idx", "hsn")


@query("j12_rate_anti", f"select l_orderkey, line_idx, cast(rate as double) as rate from inv_lines where rate not in ({', '.join(dims.RATES)})")
def _(t, spark):
    known = spark.sql("select cast(r as decimal(7,2)) as known from values " + ", ".join(f"({r})" for r in dims.RATES) + " as v(r)")
    return t("inv_lines").join(F.broadcast(known), F.col("rate") == F.col("known"), "left_anti").select("l_orderkey", "line_idx", "rate")


@query("j13_nearest_rate", "select l_orderkey, line_idx, cast(arg_min(k, (abs(k - r), k)) as double) as nearest from (select l_orderkey, line_idx, cast(rate as decimal(12,4)) as r from inv_lines) a, (select unnest([0,0.1,0.25,1,1.5,3,5,7.5,12,18,28,40]::decimal(12,4)[]) as k) b group by 1, 2")
def _(t, spark):
    return t("inv_lines").select("l_orderkey", "line_idx", money.nearest_rate(F.col("rate").cast("decimal(28,8)")).alias("nearest"))


@query("j15_line_align", "select coalesce(a.k, b.k) as l_orderkey, coalesce(a.p, b.p) as line_idx, a.v as left_value, b.v as right_value from (select l_orderkey as k, line_idx as p, hsn as v from inv_lines where l_partkey % 3 <> 0) a full join (select l_orderkey as k, line_idx as p, hsn as v from inv_lines where l_partkey % 3 <> 1) b on a.k = b.k and a.p = b.p")
def _(t, spark):
    x = t("inv_lines")
    return merge.align_lines(x.where("l_partkey % 3 <> 0"), x.where("l_partkey % 3 <> 1"), "l_orderkey", "line_idx", "hsn")


_V = "(select o_orderkey as doc_id, cast(o_orderkey * 7 as varchar) as value from orders)"
_K = "(select l_orderkey as doc_id, case when l_partkey % 2 = 0 then cast(l_orderkey * 7 + l_linenumber % 3 as varchar) else 'x' || cast(l_partkey as varchar) end as token, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as pos from lineitem)"


@query("j17_grounding", f"select v.doc_id, v.value, b.token, b.token is not null as grounded from {_V} v left join (select doc_id, arg_min(token, (d, pos)) as token from (select v.doc_id, k.token, k.pos, levenshtein(upper(v.value), upper(k.token)) as d from {_V} v join {_K} k on v.doc_id = k.doc_id) m where d <= 1 group by doc_id) b on b.doc_id = v.doc_id")
def _(t, spark):
    v = t("orders").selectExpr("o_orderkey as doc_id", "'n' as field", "cast(o_orderkey * 7 as string) as value")
    k = t("lineitem").withColumn("line_idx", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    k = k.selectExpr("l_orderkey as doc_id", "case when l_partkey % 2 = 0 then cast(l_orderkey * 7 + l_linenumber % 3 as string) else concat('x', cast(l_partkey as string)) end as token", "line_idx as pos")
    return merge.ground(v, k).select("doc_id", "value", "token", "grounded")


@query("j19_point_in_box", "select event_id, case when exists (select 1 from (select user_id as u, event_id % 100 / 100.0 as x0, event_id % 100 / 100.0 + 0.1 as x1 from events where event_type = 'purchase') s where s.u = e.user_id and (e.event_id % 97) / 97.0 between s.x0 and s.x1) then 0.72 else 0.9 end as conf from events e")
def _(t, spark):
    e = t("events")
    x = F.col("event_id") % 97 / 97
    tok = e.select("event_id", "user_id", x.alias("x0"), x.alias("x1"), F.lit(0.5).alias("y0"), F.lit(0.5).alias("y1"), F.lit(0.9).alias("conf"))
    st = e.where("event_type = 'purchase'").select("user_id", (F.col("event_id") % 100 / 100).alias("s_x0"), F.lit(0.0).alias("s_y0"), (F.col("event_id") % 100 / 100 + 0.1).alias("s_x1"), F.lit(1.0).alias("s_y1"))
    return spatial.occluded(tok, st, ["user_id"]).select("event_id", F.round("conf", 6).alias("conf"))


@query("j20_column_band", "select l_orderkey, line_idx, least(3, cast(floor((l_partkey % 100) / 25.0) as bigint)) as col from inv_lines")
def _(t, spark):
    heads = spark.sql("select * from values (0, 12.5d), (1, 37.5d), (2, 62.5d), (3, 87.5d) as h(col, center)").withColumn("page", F.lit(1))
    tok = t("inv_lines").select("l_orderkey", "line_idx", (F.col("l_partkey") % 100).cast("double").alias("x0"), F.lit(1).alias("page")).withColumn("x1", F.col("x0"))
    return spatial.into_bands(tok, spatial.bands(heads, ["page"]), ["page"]).select("l_orderkey", "line_idx", "col")


@query("j22_orphans", "select o_orderkey from orders where 'sha' || cast(o_orderkey % 9000 as varchar) not in (select sha256 from doc_keys where job_id like 'job-1%')")
def _(t, spark):
    up = t("orders").select("o_orderkey", F.concat(F.lit("sha"), (F.col("o_orderkey") % 9000).cast("string")).alias("sha256"))
    return jobs.without_parents(up, t("doc_keys").where("job_id like 'job-1%'"), "sha256", "sha256").select("o_orderkey")


@query("a01_group_invoice", "select l_orderkey, count(*) as n_rows, string_agg(hsn, ',' order by line_idx) as items from inv_lines group by 1")
def _(t, spark):
    g = grouping.group_invoices(t("inv_lines"), ["l_orderkey"], "line_idx", ["hsn"])
    return g.select("l_orderkey", "n_rows", F.array_join(F.transform("items", lambda x: x["hsn"]), ",").alias("items"))


@query("a02_first_given", "select l_orderkey, arg_min(case when l_partkey % 3 = 0 then null else hsn end, line_idx) filter (l_partkey % 3 <> 0) as hsn, arg_min(rate_cell, line_idx) filter (l_partkey % 4 <> 0) as rate from raw_rows group by 1")
def _(t, spark):
    x = t("raw_rows").selectExpr("l_orderkey", "line_idx", "case when l_partkey % 3 <> 0 then hsn end as hsn", "case when l_partkey % 4 <> 0 then rate_cell end as rate")
    return grouping.first_given(x, ["l_orderkey"], ["line_idx"], ["hsn", "rate"])


@query("a04_component_rate", "select l_orderkey, line_idx, cast(9 + case when line_idx % 2 = 0 then 9 else 0 end as double) as rate from inv_lines")
def _(t, spark):
    return t("inv_lines").select("l_orderkey", "line_idx", grouping.component_rate(F.lit("0.09"), F.when(F.col("line_idx") % 2 == 0, "9%")).alias("rate"))


@query("a05_tax_total", "select o_orderkey, cast(coalesce(cgst, 0) + coalesce(sgst, 0) + coalesce(igst, 0) as double) as tax from inv_headers")
def _(t, spark):
    return t("inv_headers").select("o_orderkey", grouping.tax_total("cgst", "sgst", "igst").alias("tax"))


@query("a06_taxable_sum", "select l_orderkey, cast(sum(taxable) as double) as taxable, count(taxable) > 0 as have_lines from inv_lines group by 1")
def _(t, spark):
    return t("inv_lines").groupBy("l_orderkey").agg(F.sum("taxable").alias("taxable"), (F.count("taxable") > 0).alias("have_lines"))


_FAM = "case source when 'ocr' then 'ocr_rules' when 'rules' then 'ocr_rules' else source end"


@query("a10_noisy_or", f"select doc_id, field, value, round(least(0.99, 1 - product(1 - c)), 9) as score from (select doc_id, field, value, {_FAM} as f, max(cast(confidence as double)) as c from hypotheses group by 1, 2, 3, 4) a group by 1, 2, 3")
def _(t, spark):
    return merge.noisy_or(t("hypotheses"), ["doc_id", "field", "value"]).select("doc_id", "field", "value", F.round("score", 9).alias("score"))


@query("a11_merge", f"""select doc_id, value, score from (select doc_id, value, score, row_number() over (partition by doc_id order by qr desc, score desc, value) as r from
 (select doc_id, value, bool_or(q) as qr, round(least(0.99, 1 - product(1 - c)), 9) as score from (select doc_id, value, {_FAM} as f, bool_or(source = 'qr') as q, max(cast(confidence as double)) as c from hypotheses group by 1, 2, 3) a group by 1, 2) b) c where r = 1""")
def _(t, spark):
    return merge.merge(t("hypotheses")).select("doc_id", "value", F.round("score", 9).alias("score"))


@query("a13_sources", "select doc_id, value, string_agg(source, '+' order by source) as sources from (select distinct doc_id, value, source from hypotheses) a group by 1, 2")
def _(t, spark):
    return t("hypotheses").groupBy("doc_id", "value").agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))


@query("a14_vote", "select user_id, arg_min(event_type, (-n, seen, event_type)) as event_type, max(n) as votes from (select user_id, event_type, count(*) as n, max(event_id) as seen from events group by 1, 2) a group by 1")
def _(t, spark):
    return merge.vote(t("events"), ["user_id"], "event_type", "event_id")


@query("a15_mean_confidence", "select doc_id, round(avg(cast(confidence as double)), 9) as mean from hypotheses group by 1")
def _(t, spark):
    return t("hypotheses").groupBy("doc_id").agg(F.round(F.avg(F.col("confidence").cast("double")), 9).alias("mean"))


@query("a16_queue_count", "select count(*) filter (status = 'queued') as queued, count(*) filter (status = 'queued') + 3 > 50 as full from jobs")
def _(t, spark):
    return t("jobs").agg(F.count_if(F.col("status") == "queued").alias("queued"), (F.count_if(F.col("status") == "queued") + 3 > 50).alias("full"))


@query("a17_weighted_ratio", "select source, round(sum(n_chars * (doc_id % 10) / 10.0) / sum(n_chars), 9) as ratio from documents group by 1")
def _(t, spark):
    return t("documents").groupBy("source").agg(F.round(F.sum(F.col("n_chars") * (F.col("doc_id") % 10) / 10) / F.sum("n_chars"), 9).alias("ratio"))


@query("a18_line_features", "select user_id, round(avg(0.5 + event_id % 50 / 100.0), 6) as mean_conf, round(stddev_pop(1 + event_id % 7) / avg(1 + event_id % 7), 6) as height_cv, round(median(1 + event_id % 7), 6) as median_height from events group by 1")
def _(t, spark):
    tok = t("events").select("user_id", (F.lit(0.5) + F.col("event_id") % 50 / 100).alias("conf"), F.lit(0.0).alias("y0"), (F.lit(1.0) + F.col("event_id") % 7).alias("y1"))
    return spatial.line_features(tok, ["user_id"]).select("user_id", *[F.round(c, 6).alias(c) for c in ("mean_conf", "height_cv", "median_height")])


@query("a20_union_box", "select user_id, min(event_id % 100) as x0, min(event_id % 90) as y0, max(event_id % 100 + 5) as x1, max(event_id % 90 + 3) as y1 from events group by 1")
def _(t, spark):
    return spatial.union_box(t("events").selectExpr("user_id", "event_id % 100 as x0", "event_id % 90 as y0", "event_id % 100 + 5 as x1", "event_id % 90 + 3 as y1"), ["user_id"])


@query("a22_metrics", "select source, round(avg(cast(value = cast(doc_id as varchar) as int)), 9) as accuracy, count(*) as n from hypotheses group by 1")
def _(t, spark):
    return t("hypotheses").groupBy("source").agg(F.round(F.avg((F.col("value") == F.col("doc_id").cast("string")).cast("int")), 9).alias("accuracy"), F.count("*").alias("n"))


@query("a23_layout_text", "select l_orderkey, line_id, string_agg(hsn, ' ' order by line_idx) as text from (select l_orderkey, line_idx % 3 as line_id, line_idx, hsn from inv_lines) a group by 1, 2")
def _(t, spark):
    return spatial.layout_text(t("inv_lines").selectExpr("l_orderkey", "line_idx % 3 as line_id", "line_idx as x0", "line_idx as token_id", "hsn as text"), ["l_orderkey"])


@query("a24_orientation", "select user_id, arg_min(angle, (-w, angle)) as angle from (select user_id, event_id % 4 * 90 as angle, sum(case when event_id % 5 > 1 then value else 0 end) as w from events group by 1, 2) a group by 1")
def _(t, spark):
    tok = t("events").selectExpr("user_id", "event_id % 4 * 90 as angle", "value as conf", "0 as x0", "case when event_id % 5 > 1 then 1 else 0 end as x1", "0 as y0", "1 as y1")
    return spatial.orientation(tok, ["user_id"])


@query("w01_fill_forward", "select l_orderkey, line_idx, last_value(invoice_cell ignore nulls) over (partition by l_orderkey % 100 order by l_orderkey, line_idx rows between unbounded preceding and current row) as invoice, invoice_cell is null as inherited from raw_rows")
def _(t, spark):
    x = t("raw_rows").withColumn("sheet", F.col("l_orderkey") % 100)
    return grouping.fill_forward(x, "invoice_cell", ["sheet"], ["l_orderkey", "line_idx"], "invoice").select("l_orderkey", "line_idx", "invoice", F.col("invoice_inherited").alias("inherited"))


_KIND = "case when line_idx % 4 = 2 then 'wrapped' when line_idx % 7 = 3 then 'total' else 'line_item' end"


@query("w04_continuation", f"select l_orderkey, line, trim(string_agg(hsn, ' ' order by line_idx)) as description from (select l_orderkey, line_idx, hsn, kind, count(*) filter (kind = 'line_item') over (partition by l_orderkey order by line_idx rows between unbounded preceding and current row) as line from (select *, {_KIND} as kind from inv_lines) a) b where kind in ('line_item', 'wrapped') and line > 0 group by 1, 2")
def _(t, spark):
    return grouping.continuation(t("inv_lines").withColumn("kind", F.expr(_KIND)), ["l_orderkey"], "line_idx", "kind", "hsn")


@query("w05_lookahead", "select l_orderkey, line_idx, hsn, lead(hsn) over (partition by l_orderkey order by line_idx) as value from inv_lines")
def _(t, spark):
    return t("inv_lines").select("l_orderkey", "line_idx", "hsn", F.lead("hsn").over(W.partitionBy("l_orderkey").orderBy("line_idx")).alias("value"))


@query("w09_midpoints", "select l_orderkey, line_idx, round((lag(l_partkey) over w + l_partkey) / 2.0, 6) as lft, round((lead(l_partkey) over w + l_partkey) / 2.0, 6) as rgt from inv_lines window w as (partition by l_orderkey order by l_partkey, line_idx)")
def _(t, spark):
    w = W.partitionBy("l_orderkey").orderBy("l_partkey", "line_idx")
    mid = lambda f: F.round((f("l_partkey").over(w) + F.col("l_partkey")) / 2, 6)
    return t("inv_lines").select("l_orderkey", "line_idx", mid(F.lag).alias("lft"), mid(F.lead).alias("rgt"))


@query("w10_top3", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) a where r <= 3")
def _(t, spark):
    r = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t("orders").withColumn("r", r).where("r <= 3").select("o_custkey", "o_orderkey")


_LIMIT = oracle_parts.fold("select user_id, event_id, epoch_us(ts) / 1e6 as t from events", "user_id", "t, event_id", "cast([t] as double[])", "case when len(list_filter(s, lambda x: o.t - x < 86400)) >= 2 then list_filter(s, lambda x: o.t - x < 86400) else list_append(list_filter(s, lambda x: o.t - x < 86400), o.t) end", "user_id, event_id, not list_contains(s2, t) as limited").replace("cast([t] as double[])", "cast([] as double[])")


@query("w11_rate_limit", _LIMIT)
def _(t, spark):
    return jobs.rate_limited(t("events"), "user_id", "long", "ts", "event_id", most=2, seconds=86400)


@query("w11_would_limit", "select event_id, count(*) over (partition by user_id order by epoch(date_trunc('second', ts)) range between 86399 preceding and current row) > 2 as limited from events")
def _(t, spark):
    return jobs.would_limit(t("events"), "user_id", F.col("ts").cast("timestamp"), most=2, seconds=86400).select("event_id", "limited")


_OPEN_UNTIL = "case when s.until > o.t then s when o.ok then {'f': cast([] as double[]), 'until': cast(null as double), 'trip': false} else {'f': list_append(list_filter(s.f, lambda x: o.t - x <= 864000), o.t), 'until': case when len(list_filter(s.f, lambda x: o.t - x <= 864000)) >= 2 then o.t + 864000 end, 'trip': len(list_filter(s.f, lambda x: o.t - x <= 864000)) >= 2} end"
_BREAK = oracle_parts.fold("select user_id, event_id, event_type = 'purchase' as ok, epoch_us(ts) / 1e6 as t from events", "user_id", "t, event_id", "{'f': cast([] as double[]), 'until': cast(null as double), 'trip': false}", _OPEN_UNTIL, "user_id, event_id, coalesce(s2.until > t and not (s2.trip and list_contains(s2.f, t)), false) as open, coalesce(s2.trip and list_contains(s2.f, t), false) as trips")


def _calls(t):
    return t("events").withColumn("ok", F.col("event_type") == "purchase").withColumn("ts", F.col("ts").cast("timestamp"))


@query("w12_breaker", _BREAK)
def _(t, spark):
    return jobs.breaker(_calls(t), "user_id", "long", "ts", "event_id", "ok", most=3, seconds=864000, closed_for=864000)


@query("t05_deadline", "select user_id, last > 864000 and not done as timed_out, n_kept from (select user_id, max(t - s) as last, max(event_type = 'purchase' and t - s <= 864000) as done, count(*) filter (s is null or t - s <= 864000) as n_kept from (select user_id, event_type, epoch_us(ts) / 1e6 as t, min(case when event_type = 'click' then epoch_us(ts) / 1e6 end) over (partition by user_id) as s from events) a group by 1) b where last is not null union all select user_id, false, count(*) from events group by 1 having count(*) filter (event_type = 'click') = 0")
def _(t, spark):
    return jobs.timed_out(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "event_id", "click", ("purchase",), "event_type", seconds=864000)


@query("w13_stage_duration", "select event_id, epoch(date_trunc('second', lead(ts) over (partition by user_id order by ts, event_id))) - epoch(date_trunc('second', ts)) as seconds from events")
def _(t, spark):
    x = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.stage_durations(x, "user_id", "ts", ["ts", "event_id"]).select("event_id", F.col("seconds").cast("double").alias("seconds"))


@query("o01_recent", "select id from jobs order by created_at desc, id desc limit 100")
def _(t, spark):
    return t("jobs").orderBy(F.desc("created_at"), F.desc("id")).limit(100).select("id")


@query("o02_latest_cached", "select sha256, options_json, id from (select *, row_number() over (partition by sha256, options_json order by created_at desc, id desc) as r from jobs where status = 'completed' and expires_at > timestamp '1997-01-01') a where r = 1")
def _(t, spark):
    return jobs.cached(t("jobs"), F.lit("1997-01-01").cast("timestamp_ntz")).select("sha256", "options_json", "id")


@query("o06_priority", "select l_orderkey, arg_min(hsn, (l_partkey % 5, -line_idx)) as pick from inv_lines group by 1")
def _(t, spark):
    return t("inv_lines").groupBy("l_orderkey").agg(F.min_by("hsn", F.struct(F.col("l_partkey") % 5, -F.col("line_idx"))).alias("pick"))


@query("so01_union", "select doc_id, value, count(*) as n from (select doc_id, value from hypotheses where source = 'qr' union all select doc_id, value from hypotheses where source = 'vlm') a group by 1, 2")
def _(t, spark):
    h = t("hypotheses")
    return h.where("source = 'qr'").unionByName(h.where("source = 'vlm'")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query("so03_array_union", "select user_id, string_agg(event_type, ',' order by event_type) as kinds from (select distinct user_id, event_type from events) a group by 1")
def _(t, spark):
    g = t("events").groupBy("user_id").agg(F.collect_list("event_type").alias("a"))
    return g.select("user_id", F.array_join(F.array_sort(F.array_distinct("a")), ",").alias("kinds"))


@query("so04_except", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def _(t, spark):
    return t("customer").join(t("orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("so05_intersect", "select o_custkey as c_custkey from (select distinct o_custkey from orders where o_orderstatus = 'F') a join (select distinct o_custkey as k from orders where o_orderstatus = 'O') b on k = o_custkey")
def _(t, spark):
    o = t("orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("m03_fold", "select user_id, arg_max(event_type, event_id) as state, count(*) as n_events, cast(min(ts) filter (event_type = 'click') as varchar) as started_at from events group by 1")
def _(t, spark):
    f = jobs.fold(t("events"), "user_id", "event_id", "event_type", "ts", "click", ("purchase",))
    return f.select("user_id", "state", "n_events", F.col("started_at").cast("string").alias("started_at"))


@query("m04_upsert", "select o_custkey, arg_max(o_orderkey, o_orderkey) as o_orderkey from orders group by 1")
def _(t, spark):
    o = t("orders").select("o_custkey", "o_orderkey")
    return jobs.upsert(o.where("o_orderkey % 2 = 0").withColumn("seq", F.col("o_orderkey")), o.where("o_orderkey % 2 = 1").withColumn("seq", F.col("o_orderkey")), ["o_custkey"], "seq").select("o_custkey", "o_orderkey")


@query("m05_cascade", "select k.job_id from doc_keys k where k.job_id not in (select id from jobs where status <> 'completed')")
def _(t, spark):
    return jobs.without_parents(t("doc_keys"), t("jobs").where("status <> 'completed'"), "job_id", "id").select("job_id")


@query("m06_expired", "select id from jobs where expires_at <= timestamp '1996-06-01'")
def _(t, spark):
    return jobs.expired(t("jobs"), F.lit("1996-06-01").cast("timestamp_ntz")).select("id")


@query("m07_recover", "select id, case when status = 'processing' then case when attempt >= 2 then 'failed' else 'queued' end else status end as status, case when status = 'processing' and attempt < 2 then attempt + 1 else attempt end as attempt from jobs")
def _(t, spark):
    return jobs.recover(t("jobs")).select("id", "status", "attempt")


@query("m08_retry", "select job_id from doc_keys where job_id not in (select id from jobs where status = 'queued')")
def _(t, spark):
    return jobs.retry(t("jobs"), t("doc_keys"), t("jobs").where("status = 'queued'").select("id"))[1].select("job_id")


@query("m09_schema_evolution", "select id, filename, null::varchar as batch_id from jobs where id like '%1' union all select id, filename, 'b' from jobs where id not like '%1'")
def _(t, spark):
    j = t("jobs").select("id", "filename")
    return j.where("id like '%1'").unionByName(j.where("id not like '%1'").withColumn("batch_id", F.lit("b")), allowMissingColumns=True)


_ACT = "case event_id % 5 when 0 then 'approve' when 1 then 'reject' when 2 then 'reopen' else 'edit' end"


@query("m10_review", f"select user_id as record, coalesce(arg_max(case action when 'approve' then 'approved' when 'reject' then 'rejected' else 'pending' end, event_id) filter (action <> 'edit'), 'pending') as state, count(*) as n_events from (select user_id, event_id, {_ACT} as action from events) a group by 1")
def _(t, spark):
    e = t("events").selectExpr("user_id as record", "event_id as seq", f"{_ACT} as action", "event_type as field", "cast(value as string) as new")
    return jobs.review_fold(e)[1]


@query("m10_edits", f"select user_id as record, event_type as field, arg_max(event_id, event_id) as value, 'human_verified' as status from (select user_id, event_id, event_type, {_ACT} as action from events) a where action = 'edit' group by 1, 2")
def _(t, spark):
    e = t("events").selectExpr("user_id as record", "event_id as seq", f"{_ACT} as action", "event_type as field", "event_id as new")
    return jobs.review_fold(e)[0].drop("confidence")


@query("k01_exportable", "select o_orderkey from orders where o_orderpriority not like '5%' and (o_orderstatus = 'F' or o_orderpriority like '1%')")
def _(t, spark):
    r = t("orders").selectExpr("o_orderkey", "case when o_orderstatus = 'F' then 'valid' else 'needs_review' end as status", "case when o_orderpriority like '5%' then 'rejected' when o_orderpriority like '1%' then 'approved' else 'pending' end as review_state")
    return export.exportable(r).select("o_orderkey")


@query("k03_flatten", "select h.invoice_no, coalesce(l.hsn, '') as hsn_sac, coalesce(cast(cast(l.taxable as decimal(18,2)) as varchar), '') as taxable_value, coalesce(cast(h.total as varchar), '') as invoice_total from inv_headers h left join inv_lines l on l.l_orderkey = h.o_orderkey")
def _(t, spark):
    g = t("inv_lines").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("hsn").alias("hsn_sac"), F.col("taxable").alias("taxable_value"))).alias("lines"))
    r = t("inv_headers").join(g, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("total_amount", F.col("total"))
    return export.flatten(r).select("invoice_no", "hsn_sac", "taxable_value", "invoice_total")


@query("k02_documents", """select '{"export_version":"1.0","exported_at":"2026-01-01T00:00:00Z","document":{"invoice_no":"' || invoice_no || '"' || case when total is null then '' else ',"total":' || cast(total as varchar) end || case when pos is null then '' else ',"pos":"' || pos || '"' end || '}}' as json from inv_headers""")
def _(t, spark):
    return export.documents(t("inv_headers").select("invoice_no", "total", "pos"), "2026-01-01T00:00:00Z")


@query("p01_unique_headers", "select o_custkey, o_orderkey, case when r = 1 then b else b || '_' || cast(r as varchar) end as header from (select o_custkey, o_orderkey, b, row_number() over (partition by o_custkey, b order by o_orderkey) as r from (select o_custkey, o_orderkey, case when o_orderkey % 4 = 0 then 'col_' || cast(o_orderkey as varchar) else o_orderpriority end as b from orders) a) c")
def _(t, spark):
    x = t("orders").selectExpr("o_custkey", "o_orderkey", "case when o_orderkey % 4 = 0 then '' else o_orderpriority end as name")
    return grouping.unique_headers(x, ["o_custkey"], "o_orderkey", "name").select("o_custkey", "o_orderkey", "header")


_RC = "case when line_idx % 6 = 0 then array('', '', '') when line_idx % 6 = 1 then array('TOTAL', '', '5.00') when line_idx % 6 = 2 then array('', 'more text', '') when line_idx % 6 = 3 then array('x', 'Widget', '10.00') when line_idx % 6 = 4 then array('', '', '12') else array('only', '', '') end"


@query("p08_row_class", "select l_orderkey, line_idx, case line_idx % 6 when 0 then 'blank' when 1 then 'total' when 2 then case when l_partkey % 2 = 0 then 'wrapped' else 'note' end when 3 then 'line_item' when 4 then case when l_partkey % 2 = 0 then 'total' else 'line_item' end else 'note' end as kind from inv_lines")
def _(t, spark):
    x = t("inv_lines").withColumn("cells", F.expr(_RC))
    k = grouping.row_class(F.col("cells"), F.get("cells", F.lit(1)), F.lit(False), F.col("l_partkey") % 2 == 0)
    return x.select("l_orderkey", "line_idx", k.alias("kind"))


@query("p09_blank_run", "select l_orderkey, line_idx from (select *, min(case when run = 3 then line_idx end) over (partition by l_orderkey) as cut from (select l_orderkey, line_idx, count(*) filter (l_partkey % 3 <> 0) over (partition by l_orderkey order by line_idx rows between current row and 2 following) as run from inv_lines) a) b where cut is null or line_idx < cut")
def _(t, spark):
    return grouping.until_blank_run(t("inv_lines").withColumn("blank", F.col("l_partkey") % 3 != 0), ["l_orderkey"], "line_idx", "blank").select("l_orderkey", "line_idx")


@query("p16_source_ref", "select l_orderkey, line_idx, 'Sheet1!R' || cast(line_idx + 1 as varchar) as ref from inv_lines")
def _(t, spark):
    return t("inv_lines").select("l_orderkey", "line_idx", F.format_string("Sheet1!R%d", F.col("line_idx") + 1).alias("ref"))


@query("p27_queue_filter", "select id from jobs where status in ('queued', 'completed') and lower(filename) like '%file1%'")
def _(t, spark):
    return t("jobs").where(F.col("status").isin("queued", "completed") & F.lower("filename").contains("file1")).select("id")


_BOXES = "select user_id, event_id as token_id, (event_id % 40) / 40.0::double as x0, (event_id % 40) / 40.0::double + 0.02::double as x1, (event_id % 23) / 23.0::double as y0, (event_id % 23) / 23.0::double + 0.02::double as y1 from events"
_FITS = "list_position(list_transform(s, lambda h: abs((o.y0 + o.y1) / 2 - h.c) <= 0.01000001 and o.x0 - h.r <= 3 * 0.02), true)"
_HEADS = f"case when coalesce({_FITS}, 0) = 0 then list_append(s, {{'c': (o.y0 + o.y1) / 2, 'r': o.x1, 'last': o.token_id}}) else list_transform(s, lambda h, i: case when i = {_FITS} then {{'c': h.c, 'r': greatest(h.r, o.x1), 'last': o.token_id}} else h end) end"


@query("w02_line_clusters", oracle_parts.fold(_BOXES, "user_id", "(y0 + y1) / 2, x0, token_id", "cast([] as struct(c double, r double, last bigint)[])", _HEADS, "user_id, token_id, cast(list_position(list_transform(s2, lambda h: h.last), token_id) as integer) as line_id"))
def _(t, spark):
    tok = t("events").selectExpr("user_id", "event_id as token_id", "(event_id % 40) / 40.0d as x0", "(event_id % 40) / 40.0d + 0.02d as x1", "(event_id % 23) / 23.0d as y0", "(event_id % 23) / 23.0d + 0.02d as y1")
    return spatial.cluster_lines(tok, ["user_id"], "user_id long")


_AREAS = "select user_id, event_id as token_id, value as conf, (event_id % 10) / 10.0::double as x0, (event_id % 10) / 10.0::double + 0.15::double as x1, (event_id % 7) / 7.0::double as y0, (event_id % 7) / 7.0::double + 0.2::double as y1 from events"
_BOTH_IN = "(greatest(0, least(o.x1, b.x1) - greatest(o.x0, b.x0)) * greatest(0, least(o.y1, b.y1) - greatest(o.y0, b.y0)))"
_OVER = f"len(list_filter(s, lambda b: {_BOTH_IN} > 0.5 * greatest((o.x1 - o.x0) * (o.y1 - o.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_BOTH_IN}, 1e-12))) > 0"


@query("w08_suppress", "select user_id, token_id from (" + oracle_parts.fold(_AREAS, "user_id", "conf desc, token_id", "cast([] as struct(id bigint, x0 double, x1 double, y0 double, y1 double)[])", f"case when {_OVER} then s else list_append(s, {{'id': o.token_id, 'x0': o.x0, 'x1': o.x1, 'y0': o.y0, 'y1': o.y1}}) end", "user_id, token_id, list_contains(list_transform(s2, lambda b: b.id), token_id) as kept") + ") k where kept")
def _(t, spark):
    tok = t("events").selectExpr("user_id", "event_id as token_id", "value as conf", "(event_id % 10) / 10.0d as x0", "(event_id % 10) / 10.0d + 0.15d as x1", "(event_id % 7) / 7.0d as y0", "(event_id % 7) / 7.0d + 0.2d as y1")
    return spatial.suppress(tok, ["user_id"], "user_id long")


@query("p25_state_valid", "select s_suppkey from sup_ids where substr(gstin, 1, 2) <> '96'")
def _(t, spark):
    return t("sup_ids").where(ids.gstin_valid(F.col("gstin"))).select("s_suppkey")


@query("t02_dedupe_stream", "select count(*) as n from (select distinct user_id, event_type from events) a")
def _(t, spark):
    """The stream of events, with one of each user and kind, run to its end."""
    return _streamed(t, spark, lambda s: streams.idempotent(s, ["user_id", "event_type"], hours=24 * 10000), "append").agg(F.count("*").alias("n"))


@query("t03_states_stream", "select user_id, arg_max(event_type, event_id) as state, count(*) as n_events from events group by 1")
def _(t, spark):
    return _streamed(t, spark, lambda s: streams.states(s, "user_id", "event_id", "event_type"), "complete")


@query("t06_rate_stream", _LIMIT)
def _(t, spark):
    return _streamed(t, spark, lambda s: streams.rate_limit(s, "user_id", "long", "event_id", most=2, seconds=86400, forget=False), "append")


@query("t07_breaker_stream", _BREAK)
def _(t, spark):
    return _streamed(t, spark, lambda s: streams.breaker(s.withColumn("ok", F.col("event_type") == "purchase"), "user_id", "long", "event_id", "ok", most=3, seconds=864000, closed_for=864000), "append")


@query("t04_expired_stream", "select user_id, epoch_us(max(ts)) // 1000 + 3600000 as expired_ms from events group by 1 having max(ts) < (select max(ts) from events) - interval '2' hour")
def _(t, spark):
    """Users that fell silent an hour before; those within two hours of the last event are left out, as the watermark need not have passed them."""
    x = _streamed(t, spark, lambda s: streams.lifetimes(s, "user_id", "long", "ts", hours=1.0), "append")
    last = t("events").select((F.max("ts").cast("timestamp") - F.expr("interval 1 hour")).alias("cut")).first()["cut"]
    return x.where(F.col("expired_at") < F.lit(last)).groupBy("user_id").agg(F.unix_millis(F.max("expired_at")).alias("expired_ms"))


@query("t09_replayed", "select user_id, arg_max(event_type, event_id) as event_type from events group by 1")
def _(t, spark):
    """The events in two batches, the second of which runs again: the last row of each user."""
    out = f"{_shared(spark)}/replay-{uuid.uuid4().hex}"
    source = t("events").select("user_id", "event_id", "event_type")
    for number, part in enumerate((source.where("event_id % 2 = 0"), source.where("event_id % 2 = 1"), source.where("event_id % 2 = 1"))):
        streams.replace_batch(part, min(number, 1), out, ["user_id"], "event_id")
    return streams.latest(spark, out, ["user_id"], "event_id").select("user_id", "event_type")


def _shared(spark) -> str:
    """The folder that the cluster shares; on one machine a temporary one."""
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not held and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (held or tempfile.mkdtemp()).rstrip("/")


def _streamed(t, spark, of, mode: str):
    """Runs a stream over the events' files to its end, through Parquet, and gives what it wrote.

    In mode complete each batch replaces the result; what the last one wrote is the answer.
    """
    source = t("events")
    folder, _, name = source.inputFiles()[0].rpartition("/")
    stream = spark.readStream.schema(T.StructType(source.schema.fields)).option("pathGlobFilter", name if name.startswith("events") else "*.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    run = uuid.uuid4().hex
    made, out = of(stream), f"{_shared(spark)}/stream-{run}"
    writer = made.writeStream.outputMode(mode).option("checkpointLocation", f"{_shared(spark)}/stream-state-{run}").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(out).awaitTermination()
    else:
        writer.foreachBatch(lambda df, number: df.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(out)
