"""Invoice tables derived from the driver's tables, by SQL that both engines run alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

#: Later views read earlier ones.
VIEWS: dict[str, str] = {}

VIEWS["inv_lines"] = """
select concat('INV-', lpad(cast(l_orderkey as string), 8, '0')) as invoice_no, l_orderkey, l_partkey, l_suppkey,
       cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as int) as line_idx,
       cast(l_quantity as decimal(18,4)) as quantity, cast(l_extendedprice as decimal(18,2)) as gross,
       cast(round(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(5,2)), 2) as decimal(18,2)) as discount,
       cast(cast(l_extendedprice as decimal(18,2)) - round(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(5,2)), 2) as decimal(18,2)) as taxable,
       cast(cast(l_tax as decimal(5,2)) * 100 as decimal(7,2)) as rate,
       lpad(cast(l_partkey % 10000 as string), 4, '0') as hsn, cast(l_shipdate as date) as ship_date
from lineitem"""

#: The check character of a GSTIN, from the parts of the sum.
_GSTIN14 = "concat(lpad(cast(s_nationkey + 1 as string), 2, '0'), 'SUPPL', lpad(cast(s_suppkey % 10000 as string), 4, '0'), 'P', '1', 'Z')"
_ALPHABET = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


def check_sum_sql(text: str, position: str = "instr") -> str:
    """The sum that the check character completes to a multiple of 36."""
    terms = []
    for i in range(14):
        p = f"(({position}({_ALPHABET}, substr({text}, {i + 1}, 1)) - 1) * {1 + i % 2})"
        terms.append(f"cast(floor({p} / 36.0) as int) + {p} % 36")
    return " + ".join(terms)


VIEWS["sup_ids"] = f"""
select s_suppkey, s_name, s_nationkey, g14, concat(g14, substr({_ALPHABET}, cast((36 - check_sum % 36) % 36 as int) + 1, 1)) as gstin
from (select s_suppkey, s_name, s_nationkey, g14, {check_sum_sql("g14")} as check_sum from (select s_suppkey, s_name, s_nationkey, {_GSTIN14} as g14 from supplier) a) b"""

VIEWS["inv_parties"] = """
select o_orderkey, o_custkey, s.s_suppkey as suppkey, s.s_name as supplier_name,
       case when o_orderkey % 7 = 0 then substr(s.gstin, 1, 14) || case when substr(s.gstin, 15, 1) = 'A' then 'B' else 'A' end
            when o_orderkey % 11 = 0 then null else s.gstin end as supplier_gstin,
       lpad(cast(s.s_nationkey + 1 as string), 2, '0') as supplier_state, lpad(cast(c_nationkey + 1 as string), 2, '0') as pos
from orders o join customer c on o.o_custkey = c.c_custkey
left join (select l_orderkey, min(l_suppkey) as first_supp from lineitem group by l_orderkey) f on f.l_orderkey = o.o_orderkey
left join sup_ids s on s.s_suppkey = f.first_supp"""

#: Join hints are comments to DuckDB. Lines and orders are the large sides: shuffled on their key, never broadcast.
VIEWS["inv_line_tax"] = """
select /*+ merge(l, p) */ l.*, p.pos, p.supplier_state, coalesce(p.pos = p.supplier_state, false) as intra,
       case when p.pos = p.supplier_state then cast(round(taxable * rate * 0.005, 2) as decimal(18,2)) end as cgst,
       case when p.pos = p.supplier_state then cast(round(taxable * rate * 0.005, 2) as decimal(18,2)) end as sgst,
       case when p.pos = p.supplier_state then null else cast(round(taxable * rate * 0.01, 2) + case when l_partkey % 50 = 0 then 3 when l_partkey % 50 = 1 then 0.30 else 0 end as decimal(18,2)) end as igst,
       cast(taxable + case when l_partkey % 40 = 0 then 2 else 0 end as decimal(18,2)) as line_total
from inv_lines l join inv_parties p on p.o_orderkey = l.l_orderkey"""

VIEWS["inv_headers"] = """
select /*+ merge(o, t) */ o.o_orderkey, concat('INV-', lpad(cast(o.o_orderkey as string), 8, '0'), case when o.o_orderkey % 97 = 0 then '-REVISED' else '' end) as invoice_no,
       case when o.o_orderkey % 101 = 0 then null else cast(o.o_orderdate as date) end as invoice_date,
       case when o.o_orderkey % 5 = 0 then 'bill_of_supply' else 'tax_invoice' end as document_type,
       p.supplier_name, p.supplier_gstin, p.supplier_state, case when o.o_orderkey % 13 = 0 then null else p.pos end as pos, o.o_custkey,
       t.taxable, t.cgst, t.sgst, t.igst,
       cast(t.taxable + coalesce(t.cgst, 0) + coalesce(t.sgst, 0) + coalesce(t.igst, 0) + case when o.o_orderkey % 10 = 0 then 0.50 when o.o_orderkey % 10 = 1 then 5.00 else 0 end as decimal(18,2)) as total,
       cast(coalesce(t.cgst, 0) + coalesce(t.sgst, 0) + coalesce(t.igst, 0) + case when o.o_orderkey % 17 = 0 then 0.40 else 0 end as decimal(18,2)) as total_tax,
       coalesce(t.n_lines, 0) as n_lines, case when o.o_orderkey % 6 = 0 then 'true' else 'false' end as reverse_charge
from orders o join inv_parties p on p.o_orderkey = o.o_orderkey
left join (select l_orderkey, cast(sum(taxable) as decimal(18,2)) as taxable, cast(sum(cgst) as decimal(18,2)) as cgst, cast(sum(sgst) as decimal(18,2)) as sgst,
                  cast(sum(igst) as decimal(18,2)) as igst, count(*) as n_lines from inv_line_tax group by l_orderkey) t on t.l_orderkey = o.o_orderkey"""

_R = "cast(floor(gross) as bigint)"
_PAISE = "lpad(cast(cast(round((gross - floor(gross)) * 100, 0) as int) as string), 2, '0')"
VIEWS["raw_rows"] = f"""
select l_orderkey, line_idx, gross, taxable, rate, ship_date,
       case when line_idx = 1 then invoice_no end as invoice_cell,
       case when l_partkey % 5 = 0 then concat('Rs. ', cast({_R} as string), '.', {_PAISE}, '/-')
            when l_partkey % 5 = 1 then concat('(', cast({_R} as string), '.', {_PAISE}, ')')
            when l_partkey % 5 = 2 and {_R} >= 100000 then concat(cast(cast(floor({_R} / 100000.0) as bigint) as string), ',', lpad(cast(cast(floor({_R} / 1000.0) as bigint) % 100 as string), 2, '0'), ',', lpad(cast({_R} % 1000 as string), 3, '0'), '.', {_PAISE})
            when l_partkey % 5 = 2 and {_R} >= 1000 then concat(cast(cast(floor({_R} / 1000.0) as bigint) as string), ',', lpad(cast({_R} % 1000 as string), 3, '0'), '.', {_PAISE})
            when l_partkey % 5 = 3 then concat('INR ', cast({_R} as string), '-', {_PAISE})
            when l_partkey % 50 = 4 then concat('12,34,', cast(l_partkey % 90 + 10 as string))
            else concat(cast({_R} as string), '.', {_PAISE}) end as amount_cell,
       case when l_partkey % 5 = 1 then -gross when l_partkey % 50 = 4 and l_partkey % 5 <> 0 then null else gross end as amount,
       case when l_partkey % 3 = 0 then concat(cast(cast(rate as int) as string), '%') when l_partkey % 3 = 1 then cast(cast(rate as int) as string) else concat('0.0', cast(cast(rate as int) as string)) end as rate_cell,
       concat(lpad(cast(extract(day from ship_date) as string), 2, '0'), case when l_partkey % 3 = 0 then '/' when l_partkey % 3 = 1 then '-' else '.' end, lpad(cast(extract(month from ship_date) as string), 2, '0'),
              case when l_partkey % 3 = 0 then '/' when l_partkey % 3 = 1 then '-' else '.' end, cast(extract(year from ship_date) as string)) as date_cell,
       case when l_partkey % 20 = 0 then 'TOTAL' when l_partkey % 20 = 1 then '' when l_partkey % 20 = 2 then 'Subject to jurisdiction' else concat('Item ', cast(l_partkey as string)) end as description_cell, hsn, l_partkey
from inv_line_tax"""

VIEWS["doc_keys"] = """
select concat('job-', cast(o_orderkey as string)) as job_id, 0 as doc_index, concat('sha', cast(o_orderkey % 9000 as string)) as sha256, supplier_gstin, invoice_no as invoice_no_norm, invoice_date, total as total_amount, supplier_name from inv_headers
union all
select concat('copy-', cast(o_orderkey as string)), 0, concat('cpy', cast(o_orderkey as string)), supplier_gstin, case when o_orderkey % 2 = 0 then invoice_no else concat(invoice_no, 'X') end,
       case when o_orderkey % 3 = 0 then invoice_date + interval '2' day else invoice_date end, cast(total + case when o_orderkey % 4 = 0 then 0.01 else 0 end as decimal(18,2)), supplier_name
from inv_headers where o_orderkey % 20 < 3"""

VIEWS["jobs"] = """
select concat('job-', cast(o_orderkey as string)) as id, case o_orderstatus when 'F' then 'completed' when 'O' then 'queued' else 'processing' end as status, o_orderdate as created_at,
       concat('file', cast(o_custkey as string), '.csv') as filename, concat('sha', cast(o_orderkey % 9000 as string)) as sha256, substr(o_orderpriority, 1, 1) as options_json, cast(o_orderkey % 3 as int) as attempt,
       o_orderdate + interval '1' day as expires_at
from orders"""

#: Hypotheses about fields: sources that agree or not, by customer.
VIEWS["hypotheses"] = """
select o_orderkey as doc_id, 'total_amount' as field, src as source, case when o_orderkey % k = 0 then cast(o_orderkey + 1 as string) else cast(o_orderkey as string) end as value,
       cast(0.60 + (o_orderkey % m) * 0.01 as decimal(4,2)) as confidence
from orders cross join (select 'ocr' as src, 3 as k, 31 as m union all select 'rules', 4, 17 union all select 'vlm', 5, 11 union all select 'qr', 1000, 37) s"""


#: The folder that each session's views read.
_registered: dict[int, str] = {}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of this session over the tables of a folder; plans made before, over another folder, keep theirs."""
    session = spark._jsparkSession.hashCode()
    if _registered.get(session) == sf_dir:
        return
    for name in BASE:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)
    _registered[session] = sf_dir


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.table(name)


def with_views(sql: str) -> str:
    """DuckDB SQL: the views as common tables before a query."""
    return "with " + ",\n".join(f"{n} as ({s})" for n, s in VIEWS.items()) + "\n" + sql
