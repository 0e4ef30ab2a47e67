"""From spreadsheet rows to invoices: fill-forward, classes of rows, groups, declared totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docledger.functions import money


def fill_forward(rows: DataFrame, col: str, by: list[str], order: list[str], out: str) -> DataFrame:
    """`out`: the last value given so far within a sheet; `out`_inherited: whether the row's own is blank."""
    own = F.when(F.trim(F.col(col)) != "", F.col(col))
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({out: F.last(own, ignorenulls=True).over(w), f"{out}_inherited": own.isNull()})


def unique_headers(cells: DataFrame, by: list[str], pos: str, name: str) -> DataFrame:
    """`header`: a blank name is col_n, a repeated one gets its number."""
    base = F.when(F.trim(F.coalesce(F.col(name), F.lit(""))) != "", F.trim(F.col(name))).otherwise(F.concat(F.lit("col_"), F.col(pos).cast("string")))
    k = F.row_number().over(W.partitionBy(*by, "_base").orderBy(pos))
    return cells.withColumn("_base", base).withColumn("header", F.when(k == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("_"), k.cast("string")))).drop("_base")


TOTAL = "(?i)^(sub\\s*total|total|grand\\s*total|round\\s*off|rounded|net\\s*payable|amount\\s*payable)\\b"


def row_class(cells: Column, description: Column, is_header: Column, after_line: Column) -> Column:
    """blank, header_repeat, total, wrapped, note or line_item. cells: the row's texts; after_line: a line item came before."""
    filled = F.filter(cells, lambda x: F.coalesce(x, F.lit("")) != "")
    numbers = F.size(F.filter(filled, lambda x: money.lenient(x).isNotNull()))
    blank = F.coalesce(description, F.lit("")) == ""
    return (
        F.when(F.size(filled) == 0, "blank").when(is_header, "header_repeat").when(F.get(filled, F.lit(0)).rlike(TOTAL), "total").when(after_line & blank & (numbers > 0), "total")
        .when((F.size(filled) == 1) & ~blank & (numbers == 0), F.when(after_line, "wrapped").otherwise("note")).when((F.size(filled) == 1) & (numbers == 0), "note").otherwise("line_item")
    )


def continuation(rows: DataFrame, by: list[str], order: str, kind: str, text: str) -> DataFrame:
    """by, line (number of the line item) and description: each line item's text with the wrapped rows after it."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    lines = rows.withColumn("line", F.count_if(F.col(kind) == "line_item").over(w)).where(F.col(kind).isin("line_item", "wrapped") & (F.col("line") > 0))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return lines.groupBy(*by, "line").agg(F.trim(F.array_join(F.transform(parts, lambda x: x["t"]), " ")).alias("description"))


def until_blank_run(rows: DataFrame, by: list[str], order: str, blank: str, run: int = 3) -> DataFrame:
    """The rows before the first run of `run` blank rows, of each sheet."""
    w = W.partitionBy(*by).orderBy(order)
    full = rows.withColumn("_in", F.sum(F.col(blank).cast("int")).over(w.rowsBetween(0, run - 1))).withColumn("_n", F.row_number().over(w))
    cut = F.min(F.when(F.col("_in") == run, F.col("_n"))).over(W.partitionBy(*by))
    return full.withColumn("_cut", cut).where(F.col("_cut").isNull() | (F.col("_n") < F.col("_cut"))).drop("_in", "_n", "_cut")


def group_invoices(rows: DataFrame, keys: list[str], order: str, item: list[str]) -> DataFrame:
    """A row for each invoice, with its items in order."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("pos"), *item))).alias("items"))


def first_given(rows: DataFrame, keys: list[str], order: list[Column | str], fields: list[str]) -> DataFrame:
    """The first value that is not null of each field, in order."""
    rank = F.struct(*order)
    return rows.groupBy(*keys).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in fields])


def declared_mismatch(declared: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Declared totals that differ from the lines: key, field, expected (from lines), actual (declared), difference.

    Taxable values within 0.01, totals within 0.02; a total is compared with the lines' totals, or with their parts if no line
    has one.
    """
    parts = F.coalesce(F.col("taxable"), F.lit(0)) + F.coalesce(F.col("cgst"), F.lit(0)) + F.coalesce(F.col("sgst"), F.lit(0)) + F.coalesce(F.col("igst"), F.lit(0))
    sums = lines.groupBy(key).agg(F.sum("taxable").alias("s_taxable"), F.when(F.count("line_total") > 0, F.sum("line_total")).otherwise(F.sum(parts)).alias("s_total"))
    met = declared.join(sums, key)
    long = met.select(key, F.explode(F.array(
        F.struct(F.lit("taxable_value").alias("field"), F.col("s_taxable").cast("decimal(24,2)").alias("expected"), F.col("d_taxable").cast("decimal(24,2)").alias("actual"), F.lit("0.01").cast("decimal(24,2)").alias("tol")),
        F.struct(F.lit("total_amount").alias("field"), F.col("s_total").cast("decimal(24,2)").alias("expected"), F.col("d_total").cast("decimal(24,2)").alias("actual"), F.lit("0.02").cast("decimal(24,2)").alias("tol")),
    )).alias("c")).select(key, "c.*")
    return long.withColumn("difference", F.abs(F.col("actual") - F.col("expected"))).where("difference > tol").drop("tol")


def tax_total(*parts: str) -> Column:
    return sum((F.coalesce(F.col(p), F.lit(0).cast("decimal(18,2)")) for p in parts[1:]), F.coalesce(F.col(parts[0]), F.lit(0).cast("decimal(18,2)")))


def component_rate(*parts: Column) -> Column:
    """Sum of the component rates that are given, fractions as percent; null if none is."""
    values = [money.fraction_rate(p) for p in parts]
    zero = F.lit(0).cast("decimal(12,4)")
    return F.when(F.coalesce(*values).isNotNull(), sum((F.coalesce(v, zero) for v in values[1:]), F.coalesce(values[0], zero)))
