"""Line items of document text: rows of a grid of cells, and rows of plain layout lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docledger.functions.text import plain_label

#: What the columns of a grid of line items are called.
LINE_LABELS = {
    "line_no": ("sr no", "s no", "sl no", "line no", "item no", "no."),
    "description": ("description", "particulars", "item description", "product"),
    "hsn_sac": ("hsn", "hsn sac", "sac", "hsn code"),
    "quantity": ("qty", "quantity"),
    "unit": ("unit", "uqc", "um"),
    "unit_price": ("rate", "unit price", "price", "net price"),
    "discount": ("discount",),
    "taxable_value": ("taxable value", "taxable amount", "amount", "net worth"),
    "tax_rate": ("gst rate", "tax rate", "rate %", "vat [%]", "vat"),
    "cgst": ("cgst",),
    "sgst": ("sgst",),
    "igst": ("igst",),
    "cess": ("cess",),
    "line_total": ("total", "line total", "net amount", "amount", "gross worth"),
}
#: Rows of a grid that are no items, and rows that carry a sum over a page.
SUMS = ("subtotal", "grand total", "net payable", "round off", "total amount")
CARRIED = ("carried forward", "c/f", "b/f", "brought forward")
FIELDS = tuple(LINE_LABELS)
ITEM = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">"


def _has(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p))


def useful(item: Column) -> Column:
    """Whether an item has a description or code together with a figure or code."""
    given = lambda f: F.trim(F.coalesce(item[f], F.lit(""))) != ""
    figures = given("quantity") | given("taxable_value") | given("line_total")
    return (given("description") & (given("hsn_sac") | figures)) | (given("hsn_sac") & figures)


def header_columns(cells: Column) -> Column:
    """struct of the first cell (from 1; 0: none) that names each field: its text holds one of the field's labels."""
    plain = F.transform(cells, plain_label)

    def place(labels: tuple[str, ...]) -> Column:
        words = F.array(*[F.lit(x) for x in sorted({" ".join("".join(c if c.isalnum() else " " for c in a).split()) for a in labels})])
        return F.coalesce(F.array_position(F.transform(plain, lambda c: F.exists(words, lambda w: F.contains(c, w))), True), F.lit(0)).cast("int")

    return F.struct(*[place(labels).alias(f) for f, labels in LINE_LABELS.items()])


def grid(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no and cells of the lines that stand between bars and have three cells at least."""
    rows = texts.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "line")).where(F.col("line").startswith("| ") & F.col("line").endswith(" |"))
    inner = F.regexp_replace("line", r"^[| ]+|[| ]+$", "")
    return rows.select(key, "line_no", F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)).alias("cells")).where(F.size("cells") >= 3)


def grid_items(rows: DataFrame, key: str) -> DataFrame:
    """key, item_no (from 1), line_no, item (struct of text fields) and carried (rows with carried sums before it that were left out).

    A row with three named columns or more is a header for the rows after it. A row without figures continues the description
    of the item before it.
    """
    w = W.partitionBy(key).orderBy("line_no")
    joined = F.lower(F.array_join("cells", " "))
    x = rows.withColumn("at", header_columns(F.col("cells")))
    named = sum((F.when(F.col(f"at.{f}") > 0, 1).otherwise(0) for f in FIELDS[1:]), F.when(F.col(f"at.{FIELDS[0]}") > 0, 1).otherwise(0))
    x = x.withColumn("is_header", named >= 3)
    x = x.withColumn("header", F.last(F.when(F.col("is_header"), F.col("at")), ignorenulls=True).over(w)).where(~F.col("is_header") & F.col("header").isNotNull())
    x = x.withColumn("carry", _has(joined, CARRIED)).where(~(~F.col("carry") & _has(joined, SUMS)))
    cell = lambda f: F.when(F.col(f"header.{f}") > 0, F.nullif(F.coalesce(F.get("cells", F.col(f"header.{f}") - 1), F.lit("")), F.lit("")))
    x = x.withColumn("item", F.struct(*[cell(f).alias(f) for f in FIELDS])).withColumn("plain", ~F.exists("cells", lambda c: c.rlike("[0-9]")) & ~F.col("carry"))
    x = x.withColumn("is_item", ~F.col("carry") & useful(F.col("item")))
    # A row without figures continues an item if one stands before it, else it is read as a row of its own.
    before = F.coalesce(F.max(F.col("is_item") & ~F.col("plain")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    x = x.withColumn("wrapped", F.col("plain") & before).withColumn("is_item", F.col("is_item") & ~F.col("wrapped"))
    x = x.withColumn("item_no", F.count_if("is_item").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return _assembled(x, key)


def _assembled(x: DataFrame, key: str) -> DataFrame:
    more = F.get(F.filter("cells", lambda c: c != ""), 0)
    g = x.where("item_no > 0 or carry").groupBy(key, "item_no").agg(
        F.min_by("item", F.when(F.col("is_item"), F.col("line_no"))).alias("item"), F.min(F.when(F.col("is_item"), F.col("line_no"))).alias("line_no"),
        F.array_sort(F.collect_list(F.when(F.col("wrapped"), F.struct("line_no", more.alias("t"))))).alias("parts"), F.count_if("carry").alias("carried"),
    ).where("item_no > 0")
    rest = F.array_join(F.transform("parts", lambda p: p["t"]), " ")
    told = F.when(F.size("parts") > 0, F.concat_ws(" ", F.col("item.description"), rest)).otherwise(F.col("item.description"))
    told = F.when(F.col("item.description").isNotNull(), told)
    return g.select(key, "item_no", "line_no", F.col("item").withField("description", told).alias("item"), "carried")


#: Fixed value: a line with a number, a description, a code and two to four figures.
ROW = r"^\s*(\d{1,3})\s+(.+?)\s+(\d{4,8})\s+((?:\d[\d,]*(?:\.\d{1,2})?\s*){2,4})$"
FIGURE = r"\d[\d,]*(?:\.\d{1,2})?"


def header_tax_rate(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key and tax_rate: what all tax components are of the taxable value, in percent; each from the last line that names it. 0 without a taxable value."""
    lines = texts.select(key, F.posexplode(F.split(F.lower(F.col(text)), r"\r?\n")).alias("line_no", "line"))
    last = F.translate(F.try_element_at(F.regexp_extract_all("line", F.lit(FIGURE), F.lit(0)), F.lit(-1)), ",", "").cast("decimal(28,2)")
    names = {"taxable": "taxable value", "cgst": "cgst", "sgst": "sgst", "igst": "igst", "cess": "cess"}
    lines = lines.where(F.col("line").rlike("taxable value|cgst|sgst|igst|cess")).withColumn("last", F.when(F.size(F.regexp_extract_all("line", F.lit(FIGURE), F.lit(0))) > 0, last))
    g = lines.groupBy(key).agg(*[F.max_by("last", F.when(F.contains("line", F.lit(label)) & F.col("last").isNotNull(), F.col("line_no"))).alias(f) for f, label in names.items()])
    zero = F.lit(0).cast("decimal(28,2)")
    tax = sum((F.coalesce(f, zero) for f in ("sgst", "igst", "cess")), F.coalesce("cgst", zero))
    return g.select(key, F.when(F.coalesce("taxable", zero) != 0, F.round(tax * 100 / F.col("taxable"), 2)).otherwise(0).cast("decimal(18,2)").alias("tax_rate"))


def layout_items(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, item_no, line_no and item from lines of a layout (after their L### bar) that read as number, text, code and figures.

    Of three figures and more the last three are quantity, price and taxable value; of two, price and taxable value of one
    piece. Where the document's taxes say a rate, the rate and the line's total come from it.
    """
    rows = texts.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "raw")).where(F.contains("raw", F.lit("|")))
    rows = rows.withColumn("line", F.trim(F.expr("substring(raw, instr(raw, '|') + 1)"))).where(F.col("line").rlike(ROW))
    part = lambda i: F.regexp_extract("line", ROW, i)
    rows = rows.withColumn("v", F.transform(F.regexp_extract_all(part(4), F.lit(FIGURE), F.lit(0)), lambda x: F.translate(x, ",", "").cast("decimal(20,2)")))
    pick = lambda i: F.element_at("v", i)
    rows = rows.withColumn("q", F.when(F.size("v") >= 3, F.try_element_at("v", F.lit(-3))).otherwise(F.lit(1).cast("decimal(20,2)")))
    rows = rows.where((F.size("v") >= 2) & (F.col("q") > 0) & (pick(-1) > 0)).join(header_tax_rate(texts, key, text), key, "left")
    rate = F.when(F.col("tax_rate") > 0, F.col("tax_rate"))
    short = lambda c: F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    money = lambda c: F.round(c, 2).cast("decimal(20,2)").cast("string")
    made = {
        "line_no": part(1), "description": F.trim(part(2)), "hsn_sac": part(3), "quantity": short(F.col("q")), "unit_price": money(pick(-2)), "taxable_value": money(pick(-1)),
        "tax_rate": short(rate), "line_total": money(pick(-1) * (100 + rate) / 100),
    }
    item = F.struct(*[made.get(f, F.lit(None).cast("string")).alias(f) for f in FIELDS])
    return rows.select(key, F.row_number().over(W.partitionBy(key).orderBy("line_no")).cast("long").alias("item_no"), "line_no", item.alias("item"))


def line_items(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, item_no, line_no and item: from the grid where the document has one, else from its layout lines."""
    rows = grid(texts, key, text)
    plain = texts.join(rows.select(key).distinct(), key, "left_anti")
    return grid_items(rows, key).drop("carried").unionByName(layout_items(plain, key, text))


def carried_rows(rows: DataFrame, key: str) -> DataFrame:
    """key and n: grid rows that were left out because they carry a sum from page to page (CARRY_FORWARD_ROW_IGNORED)."""
    return rows.where(_has(F.lower(F.array_join("cells", " ")), CARRIED)).groupBy(key).agg(F.count("*").alias("n"))
