"""The layout model: fields from where tokens stand on a page.

Tokens: a key (the document), token_id, text and a box x0, y0, x1, y1 in parts of the page. Hypotheses have the source
`trained_model`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docledger.functions.text import plain_label
from docledger.operators import extract, spatial

#: How sure the model is of each field, where its two columns part, and how high a band of tokens is.
SURE = {"invoice_no": 0.96, "invoice_date": 0.96, "due_date": 0.90, "supplier_name": 0.95, "supplier_address": 0.92, "buyer_name": 0.95, "buyer_address": 0.92, "supplier_gstin": 0.93, "buyer_gstin": 0.93, "total_amount": 0.96, "subtotal": 0.94, "total_tax": 0.93}
SPLIT, BAND = 0.48, 0.012
DATE = r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b"
#: Fixed values: (field, what its token says, the value in the same token, what the next token must be).
HEADERS = (
    ("invoice_no", r"(?i)invoice no|^inv no", r"(?i)(?:invoice no|inv no)\s*[:#\-]?\s*([A-Za-z0-9\-]+)", r"^([A-Za-z0-9\-]+)$"),
    ("invoice_date", r"(?i)date of issue|date:|invoice date", DATE, DATE),
    ("due_date", r"(?i)due date", DATE, DATE),
)
#: What a whole text says where no token does.
FALLBACK = {"invoice_no": r"(?i)Invoice\s*(?:no|number)?\s*[:#\-]?\s*([A-Za-z0-9\-]+)", "invoice_date": r"(?i)(?:Date\s+of\s+issue|Invoice\s+date|Date)\s*[:#\-]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"}


def _hypothesis(df: DataFrame, key: str, field: Column, value: Column, evidence: Column) -> DataFrame:
    sure = F.element_at(F.create_map(*[F.lit(x) for kv in SURE.items() for x in kv]), field)
    return df.select(key, field.alias("field"), value.alias("value"), sure.alias("confidence"), F.lit("trained_model").alias("source"), F.substring(evidence, 1, extract.MODEL_EVIDENCE).alias("evidence"))


def _order(key: str):
    return W.partitionBy(key).orderBy("y0", "x0", "token_id")


def header_fields(tokens: DataFrame, key: str, layout: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Hypotheses of number and dates: in the token that names them, else in the next token of the page.

    layout: (key, text); a number or date that no token gives is searched there.
    """
    x = tokens.withColumn("next", F.lead("text").over(_order(key)))
    some = lambda pattern, c: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    rows = []
    for field, named, own, following in HEADERS:
        mine, after = some(own, F.col("text")), some(following, F.col("next"))
        rows.append(F.when(F.col("text").rlike(named), F.struct(F.lit(field).alias("field"), F.coalesce(mine, after).alias("value"), F.when(mine.isNotNull(), F.col("text")).otherwise(F.concat_ws(" ", "text", "next")).alias("evidence"))))
    hits = x.select(key, F.explode(F.filter(F.array(*rows), lambda r: r["value"].isNotNull())).alias("r"))
    out = _hypothesis(hits, key, F.col("r.field"), F.col("r.value"), F.col("r.evidence"))
    if layout is None:
        return out
    every = F.array(*[F.struct(F.lit(f).alias("field"), some(p, F.col(text)).alias("value"), F.regexp_extract(text, p, 0).alias("evidence")) for f, p in FALLBACK.items()])
    rest = layout.select(key, F.explode(F.filter(every, lambda r: r["value"].isNotNull())).alias("r")).select(key, "r.*")
    rest = rest.join(out.select(key, "field").distinct(), [key, "field"], "left_anti")
    return out.union(_hypothesis(rest, key, F.col("field"), F.col("value"), F.col("evidence")))


def bands(tokens: DataFrame, key: str, key_type: str, tolerance: float = BAND) -> DataFrame:
    """line_id of each token: bands of tokens whose centres are within the tolerance of their first one's."""
    slim = tokens.select(F.col(key).cast(key_type).alias(key), F.col("token_id").cast("long").alias("token_id"), "x0", "y0", "y1")
    return spatial.banded(spatial.pages(slim, [key]), [key], tolerance).select(key, "token_id", "line_id")


def _between(page: DataFrame, key: str) -> DataFrame:
    """Bands of the tokens of pages (key, tokens, top, bottom) whose centres lie from top to bottom."""
    mid = lambda t: (t["y0"] + t["y1"]) / 2
    held = F.filter("tokens", lambda t: (mid(t) >= F.col("top")) & (mid(t) <= F.col("bottom")))
    return spatial.banded(page.select(key, held.alias("tokens")), [key], BAND)


def _strings(tokens: DataFrame, by: list[str]) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("x0", "token_id", "text")))
    return tokens.groupBy(*by).agg(F.trim(F.array_join(F.transform(parts, lambda p: p["text"]), " ")).alias("line"))


def party_fields(tokens: DataFrame, key: str, key_type: str) -> DataFrame:
    """Hypotheses of names, addresses and tax numbers from the two columns below the seller's and the client's headings.

    The first line of a party's column that is neither a tax number nor (a seller's) bank account is its name, what follows its
    address, a line each.
    """
    first = lambda pattern: F.min_by("y0", F.when(F.trim("text").rlike(pattern), F.struct("y0", "x0", "token_id")))
    at = spatial.pages(tokens, [key], first(r"(?i)^seller\b").alias("seller"), first(r"(?i)^client\b|^buyer\b|^bill\s+to\b").alias("client"), first(r"(?i)^items\b").alias("items")).where("seller is not null and client is not null")
    at = at.select(key, "tokens", F.least("seller", "client").alias("top"), F.coalesce("items", F.least("seller", "client") + 0.35).alias("bottom"))
    placed = _between(at, key).withColumn("side", extract.party_side(F.col("x0"), F.col("x1"), SPLIT))
    lines = _strings(placed, [key, "side", "line_id"]).where("line <> ''")
    heading = F.when(F.col("side") == "seller", F.col("line").rlike(r"(?i)^seller\b|^items\b")).otherwise(F.col("line").rlike(r"(?i)^client\b|^buyer\b"))
    lines = lines.where(~heading).withColumn("tax", F.col("line").rlike(r"(?i)tax\s*id|vat")).where(F.col("tax") | (F.col("side") == "client") | ~F.col("line").rlike("(?i)iban"))
    party = F.when(F.col("side") == "seller", "supplier").otherwise("buyer")
    number = F.coalesce(F.nullif(F.regexp_extract("line", r"(?i)(?:tax\s*id|vat)[:#\-]?\s*([A-Za-z0-9\-]+)", 1), F.lit("")), F.col("line"))
    said = F.array_sort(F.collect_list(F.struct("line_id", "line", "tax", number.alias("number"))))
    sides = lines.groupBy(key, "side").agg(said.alias("said"))
    told = lambda field, value, evidence: F.struct(F.concat(party, F.lit(field)).alias("field"), value.alias("value"), evidence.alias("evidence"))
    plain = F.transform(F.filter("said", lambda s: ~s["tax"]), lambda s: s["line"])
    tax = F.transform(F.filter("said", lambda s: s["tax"]), lambda s: told("_gstin", s["number"], s["line"]))
    sides = sides.select(key, "side", tax.alias("tax"), plain.alias("plain"), F.array_join(F.slice(plain, 2, F.greatest(F.size(plain), F.lit(1))), "\n").alias("rest"))
    name, rest = F.get("plain", F.lit(0)), F.when(F.size("plain") > 1, F.col("rest"))
    found = F.concat("tax", F.filter(F.array(told("_name", name, name), told("_address", rest, rest)), lambda r: r["value"].isNotNull()))
    hits = sides.select(key, F.explode(found).alias("r"))
    return _hypothesis(hits, key, F.col("r.field"), F.col("r.value"), F.col("r.evidence"))


#: A row of three totals, and one total by its name.
THREE = r"(?i)Total\s*[$₹€£]?\s*([0-9.,]+)\s*[$₹€£]?\s*([0-9.,]+)\s*[$₹€£]?\s*([0-9.,]+)"
ONE = r"(?i)(?:Grand\s+Total|Total\s+Amount|Gross\s+worth|Net\s+Payable|Total)\s*[:$₹€£\-]?\s*([0-9.,]+)"


def total_fields(layout: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Hypotheses of net, tax and gross from a row of three totals, else of the gross total alone."""
    joined = F.col(text)
    for _ in range(2):
        joined = F.regexp_replace(joined, r"(\d)\s+(\d{3}(?:[.,]|\b))", "$1$2")
    x = layout.withColumn("_j", joined).withColumn("_three", F.col("_j").rlike(THREE))
    part = lambda i: extract.clean_amount(F.regexp_extract("_j", THREE, i))
    one = F.regexp_extract(F.col(text), ONE, 1)
    told = lambda f, v, said: F.struct(F.lit(f).alias("field"), v.alias("value"), F.concat(F.lit(said), v).alias("evidence"))
    rows = F.when(F.col("_three"), F.array(told("subtotal", part(1), "Net worth: "), told("total_tax", part(2), "VAT tax: "), told("total_amount", part(3), "Gross total: "))).when(one != "", F.array(told("total_amount", extract.clean_amount(one), "")))
    hits = x.select(key, F.explode(rows).alias("r"))
    return _hypothesis(hits, key, F.col("r.field"), F.col("r.value"), F.col("r.evidence"))


#: Where the columns of a table of items stand (centre from, to), and below which height "total" ends it.
COLUMNS = {"description": (0.12, 0.39), "quantity": (0.38, 0.45), "unit": (0.45, 0.52), "unit_price": (0.52, 0.63), "tax_rate": (0.73, 0.83), "line_total": (0.83, 0.95)}
LEAD, LOW, FLOOR = 0.14, 0.60, 0.80
FIGURES = ("quantity", "unit_price", "line_total")


def item_fields(tokens: DataFrame, key: str, key_type: str) -> DataFrame:
    """key, item_no, line_no, description, quantity, unit, unit_price, tax_rate and line_total of a table of items.

    The table lies below the token that says description, down to a summary or total. A band that a number leads begins an item;
    the bands after it add to its description and fill its empty figures. A page stays one row up to its items, so that no token or band is grouped again.
    """
    low, place = F.lower("text"), F.struct("y0", "x0", "token_id")
    top = F.min_by("y1", F.when(F.contains(low, F.lit("description")), place))
    bottom = F.min_by("y0", F.when(F.contains(low, F.lit("summary")) | (F.contains(low, F.lit("total")) & (F.col("y0") > LOW)), place))
    slim = F.struct("x0", "token_id", "text", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    page = tokens.groupBy(key).agg(F.collect_list(slim).alias("tokens"), top.alias("top"), bottom.alias("bottom")).where("top is not null")
    held = F.filter("tokens", lambda t: (t["y"] >= F.col("top") + 0.005) & (t["y"] <= F.coalesce(F.col("bottom") - 0.005, F.lit(FLOOR))))
    lined = spatial.let(held, lambda h: spatial.lined(h, BAND, lambda t: t["y"], lambda t, line: F.struct(line.alias("line"), *[t[c].alias(c) for c in ("x0", "token_id", "text", "x")])))
    items = page.select(key, F.posexplode(spatial.let(F.sort_array(lined), _items)).alias("i", "r")).select(key, (F.col("i") + 1).cast("long").alias("item_no"), "r.*")
    amount = lambda c: F.nullif(extract.clean_amount(c), F.lit(""))
    figure = lambda f: F.coalesce(amount(F.get(f, F.lit(0))), F.get(F.array_compact(F.transform(f, amount)), F.lit(0)))
    plain = lambda f: F.nullif(F.trim(f), F.lit(""))
    items = items.select(key, "item_no", F.rtrim(F.trim("line_no"), F.lit(".")).alias("line_no"), plain("description").alias("description"), *[(figure(f) if f in FIGURES else plain(f)).alias(f) for f in COLUMNS if f != "description"])
    return items.where("description is not null or quantity is not null or line_total is not null")


def _items(tokens: Column) -> Column:
    """Of a page's tokens in order of their lines and places: the number, words and figures of each item, as they stand there.

    Of a figure, the first token of each line of the item; of unit and tax rate, that of its first line.
    """
    inside = lambda t, f: (t["x"] >= COLUMNS[f][0]) & ((t["x"] <= COLUMNS[f][1]) if f == "line_total" else (t["x"] < COLUMNS[f][1]))
    same = lambda x, i, t: F.coalesce(F.get(x, i)["line"] == t["line"], F.lit(False))
    firsts = lambda x: spatial.let(x, lambda x: F.filter(x, lambda t, i: ~same(x, i - 1, t)))
    texts = lambda x: F.transform(x, lambda t: t["text"])
    # A line whose only word is empty adds none to a description.
    words = lambda own: spatial.let(F.filter(own, lambda t: inside(t, "description") & t["text"].isNotNull()), lambda x: F.array_join(texts(F.filter(x, lambda t, i: (t["text"] != "") | same(x, i - 1, t) | same(x, i + 1, t))), " "))

    def item(one: Column, own: Column) -> Column:
        figure = lambda f: texts(firsts(F.filter(own, lambda t: inside(t, f))))
        leading = lambda f: F.get(F.filter(own, lambda t: (t["line"] == one["line"]) & inside(t, f)), F.lit(0))["text"]
        return F.struct(one["text"].alias("line_no"), words(own).alias("description"), *[(figure(f) if f in FIGURES else leading(f)).alias(f) for f in COLUMNS if f != "description"])

    def each(begins: Column) -> Column:
        until = lambda i: F.coalesce(F.get(begins, i + 1)["line"], F.lit(2**31 - 1))
        return F.transform(begins, lambda one, i: spatial.let(F.filter(tokens, lambda t: (t["line"] >= one["line"]) & (t["line"] < until(i))), lambda own: item(one, own)))

    leads = firsts(F.filter(tokens, lambda t: t["x0"] < LEAD))
    return spatial.let(F.filter(leads, lambda t: F.trim(t["text"]).rlike(r"^\d+\.?$")), each)


def model_hypotheses(tokens: DataFrame, layout: DataFrame, key: str, key_type: str) -> DataFrame:
    """All header hypotheses of the layout model. layout: (key, text)."""
    return header_fields(tokens, key, layout).union(party_fields(tokens, key, key_type)).union(total_fields(layout, key))


def tokens_for_value(values: DataFrame, tokens: DataFrame, by: list[str]) -> DataFrame:
    """by, field and token_id of the tokens that spell a value: those that lie in it or hold it, else those that share a word with it.

    values: by, field, value; tokens: by, token_id, text.
    """
    wanted, said = plain_label(F.col("value")), plain_label(F.col("text"))
    met = values.join(tokens, by).withColumns({"_v": wanted, "_t": said}).where("_t <> '' and _v <> ''")
    met = met.withColumns({"_whole": F.contains("_v", F.col("_t")) | F.contains("_t", F.col("_v")), "_part": F.arrays_overlap(F.split("_v", " "), F.split("_t", " "))})
    met = met.withColumn("_any", F.max("_whole").over(W.partitionBy(*by, "field")))
    return met.where(F.when(F.col("_any"), F.col("_whole")).otherwise(F.col("_part"))).select(*by, "field", "token_id")


def normal_box(box: list[Column], scale: Column, x_offset: Column, y_offset: Column, width: Column, height: Column) -> Column:
    """A box in pixels of a scaled and cut view as parts of the whole page, held within it."""
    def part(v: Column, offset: Column, size: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (offset + v / scale) / size))

    return F.array(part(box[0], x_offset, width), part(box[1], y_offset, height), part(box[2], x_offset, width), part(box[3], y_offset, height))


#: Names of columns of a table without rules, which of them hold figures, and what ends the table.
GRID = {
    "line_no": ("sr", "sno", "sl", "serial"), "description": ("description", "particulars", "item", "product"), "hsn_sac": ("hsn", "sac"), "quantity": ("qty", "quantity"),
    "unit_price": ("rate", "price"), "tax_rate": ("gst", "tax"), "taxable_value": ("amount", "taxable"), "cgst": ("cgst",), "sgst": ("sgst",), "igst": ("igst",), "cess": ("cess",), "line_total": ("total", "value"),
}
WORDS_ONLY = ("description", "hsn_sac")
ENDS = r"(?i)\b(?:subtotal|grand total|net payable|amount payable|round off)\b"


def column_grid(words: DataFrame, by: list[str]) -> DataFrame:
    """by, line_id and cells of a table that only the places of its words show: below the first line with three known column names,
    down to a subtotal.

    words: by, line_id (from top to bottom), token_id, text, x0, x1. Each word goes to the nearest column: by its right edge where
    the column holds figures, else by its centre. The first row holds the names.
    """
    known = {a: f for f, names in reversed(GRID.items()) for a in names}
    field = F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.regexp_replace(F.lower("text"), "[^a-z0-9]+", ""))
    x = words.withColumns({"field": field, "x": (F.col("x0") + F.col("x1")) / 2})
    heads = x.where("field is not null").groupBy(*by, "line_id").agg(F.size(F.collect_set("field")).alias("n"), F.array_sort(F.collect_list(F.struct("x", "field", "text"))).alias("heads")).where("n >= 3")
    heads = heads.groupBy(*by).agg(F.min("line_id").alias("head_line"), F.min_by("heads", "line_id").alias("heads"))
    lines = _strings(words, [*by, "line_id"])
    end = lines.join(heads.select(*by, "head_line"), by).where((F.col("line_id") > F.col("head_line")) & F.col("line").rlike(ENDS)).groupBy(*by).agg(F.min("line_id").alias("end_line"))
    below = x.drop("field").join(heads, by).join(end, by, "left").where((F.col("line_id") > F.col("head_line")) & (F.col("end_line").isNull() | (F.col("line_id") < F.col("end_line"))) & (F.trim("text") != ""))
    gaps = F.transform("heads", lambda h, i: F.struct(F.abs(F.when(h["field"].isin(*WORDS_ONLY), F.col("x")).otherwise(F.col("x1")) - h["x"]).alias("gap"), i.alias("i")))
    below = below.withColumn("at", F.array_min(gaps)["i"])
    row = below.groupBy(*by, "line_id", "heads").agg(F.array_sort(F.collect_list(F.struct("x0", "token_id", "text", "at"))).alias("w"))
    cells = F.transform("heads", lambda h, i: F.array_join(F.transform(F.filter("w", lambda t: t["at"] == i), lambda t: F.trim(t["text"])), " "))
    names = heads.select(*by, F.col("head_line").alias("line_id"), F.transform("heads", lambda h: h["text"]).alias("cells"))
    return names.union(row.select(*by, "line_id", cells.alias("cells")))


#: Marks that a reader of handwriting leaves where it could not read.
NOISE = ("%math%", "%NA%", "%SC%", "%unclear%")


def noisy(text: Column) -> Column:
    """Whether a line has a mark of an unclear place."""
    return F.exists(F.array(*[F.lit(m) for m in NOISE]), lambda m: F.contains(text, m))


def noisy_lines(tokens: DataFrame, by: list[str]) -> DataFrame:
    """by and noisy: whether any token of a line has such a mark."""
    return tokens.groupBy(*by).agg(F.max(noisy(F.col("text"))).alias("noisy"))


def heuristic_score(confidence: Column, height: Column, baseline: Column, blue: Column) -> Column:
    """How much a line looks handwritten, from features of 0 to 1: their mean, with that of the ink's colour where it is known."""
    known = F.when(blue.isNull(), 3).otherwise(4)
    total = confidence + height + baseline + F.coalesce(F.when(blue > 0.5, 1.0).otherwise(0.0), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / known))


def line_kind(score: Column) -> Column:
    return F.when(score >= 0.55, "handwritten").when(score >= 0.40, "mixed").otherwise("printed")


def classified(tokens: DataFrame, scores: DataFrame, by: list[str]) -> DataFrame:
    """Tokens with the kind of their line; the confidence of handwritten ones is 0.80 at most. scores: by, score."""
    x = tokens.join(scores.select(*by, line_kind(F.col("score")).alias("kind")), by, "left")
    return x.withColumn("conf", F.when(F.col("kind") == "handwritten", F.least("conf", F.lit(0.80))).otherwise(F.col("conf")))


def input_kind(pages: DataFrame, key: str) -> DataFrame:
    """key and input_kind: of an image by its share of handwriting, of other files by the kinds of their pages.

    pages: key, is_image, kind (digital, scanned, mixed or skipped), handwriting (0 to 1).
    """
    kinds = F.array_remove(F.array_sort(F.collect_set("kind")), "skipped")
    g = pages.groupBy(key).agg(F.max("is_image").alias("img"), F.max("handwriting").alias("hw"), kinds.alias("kinds"))
    image = F.when(F.col("hw") < 0.15, "image_printed").when(F.col("hw") >= 0.5, "image_handwritten").otherwise("image_mixed")
    paper = F.when(F.col("kinds") == F.array(F.lit("digital")), "pdf_digital").when(F.col("kinds") == F.array(F.lit("scanned")), "pdf_scanned").otherwise("pdf_mixed")
    return g.select(key, F.when(F.col("img"), image).otherwise(paper).alias("input_kind"))
