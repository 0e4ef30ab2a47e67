"""Exports: flat rows, checks, documents, and a workbook."""

from __future__ import annotations

import datetime as dt
import zipfile
from decimal import Decimal
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.functions.text import formula_safe
from docledger.operators import results

#: The columns of the flat export, in order.
FLAT_COLUMNS = "invoice_no invoice_date supplier_name supplier_gstin buyer_name buyer_gstin place_of_supply line_no description hsn_sac quantity unit unit_price discount taxable_value tax_rate cgst sgst igst cess line_total invoice_total source_sheet source_row extra".split()


def exportable(records: DataFrame, everything: bool = False) -> DataFrame:
    """All, or what is not rejected and either valid or approved."""
    return records if everything else records.where("coalesce(review_state, '') <> 'rejected' and (status = 'valid' or review_state = 'approved')")


def flatten(records: DataFrame) -> DataFrame:
    """A row for each line (`lines`: array of struct), or one blank line; a line's value wins over the header's, blank too.

    All columns of FLAT_COLUMNS as text, missing ones empty.
    """
    lines = records.withColumn("_l", F.explode_outer("lines"))
    fields = {f.name for f in records.schema["lines"].dataType.elementType.fields}
    heads = set(records.columns)

    def col(name: str):
        if name in fields:
            return F.coalesce(F.col(f"_l.{name}").cast("string"), F.lit(""))
        source = "total_amount" if name == "invoice_total" else name
        return F.coalesce(F.col(source).cast("string"), F.lit("")) if source in heads else F.lit("")

    return lines.select(*[col(c).alias(c) for c in FLAT_COLUMNS])


def safe(flat: DataFrame) -> DataFrame:
    return flat.select(*[formula_safe(F.col(c)).alias(c) for c in flat.columns])


def documents(records: DataFrame, exported_at: str) -> DataFrame:
    """One JSON envelope for each record, for tables of any size; results.envelopes() has one envelope with documents[] for each group."""
    return records.select(F.to_json(F.struct(F.lit("1.0").alias("export_version"), F.lit(exported_at).alias("exported_at"), F.struct(*records.columns).alias("document"))).alias("json"))


def write_json(records: DataFrame, path: str, exported_at: str) -> None:
    documents(records, exported_at).write.mode("overwrite").text(path)


BOM = "\ufeff"


def write_csv(flat: DataFrame, path: str) -> None:
    """Safe flat rows as CSV with a header and CRLF, in as many files as partitions; each begins with a byte order mark, as
    spreadsheets expect of UTF-8.
    """
    rows = safe(flat)
    named = rows.select(F.col(rows.columns[0]).alias(BOM + rows.columns[0]), *rows.columns[1:])
    named.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("quoteAll", False).option("encoding", "UTF-8").csv(path)


def typed(name: str):
    """A flat column as date or decimal where its text is one."""
    c = F.col(name)
    if name.endswith("_date"):
        return F.try_to_date(c, "yyyy-MM-dd")
    if name in ("quantity", "unit_price", "discount", "taxable_value", "tax_rate", "cgst", "sgst", "igst", "cess", "line_total", "invoice_total"):
        return F.when(c.rlike("^-?\\d+(\\.\\d+)?$"), c.try_cast("decimal(24,4)"))
    return formula_safe(c)


#: Columns that hold money in a workbook, and the fill of a row by its status.
MONEY_COLUMNS = ("subtotal", "discount", "taxable_value", "cgst", "sgst", "igst", "cess", "total_tax", "round_off", "total_amount", "invoice_total", "unit_price", "line_total")
FILLS = {"needs_review": "FCE4D6", "failed": "FCE4D6", "valid_with_warnings": "FFF2CC"}
#: Styles of a workbook: plain, header, money, date; then the same but for the header with each fill.
_FORMATS = ("", "", "#,##0.00", "yyyy-mm-dd")
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _styles() -> str:
    fills = sorted(set(FILLS.values()))
    xfs = [f'<xf numFmtId="{n}" fontId="{f}" fillId="{fill}" borderId="0" xfId="0" applyNumberFormat="1" applyFont="1" applyFill="1"/>' for fill in (0, *range(2, 2 + len(fills))) for n, f in ((0, 0), (0, 1), (164, 0), (165, 0))]
    return (
        f'<?xml version="1.0"?><styleSheet {_NS}><numFmts count="2"><numFmt numFmtId="164" formatCode="{_FORMATS[2]}"/><numFmt numFmtId="165" formatCode="{_FORMATS[3]}"/></numFmts>'
        '<fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts>'
        f'<fills count="{2 + len(fills)}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
        + "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in fills)
        + f'</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(xfs)}">{"".join(xfs)}</cellXfs></styleSheet>'
    )


def _style(column: str, value, status: str | None) -> int:
    fill = 4 * (1 + sorted(set(FILLS.values())).index(FILLS[status])) if status in FILLS else 0
    return fill + (3 if isinstance(value, dt.date) else 2 if column in MONEY_COLUMNS and isinstance(value, (int, float, Decimal)) else 0)


def _cell(value, style: int) -> str:
    mark = f' s="{style}"' if style else ""
    if value is None:
        return f"<c{mark}/>"
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return f"<c{mark}><v>{(value - dt.date(1899, 12, 30)).days}</v></c>"
    if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        return f"<c{mark}><v>{value}</v></c>"
    return f'<c t="inlineStr"{mark}><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _sheet(df: DataFrame) -> str:
    """A sheet with a bold header that stays in view, a filter, widths after the longest text, and rows filled by their validation_status."""
    columns = df.columns
    at = columns.index("validation_status") if "validation_status" in columns else None
    widths, rows = [len(c) for c in columns], []
    for r in df.toLocalIterator():
        widths = [max(w, len(str("" if v is None else v))) for w, v in zip(widths, r)]
        rows.append("<row>" + "".join(_cell(v, _style(c, v, r[at] if at is not None else None)) for c, v in zip(columns, r)) + "</row>")
    head = "<row>" + "".join(_cell(c, 1) for c in columns) + "</row>"
    cols = "".join(f'<col min="{i}" max="{i}" width="{min(48, max(12, w + 2))}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    return (
        f'<?xml version="1.0"?><worksheet {_NS}><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols>{cols}</cols>'
        f'<sheetData>{head}{"".join(rows)}</sheetData><autoFilter ref="A1:{_letters(len(columns))}{len(rows) + 1}"/></worksheet>'
    )


def write_xlsx(path: str, sheets: dict[str, DataFrame], most_rows: int = 200_000) -> None:
    """A workbook on the driver: a report of bounded size. A sheet of more than `most_rows` rows fails rather than being cut."""
    names = list(sheets)
    package, office = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in range(1, len(names) + 1))
    rels = "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
    listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships">{rels}<Relationship Id="rId{len(names) + 1}" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {_NS} xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/styles.xml", _styles())
        for i, name in enumerate(names, 1):
            if sheets[name].limit(most_rows + 1).count() > most_rows:
                raise ValueError(f"{name} has more than {most_rows} rows")
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(sheets[name]))


def workbook(records: DataFrame, key: str) -> dict[str, DataFrame]:
    """The five sheets of a report: Invoices, LineItems, Validation, Corrections and Audit.

    records: key, header columns, lines, status, score, review_state, overall, checks, corrections and history.
    """
    nested = ("lines", "checks", "corrections", "history", "status", "score", "review_state", "overall", key)
    heads = sorted(c for c in records.columns if c not in nested)
    flat = flatten(records)
    invoices = records.select(*[c if c not in FLAT_COLUMNS else typed(c).alias(c) for c in heads], F.col("status").alias("validation_status"), "score", "review_state", F.col("overall").alias("overall_confidence"))
    text = lambda df: df.drop("pos").select(*[formula_safe(F.col(c).cast("string")).alias(c) for c in df.columns if c != "pos"])
    return {
        "Invoices": invoices, "LineItems": flat.select(*[typed(c).alias(c) for c in FLAT_COLUMNS]), "Validation": text(results.check_table(records, key)),
        "Corrections": text(results.correction_table(records, key)), "Audit": text(results.audit_table(records, key)),
    }
