import io
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docledger.operators import export
from docledger.sources import files, tabular


def load(spark, tmp_path, **contents):
    for name, data in contents.items():
        (tmp_path / name.replace("__", ".")).write_bytes(data if isinstance(data, bytes) else data.encode())
    return files.cells(files.scan(spark, str(tmp_path))).cache()


def run(spark, tmp_path, **contents):
    cells = load(spark, tmp_path, **contents)
    found = tabular.sheets(cells)
    table = tabular.rows(cells, found)
    return found, table, tabular.lines(table), tabular.records(table)


HEAD = "Invoice No,Invoice Date,Supplier GSTIN,Description,HSN,Qty,Unit Price,Taxable Value,CGST Rate,SGST Rate,Line Total,Invoice Total,Unknown\n"


def test_totals_row_and_extra(spark, tmp_path):
    _, table, lines, records = run(spark, tmp_path, a__csv=HEAD + "INV-1,2025-01-02,27AAPFU0939F1ZV,Widget,8471,1,100,100,9%,9%,118,118,keep-me\nTotal,,,,,,,90,,,,118,\n")
    line, record = lines.collect(), records.collect()
    assert len(line) == 1 and len(record) == 1 and record[0].number == "INV-1" and record[0].taxable_value == Decimal("90.00") and record[0].invoice_total == Decimal("118.00")
    assert line[0].tax_rate == 18 and line[0].extra["Unknown"] == "keep-me" and line[0].taxable_value == 100


def test_wrapped_repeated_blank(spark, tmp_path):
    text = "Invoice No,Description,HSN,Taxable Value\nINV-1,Short,8471,5\n,Long continuation,,\nInvoice No,Description,HSN,Taxable Value\nINV-2,Other,8471,6\n,,,\n,,,\n,,,\nINV-3,Cut,8471,7\n"
    _, table, lines, records = run(spark, tmp_path, a__csv=text)
    assert sorted(r.number for r in records.collect()) == ["INV-1", "INV-2"]
    assert {r.invoice_no: r.description for r in lines.collect()} == {"INV-1": "Short Long continuation", "INV-2": "Other"}


def test_encoding_and_quoted_newline(spark, tmp_path):
    text = 'Invoice No;Description;HSN;Taxable Value\nINV-1;"one\ntwo é";00123;5\n'.encode("cp1252")
    _, table, lines, _ = run(spark, tmp_path, a__csv=text)
    r = lines.collect()[0]
    assert r.description == "one\ntwo é" and r.hsn_sac == "000123" and table.collect()[0].source_ref == "Sheet1!R2"


def test_fill_forward_and_fractions(spark, tmp_path):
    text = "Invoice No,Description,CGST Rate,SGST Rate,Taxable Value\nA-1,x,0.09,9%,10\n,y,0.09,9%,20\n"
    _, table, lines, _ = run(spark, tmp_path, a__csv=text)
    assert [(r.invoice_no, r.tax_rate) for r in lines.orderBy("line").collect()] == [("A-1", 18), ("A-1", 18)]
    assert [r.code for r in tabular.warnings(table).collect()] == ["INVOICE_NUMBER_INHERITED"]


def test_preamble_and_two_tier_header(spark, tmp_path):
    text = "Invoice No:,INV-B,,\nSupplier: Acme,,,\nDescription,HSN,Qty,Taxable Value\nWidget,8471,2,50\n"
    _, _, lines, records = run(spark, tmp_path, a__csv=text)
    r = records.collect()[0]
    assert r.number == "INV-B" and r.supplier_name == "Acme"
    assert tabular.find_header([["Invoice No", "Description", "CGST", "SGST"], ["", "", "Rate", "Rate"]])[1] == ["Invoice No", "Description", "CGST Rate", "SGST Rate"]


def test_bad_files(spark, tmp_path):
    with pytest.raises(files.BadFile, match="EMPTY_FILE"):  # file scans leave empty files out
        files.detect(b"")
    cells = load(spark, tmp_path, z__xlsx=b"PK\x03\x04not a zip", p__csv=b"%PDF-1.4 ...", o__xls=b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")
    got = sorted((r.path.rpartition("/")[2], r.code) for r in cells.where("code is not null").collect())
    assert got == [("o.xls", "UNSUPPORTED_FORMAT"), ("p.csv", "DOC_PROCESSOR_UNAVAILABLE"), ("p.csv", "FORMAT_MISMATCH"), ("z.xlsx", "CORRUPT_FILE")]
    kinds = {r.filename: r.k for r in files.scan(spark, str(tmp_path)).select("filename", files.magic(F.col("content")).alias("k")).collect()}
    assert kinds == {"z.xlsx": "zip", "p.csv": "pdf", "o.xls": "ole"}


def book(sheet: str, extra: str = "", prop: str = "") -> bytes:
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">{prop}<sheets><sheet name="S" r:id="r1"/>{extra}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/><Relationship Id="r2" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {m}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {m}>{sheet}</worksheet>")
    return out.getvalue()


def test_xlsx():
    def cell(ref, v):
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    sheet = '<cols><col min="3" max="3" hidden="1"/></cols><sheetData><row r="1">' + cell("A1", "a") + cell("B1", "b") + cell("C1", "c") + '</row><row r="2" hidden="1">' + cell("A2", "no") + '</row><row r="3"><c r="A3" s="1"><v>366</v></c><c r="B3"><f>SUM(1,2)</f></c></row><row r="4"><c r="A4"><v>5.0</v></c></row></sheetData><mergeCells><mergeCell ref="A4:B5"/></mergeCells>'
    rows, warned = files.xlsx_rows(book(sheet, '<sheet name="H" state="hidden" r:id="r2"/>', '<workbookPr date1904="1"/>'))
    assert rows == [("S", 1, ["a", "b"]), ("S", 3, ["1905-01-01", ""]), ("S", 4, ["5", "5"]), ("S", 5, ["5", "5"])]
    assert sorted(warned) == [("FORMULAS_NOT_CALCULATED", "S!B3"), ("HIDDEN_CONTENT_IGNORED", "H"), ("HIDDEN_CONTENT_IGNORED", "S")]


def test_archive_limits(monkeypatch):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", b"0" * (3 << 20))
    with pytest.raises(files.BadFile) as e:
        files.detect(out.getvalue())
    assert e.value.code == "FILE_TOO_LARGE"


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("INV-1", Decimal("118.00"), "valid", "pending", [("=1+1", "8471")]), ("INV-2", None, "failed", "approved", [])], "invoice_no string, total_amount decimal(18,2), status string, review_state string, lines array<struct<description:string,hsn_sac:string>>")
    flat = export.flatten(export.exportable(df))
    rows = export.safe(flat).orderBy("invoice_no").collect()
    assert [(r.invoice_no, r.description, r.invoice_total) for r in rows] == [("INV-1", "'=1+1", "118.00"), ("INV-2", "", "")] and flat.columns == export.FLAT_COLUMNS
    export.write_csv(flat, str(tmp_path / "out"))
    export.write_xlsx(str(tmp_path / "o.xlsx"), {"Invoices": df.select("invoice_no", "status"), "LineItems": export.safe(flat)})
    back, _ = files.xlsx_rows((tmp_path / "o.xlsx").read_bytes())
    assert back[1][2] == ["INV-1", "valid"]
    with pytest.raises(ValueError):
        export.write_xlsx(str(tmp_path / "p.xlsx"), {"a": df.select("status")}, most_rows=1)
