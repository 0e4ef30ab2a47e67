"""Files as rows: what they are by content, and their cells. A file that cannot be read becomes an error row, never a failed task."""

from __future__ import annotations

import csv
import datetime as dt
import io
import posixpath
import re
import unicodedata
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Limits: bytes of a file, rows and sheets; of an archive its expanded bytes at intake and for the reader, members and ratio; files of an upload.
MOST_BYTES, MOST_ROWS, MOST_SHEETS, MOST_EXPANDED, READER_EXPANDED, MOST_MEMBERS, MOST_RATIO, MOST_FILES = 25 << 20, 200_000, 20, 100 << 20, 200 << 20, 10_000, 200, 10
DELIMITERS = ",;\t|"


class BadFile(Exception):
    """A file that cannot be taken: a code and what is wrong."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(code)
        self.code, self.message = code, message


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, filename, extension, length, sha256 and content of the files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.select("path", name.alias("filename"), F.lower(F.regexp_extract("path", "\\.([^./]*)$", 1)).alias("extension"), "length", F.sha2("content", 256).alias("sha256"), "content")


def magic(content: Column) -> Column:
    """The kind that the first bytes tell: pdf, jpeg, png, zip, ole or unknown; empty if there are none."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(F.length(content) == 0, "empty").when(head.startswith("255044462D"), "pdf").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("504B0304"), "zip").when(head.startswith("D0CF11E0A1B11AE1"), "ole").otherwise("unknown")
    )


def upload_errors(files: DataFrame, upload: str, order: str) -> DataFrame:
    """upload, path and code of files that an upload may not hold: larger than MOST_BYTES, or beyond the first MOST_FILES."""
    nth = F.row_number().over(Window.partitionBy(upload).orderBy(order))
    code = F.when(nth > MOST_FILES, "TOO_MANY_FILES").when(F.col("length") > MOST_BYTES, "FILE_TOO_LARGE")
    return files.withColumn("code", code).where("code is not null").select(upload, "path", "code")


def _unzip(raw: bytes, reader: bool = False) -> zipfile.ZipFile:
    """An archive within the limits of intake, or of the reader."""
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
        infos = z.infolist()
    except zipfile.BadZipFile as e:
        raise BadFile("CORRUPT_FILE", "not a readable archive") from e
    if reader and sum(i.file_size for i in infos) > READER_EXPANDED:
        raise BadFile("ARCHIVE_TOO_LARGE", "the workbook expands too far")
    if not reader and (len(infos) > MOST_MEMBERS or sum(i.file_size for i in infos) > MOST_EXPANDED or any(i.file_size > 1 << 20 and i.file_size > MOST_RATIO * max(1, i.compress_size) for i in infos)):
        raise BadFile("FILE_TOO_LARGE", "the archive expands too far")
    if any(i.filename.startswith("/") or ".." in i.filename.split("/") for i in infos):
        raise BadFile("ARCHIVE_UNSAFE", "a member points outside")
    return z


def detect(raw: bytes) -> str:
    """csv, xlsx, pdf, jpeg or png; raises BadFile for anything else."""
    if not raw:
        raise BadFile("EMPTY_FILE")
    for start, kind in ((b"%PDF-", "pdf"), (b"\xff\xd8\xff", "jpeg"), (b"\x89PNG\r\n\x1a\n", "png")):
        if raw.startswith(start):
            return kind
    if raw.startswith(b"PK\x03\x04"):
        if "xl/workbook.xml" in _unzip(raw).namelist():
            return "xlsx"
        raise BadFile("UNSUPPORTED_FORMAT", "an archive, but no workbook")
    if raw.startswith(b"\xd0\xcf\x11\xe0") or b"\0" in raw[:8192] and not charset(raw).startswith("utf-16"):
        raise BadFile("UNSUPPORTED_FORMAT")
    text = decode(raw[: 1 << 16])
    if max(_fit(text, d)[0] for d in DELIMITERS) < 2:
        raise BadFile("UNSUPPORTED_FORMAT", "no delimited text")
    return "csv"


#: Character sets that are tried for texts that are neither marked nor UTF-8, in this order among equals.
CHARSETS = ("cp1252", "cp1251", "cp1253", "cp1255", "cp1256", "gb18030", "big5", "shift_jis", "euc_kr")


#: Vowels of scripts whose character sets take each other's letters for their own, and the share of letters that they are at least.
VOWELS, VOWEL_SHARE = {"GREEK": "αεηιουωάέήίόύώ", "CYRILLIC": "аеёиоуыэюяіїє"}, 0.35


def _plausible(text: str) -> float:
    """How well the characters beyond ASCII of a decoded text go together: the share that are letters next to a letter of their script,
    less where too few of these are vowels.
    """
    beyond = [i for i, c in enumerate(text) if c > "\x7f"]
    if not beyond:
        return 0.0
    kind = lambda c: unicodedata.name(c, "").split(" ")[0] if c.isalpha() else ""
    fits = 0
    for i in beyond:
        near = [kind(text[j]) for j in (i - 1, i + 1) if 0 <= j < len(text)]
        fits += bool(kind(text[i])) and kind(text[i]) in near and not (kind(text[i]) == "LATIN" and all(j > "\x7f" for j in text[max(0, i - 1) : i + 2]))
    weight = 1.0
    for script, vowels in VOWELS.items():
        letters = [c for c in text.lower() if c > "\x7f" and kind(c) == script]
        if len(letters) > len(beyond) / 2:
            weight = min(1.0, sum(c in vowels for c in letters) / len(letters) / VOWEL_SHARE)
    return fits / len(beyond) * weight


def charset(raw: bytes) -> str:
    """The character set of a text: by its mark; UTF-16 by its zero bytes; UTF-8 (a cut last character aside); else the one of
    CHARSETS whose letters go together best.
    """
    if raw.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    if raw.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "utf-16"
    head = raw[:4096]
    for at, name in ((1, "utf-16-le"), (0, "utf-16-be")):
        if len(head) >= 8 and head[at::2].count(0) > 0.6 * (len(head) // 2) and head[1 - at :: 2].count(0) < 0.1 * (len(head) // 2):
            return name
    for cut in range(4):
        try:
            raw[: len(raw) - cut].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError:
            pass
    best = ("cp1252", 0.0)
    for name in CHARSETS:
        try:
            score = _plausible(raw[: 1 << 16].decode(name))
        except UnicodeDecodeError:
            continue
        if score > best[1] + 0.1:
            best = name, score
    return best[0]


def decode(raw: bytes) -> str:
    """A text in its character set; what does not fit is replaced."""
    name = charset(raw)
    text = raw.decode(name, "replace")
    return text[:-1] if name == "utf-8" and text.endswith("\ufffd") else text


def _fit(text: str, delimiter: str) -> tuple[int, int]:
    """(rows of the commonest width, that width) among the first 50 rows; (0, 0) if it is one."""
    widths = []
    try:
        for row in csv.reader(io.StringIO(text[:65536], newline=""), delimiter=delimiter):
            if any(c.strip() for c in row):
                widths.append(len(row))
            if len(widths) == 50:
                break
    except csv.Error:
        return 0, 0
    common = max(sorted(set(widths)), key=widths.count, default=1)
    return (widths.count(common), common) if common > 1 else (0, 0)


def delimiter_of(text: str) -> str:
    return max(DELIMITERS, key=lambda d: _fit(text, d))


def csv_rows(raw: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, physical line, cells): quoted line breaks stay in cells, and a row is where it starts."""
    text = decode(raw)
    reader, out, line = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter_of(text)), [], 0
    try:
        for row in reader:
            out.append(("Sheet1", line + 1, row))
            line = reader.line_num
            if len(out) > MOST_ROWS:
                raise BadFile("TOO_MANY_ROWS")
    except csv.Error as e:
        raise BadFile("CORRUPT_FILE", str(e)) from e
    return out


MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that are dates.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _at(ref: str) -> tuple[int, int]:
    letters, row = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(row), col


def xlsx_rows(raw: bytes) -> tuple[list[tuple[str, int, list[str]]], list[tuple[str, str]]]:
    """(rows as of csv_rows, warnings (code, where)): visible sheets, rows and columns; merged cells filled from their first."""
    z, rows, warnings = _unzip(raw, reader=True), [], []
    try:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        names = z.namelist()
        strings = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")) for f in styles.iter(f"{MAIN}numFmt") if re.search(r"[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
            xfs = styles.find(f"{MAIN}cellXfs")
            dates = {i for i, x in enumerate(xfs if xfs is not None else []) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}
        props = book.find(f"{MAIN}workbookPr")
        epoch = dt.datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
        sheets = book.findall(f"{MAIN}sheets/{MAIN}sheet")
        if len(sheets) > MOST_SHEETS:
            raise BadFile("TOO_MANY_SHEETS")
        for sheet in sheets:
            title = sheet.get("name")
            if sheet.get("state", "visible") != "visible":
                warnings.append(("HIDDEN_CONTENT_IGNORED", title))
                continue
            target = rels[sheet.get(REL)]
            root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))))
            hidden_cols = {i for c in root.iter(f"{MAIN}col") if c.get("hidden") in ("1", "true") for i in range(int(c.get("min")), int(c.get("max")) + 1)}
            grid: dict[int, dict[int, str]] = {}
            hidden_rows: set[int] = set()
            last = 0
            for r in root.iter(f"{MAIN}row"):
                last = int(r.get("r", last + 1))
                if last > MOST_ROWS:
                    raise BadFile("TOO_MANY_ROWS")
                if r.get("hidden") in ("1", "true"):
                    hidden_rows.add(last)
                col = 0
                for c in r.findall(f"{MAIN}c"):
                    col = _at(c.get("r"))[1] if c.get("r") else col + 1
                    v, f, kind = c.find(f"{MAIN}v"), c.find(f"{MAIN}f"), c.get("t")
                    text = "" if v is None else v.text or ""
                    if kind == "s" and text:
                        text = strings[int(text)]
                    elif kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                    elif kind == "b":
                        text = "True" if text == "1" else "False"
                    elif kind in (None, "n") and text:
                        if int(c.get("s", 0)) in dates:
                            when = epoch + dt.timedelta(days=float(text))
                            text = when.date().isoformat() if when.time() == dt.time() else when.isoformat()
                        elif re.fullmatch(r"-?\d+\.0+", text):
                            text = text.partition(".")[0]
                    if f is not None and v is None:
                        warnings.append(("FORMULAS_NOT_CALCULATED", f"{title}!{c.get('r')}"))
                    grid.setdefault(last, {})[col] = text
            for m in root.iter(f"{MAIN}mergeCell"):
                a, _, b = m.get("ref").partition(":")
                (r0, c0), (r1, c1) = _at(a), _at(b or a)
                value = grid.get(r0, {}).get(c0, "")
                for r in range(r0, min(r1, MOST_ROWS) + 1):
                    for c in range(c0, c1 + 1):
                        if not grid.setdefault(r, {}).get(c):
                            grid[r][c] = value
            if hidden_rows or hidden_cols:
                warnings.append(("HIDDEN_CONTENT_IGNORED", title))
            width = max((max(g, default=0) for g in grid.values()), default=0)
            rows += [(title, r, [grid[r].get(c, "") for c in range(1, width + 1) if c not in hidden_cols]) for r in sorted(grid) if r not in hidden_rows]
    except (KeyError, ElementTree.ParseError, ValueError, IndexError) as e:
        raise BadFile("CORRUPT_FILE", type(e).__name__) from e
    return rows, warnings


SHAPE = "path string, sha256 string, kind string, sheet string, row int, cells array<string>, code string, message string"


def cells(files: DataFrame) -> DataFrame:
    """A row for each row of each spreadsheet (code null), and for each warning or error (cells null). files: as of scan()."""

    def read(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                kind = None
                try:
                    if r.length > MOST_BYTES:
                        raise BadFile("FILE_TOO_LARGE")
                    kind = detect(r.content)
                    if kind == "csv":
                        out += [(r.path, r.sha256, kind, s, n, c, None, None) for s, n, c in csv_rows(r.content)]
                    elif kind == "xlsx":
                        rows, warned = xlsx_rows(r.content)
                        out += [(r.path, r.sha256, kind, s, n, c, None, None) for s, n, c in rows]
                        out += [(r.path, r.sha256, kind, None, None, None, code, where) for code, where in warned]
                    else:
                        out.append((r.path, r.sha256, kind, None, None, None, "DOC_PROCESSOR_UNAVAILABLE", "no reader for this kind is installed"))
                    if r.extension not in {"csv": ("csv", "txt", "tsv"), "jpeg": ("jpg", "jpeg")}.get(kind, (kind,)):
                        out.append((r.path, r.sha256, kind, None, None, None, "FORMAT_MISMATCH", r.extension))
                except BadFile as e:
                    out.append((r.path, r.sha256, kind, None, None, None, e.code, e.message))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SHAPE.split(", ")]).astype({"row": "Int32"})

    return files.select("path", "sha256", "extension", "length", "content").mapInPandas(read, SHAPE)
