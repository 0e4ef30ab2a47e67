"""Plug-in readers of what needs libraries of its own: pages of PDF files, pixels, codes, and vision models.

A reader is an object that can be pickled, with the method that its protocol names. It runs in Arrow batches, next to the
files; what it cannot read becomes a row with a code, never a failed task. Without a reader every file gives one row with
DOC_PROCESSOR_UNAVAILABLE.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.operators.fields import allowed_output

#: Limits: pages of a file, pixels of an image and of its longer edge, raster resolution and edge, confidence of read text, pages and hint characters of a model's call.
MOST_PAGES, MOST_PIXELS, MOST_EDGE, DPI, RASTER_EDGE, MOST_SURE, MODEL_PAGES, MODEL_HINT = 100, 50_000_000, 10_000, 300, 3500, 0.97, 3, 24_000
NONE = "DOC_PROCESSOR_UNAVAILABLE"


class ReadError(Exception):
    """A file that a reader cannot take: a code and what is wrong."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(code)
        self.code, self.message = code, message


class PageReader(Protocol):
    """PDF files. pages(): (page, text, chars, garbled, image share); words(): (page, text, x0, y0, x1, y1); tables():
    (page, table, row, cells); raster(): (page, width, height, encoded image)."""

    def pages(self, content: bytes, password: str | None) -> Iterable[tuple]: ...
    def words(self, content: bytes, password: str | None) -> Iterable[tuple]: ...
    def tables(self, content: bytes, password: str | None) -> Iterable[tuple]: ...
    def raster(self, content: bytes, password: str | None, dpi: int, most_edge: int) -> Iterable[tuple]: ...


class ImageReader(Protocol):
    """Images. load(): (width, height, upright image without transparency, encoded); prepare(): the image ready to be read."""

    def load(self, content: bytes) -> tuple[int, int, bytes]: ...
    def prepare(self, image: bytes) -> bytes: ...


class TextReader(Protocol):
    """Text in images. read(): (text, confidence, x0, y0, x1, y1 in parts of the image) for one view of it; angle 0, 90, 180 or 270."""

    def read(self, image: bytes, angle: int, tile: tuple[float, float, float, float]) -> Iterable[tuple]: ...


class CodeReader(Protocol):
    """Codes in images. decode(): (payload, x0, y0, x1, y1) of one view of it."""

    def decode(self, image: bytes, view: int) -> Iterable[tuple]: ...


class Extractor(Protocol):
    """A vision model. extract(): its answer as JSON, from page images and a hint text."""

    def extract(self, images: list[bytes], hint: str, fields: tuple[str, ...]) -> str: ...


PAGES = "page int, text string, chars long, garbled double, image double"
WORDS = "page int, token_id long, text string, x0 double, y0 double, x1 double, y1 double"
TABLES = "page int, table_no int, row int, cells array<string>"
RASTER = "page int, width int, height int, image binary"
IMAGE = "width int, height int, image binary"
TOKENS = "token_id long, angle int, text string, conf double, x0 double, y0 double, x1 double, y1 double"
CODES = "view int, payload string, x0 double, y0 double, x1 double, y1 double"


def _apply(files: DataFrame, key: str, columns: list[str], schema: str, read, reader: Any) -> DataFrame:
    """key, the columns of schema, code and message: what read(row) yields for each file, or one row that says why not."""
    names = [x.split()[0] for x in schema.split(", ")]
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                mine = getattr(row, key)
                if reader is None:
                    out.append((mine, *[None] * len(names), NONE, "no reader is installed"))
                    continue
                try:
                    out += [(mine, *x, None, None) for x in read(row)]
                except ReadError as e:
                    out.append((mine, *[None] * len(names), e.code, e.message))
                except Exception as e:
                    out.append((mine, *[None] * len(names), "READ_FAILED", type(e).__name__))
            yield pd.DataFrame(out, columns=[key, *names, "code", "message"], dtype=object)

    return files.select(key, *columns).mapInPandas(run, f"{key} {kind}, {schema}, code string, message string")


def _password(row) -> str | None:
    return getattr(row, "password", None)


def _held(rows: Iterable[tuple]) -> list[tuple]:
    rows = list(rows)
    if any(r[0] > MOST_PAGES for r in rows):
        raise ReadError("TOO_MANY_PAGES", f"more than {MOST_PAGES}")
    return rows


def pdf_pages(files: DataFrame, key: str, reader: PageReader | None) -> DataFrame:
    """A row for each page of each PDF file: its text and what its class follows from."""
    return _apply(files, key, ["content", *(["password"] if "password" in files.columns else [])], PAGES, lambda r: _held(reader.pages(r.content, _password(r))), reader)


def pdf_words(files: DataFrame, key: str, reader: PageReader | None) -> DataFrame:
    """The words of each page as tokens, numbered within a file."""
    return _apply(files, key, ["content"], WORDS, lambda r: [(p, i, *rest) for i, (p, *rest) in enumerate(_held(reader.words(r.content, _password(r))))], reader)


def pdf_tables(files: DataFrame, key: str, reader: PageReader | None) -> DataFrame:
    """The rows of the ruled tables of each page; tables of fewer than two rows or three columns are none."""
    def read(r):
        rows = _held(reader.tables(r.content, _password(r)))
        size: dict = {}
        for p, t, _, cells in rows:
            n, w = size.get((p, t), (0, 0))
            size[p, t] = n + 1, max(w, len(cells))
        return [x for x in rows if size[x[0], x[1]][0] >= 2 and size[x[0], x[1]][1] >= 3]

    return _apply(files, key, ["content"], TABLES, read, reader)


def pdf_raster(files: DataFrame, key: str, reader: PageReader | None) -> DataFrame:
    """Each page as an image, at DPI, its longer edge held to RASTER_EDGE."""
    return _apply(files, key, ["content"], RASTER, lambda r: _held(reader.raster(r.content, _password(r), DPI, RASTER_EDGE)), reader)


def images(files: DataFrame, key: str, reader: ImageReader | None) -> DataFrame:
    """Each image upright and opaque, prepared for reading; too large a one is IMAGE_TOO_LARGE."""
    def read(r):
        width, height, image = reader.load(r.content)
        if max(width, height) > MOST_EDGE or width * height > MOST_PIXELS:
            raise ReadError("IMAGE_TOO_LARGE", f"{width} x {height}")
        return [(width, height, reader.prepare(image))]

    return _apply(files, key, ["content"], IMAGE, read, reader)


#: Views of an image: the whole, and its quarters for one longer than TILED pixels.
TILED, WHOLE = 2500, (0.0, 0.0, 1.0, 1.0)
QUARTERS = tuple((x, y, x + 0.5, y + 0.5) for y in (0.0, 0.5) for x in (0.0, 0.5))


def read_text(pages: DataFrame, key: str, reader: TextReader | None, angles: tuple[int, ...] = (0, 90, 180, 270)) -> DataFrame:
    """Tokens of images (key, width, height, image): at the angle that reads best, and in quarters too where the image is large.

    Boxes are in parts of the whole image; confidences are MOST_SURE at most. The best angle has the greatest weight (confidence
    times width) of tokens that lie flat; of ties the first. What two views read twice is left to spatial.suppress().
    """
    def one(r, angle, tile):
        x0, y0, x1, y1 = tile
        w, h = x1 - x0, y1 - y0
        return [(angle, t, min(float(c), MOST_SURE), x0 + a * w, y0 + b * h, x0 + p * w, y0 + q * h) for t, c, a, b, p, q in reader.read(r.image, angle, tile)]

    def read(r):
        whole = {a: one(r, a, WHOLE) for a in angles}
        best = max(angles, key=lambda a: (sum(c * (x1 - x0) for _, _, c, x0, y0, x1, y1 in whole[a] if x1 - x0 >= y1 - y0), -angles.index(a)))
        found = whole[best] + ([x for t in QUARTERS for x in one(r, best, t)] if max(r.width, r.height) > TILED else [])
        return [(i, *x) for i, x in enumerate(found)]

    return _apply(pages, key, ["width", "height", "image"], TOKENS, read, reader)


def read_codes(pages: DataFrame, key: str, reader: CodeReader | None, views: int = 5) -> DataFrame:
    """Payloads of codes in images, each once for an image: the first view that shows it counts."""
    def read(r):
        seen: set[str] = set()
        out = []
        for v in range(views):
            for payload, *box in reader.decode(r.image, v):
                if payload not in seen:
                    seen.add(payload)
                    out.append((v, payload, *box))
        return out

    return _apply(pages, key, ["image"], CODES, read, reader)


def ask_model(documents: DataFrame, key: str, extractor: Extractor | None, fields: tuple[str, ...]) -> DataFrame:
    """key, answer, code and message: a model's answer for each document (key, images array<binary>, hint); off without an extractor."""
    return _apply(documents, key, ["images", "hint"], "answer string", lambda r: [(extractor.extract([bytes(i) for i in r.images][:MODEL_PAGES], (r.hint or "")[:MODEL_HINT], fields),)], extractor)


def model_fields(answers: DataFrame, key: str, fields: tuple[str, ...], confidence: float = 0.75) -> DataFrame:
    """Hypotheses (key, field, value, confidence, source vlm) of the known fields with scalar values in the answers."""
    told = answers.where("answer is not null").select(key, F.explode(allowed_output(F.get_json_object("answer", "$.invoice"), fields)).alias("field", "value"))
    return told.where("value is not null").select(key, "field", "value", F.lit(confidence).alias("confidence"), F.lit("vlm").alias("source"))

