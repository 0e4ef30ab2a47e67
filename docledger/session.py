"""The engine's front: ingest, validate, match, review and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.operators import dedupe, export, jobs, validation
from docledger.operators import records as records_of
from docledger.sources import files, tabular


class Ledger:
    """Spreadsheets of a folder, and texts of documents, as invoices. All results are DataFrames; nothing runs before it is asked for."""

    def __init__(self, spark: SparkSession, as_of: str):
        self.spark, self.as_of = spark, as_of

    def ingest(self, path: str, pattern: str = "*") -> dict[str, DataFrame]:
        """records, lines, mapping, unmapped, warnings and errors of the files below a folder, and their cells.

        All of them read the cells, which are kept once they are first asked for: hand the result to release() when done.
        """
        cells = files.cells(files.scan(self.spark, path, pattern)).persist()
        found = tabular.sheets(cells)
        table = tabular.rows(cells, found)
        zipped = found.select("path", "sheet", F.explode(F.arrays_zip("headers", "names", "methods", "confidences")).alias("c"))
        columns = zipped.select("path", "sheet", F.col("c.headers").alias("source_column"), F.col("c.names").alias("canonical_column"), F.col("c.methods").alias("method"), F.col("c.confidences").alias("confidence"))
        records, lines = tabular.records(table), tabular.lines(table)
        noted = cells.where("code in ('HIDDEN_CONTENT_IGNORED', 'FORMULAS_NOT_CALCULATED', 'FORMAT_MISMATCH')").select("path", F.col("message").alias("source_ref"), "code")
        warned = tabular.warnings(table).unionByName(tabular.sheet_warnings(found)).unionByName(tabular.without_lines(records, lines)).unionByName(noted)
        return {
            "records": records,
            "lines": lines,
            "mapping": columns.where("canonical_column is not null"),
            "unmapped": columns.where("canonical_column is null").select("path", "sheet", "source_column"),
            "warnings": warned,
            "errors": cells.where("code is not null").select("path", "code", "message"),
            "cells": cells,
        }

    @staticmethod
    def release(ingested: dict[str, DataFrame]) -> None:
        """Frees what ingest() kept."""
        ingested["cells"].unpersist()

    def read_texts(self, docs: DataFrame, key: str = "doc_id", text: str = "text", model: DataFrame | None = None) -> dict[str, DataFrame]:
        """fields (one value each, with confidence and status), lines, headers and body (as the rules take them) of documents' texts."""
        return records_of.from_texts(docs, key, text, self.as_of, model)

    @staticmethod
    def shaped(records: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Ingested tables in the shape of the rules: a record is a path, sheet, number and supplier."""
        record = F.concat_ws("|", *tabular.KEY).alias("record")
        per = lines.groupBy(*tabular.KEY).agg(F.sum("cgst").alias("cgst"), F.sum("sgst").alias("sgst"), F.sum("igst").alias("igst"), F.sum("cess").alias("cess"), F.count("*").alias("n_lines"), F.sum("taxable_value").alias("s"))
        heads = records.join(per, tabular.KEY, "left").select(record, F.col("number").alias("invoice_no"), "invoice_date", "due_date", "document_type", F.col("supplier").alias("supplier_gstin"), "buyer_gstin", F.substring("place_of_supply", 1, 2).alias("pos"), F.coalesce("taxable_value", "s").alias("taxable"), "cgst", "sgst", "igst", "cess", "total_tax", F.col("invoice_total").alias("total"), "reverse_charge", "n_lines")
        body = lines.select(record, F.col("line").cast("int").alias("line_idx"), "quantity", "unit_price", "discount", F.col("taxable_value").alias("taxable"), F.col("tax_rate").alias("rate"), "cgst", "sgst", "igst", "cess", "line_total")
        return heads, body

    def validate(self, records: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(status of each record, all checks)."""
        heads, body = self.shaped(records, lines)
        return validation.validate(heads, body, self.as_of), validation.checks(heads, body, self.as_of)

    @staticmethod
    def match(keys: DataFrame) -> DataFrame:
        return dedupe.matches(keys)

    @staticmethod
    def review(events: DataFrame) -> tuple[DataFrame, DataFrame]:
        return jobs.review_fold(events)

    @staticmethod
    def export(records: DataFrame, path: str, exported_at: str, everything: bool = False) -> None:
        export.write_json(export.exportable(records, everything), path, exported_at)
