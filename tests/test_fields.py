"""Merged fields: one reading of the hypotheses."""

from pyspark.sql import functions as F

from docledger.operators import fields

SAID = "k long, field string, value string, confidence double, source string, evidence string"


def test_merged_fields_in_one_reading(spark):
    rows = [
        (1, "total_amount", "Rs 5", 0.8, "rules", "a"), (1, "total_amount", "5.00", 0.75, "vlm", "b"), (1, "total_amount", "7", 0.5, "trocr", "c"),
        (1, "invoice_no", " A-1 ", 0.6, "rules", "d"), (2, "total_amount", "none", 0.9, "rules", "e"), (None, "invoice_no", "B", 0.9, "rules", "f"), (2, None, "B", 0.9, "rules", "g"),
    ]
    got = fields.merged_fields(spark.createDataFrame(rows, SAID), "k", F.lit("2026-06-01").cast("date"))
    assert {(r.k, r.field, r.value, r.raw, r.evidence, tuple(r.alternatives)) for r in got.collect()} == {(1, "total_amount", "5.00", "Rs 5", "a", ("7.00",)), (1, "invoice_no", "A-1", " A-1 ", "d", ())}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    conditions = [line for line in plan.splitlines() if "Filter" in line]
    assert plan.count("LogicalRDD") == 1 and max(map(len, conditions)) < 1000  # no condition holds all that a value is made of
