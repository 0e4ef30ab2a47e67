import random
from datetime import date
from decimal import Decimal

import pytest

from docledger.functions.similarity import indel
from docledger.operators import dedupe
from docledger.streaming import jobs

KEYS = "job_id string, doc_index int, sha256 string, supplier_gstin string, invoice_no_norm string, invoice_date date, total_amount decimal(18,2), supplier_name string"
DAY, SUM = date(2026, 1, 5), Decimal("118.00")
ROWS = [
    ("a", 0, "s1", None, "INV2026001", DAY, SUM, "ACMETRADERS"), ("b", 0, "s2", "", "INV2026007", DAY, SUM, "ACMETRADERS"), ("c", 0, "s3", "27AAPFU0939F1ZV", "INV2026001", DAY, SUM, "ACMETRADERS"),
    ("d", 0, "s4", "27AAPFU0939F1ZV", "INV2026001", DAY, None, "OTHER"), ("e", 0, "s4", None, "X1", None, None, None),
]
PAIRS = {("a", "b"): "near", ("c", "d"): "business_key", ("d", "e"): "exact_file"}


def test_matches_without_supplier(spark):
    got = {(r.a_job_id, r.b_job_id): r.kind for r in dedupe.matches(spark.createDataFrame(ROWS, KEYS)).collect()}
    assert got == PAIRS | {(b, a): k for (a, b), k in PAIRS.items()}


def test_incremental_matches(spark, tmp_path):
    source = spark.createDataFrame(ROWS, KEYS)
    source.where("job_id in ('a', 'b', 'c')").coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
        jobs.incremental_matches(stream, "keys", f"{tmp_path}/table", f"{tmp_path}/checkpoint", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
        source.where("job_id in ('d', 'e')").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = {tuple(sorted((r.a_job_id, r.b_job_id))) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == set(PAIRS)


def test_missing_totals_meet_all_once(spark):
    """Known totals meet near ones and missing ones, missing totals all; each pair comes once, from one reading of the table."""
    rows = [(n, 0, f"s{n}", "", f"INV202600{n}", DAY, total, "ACMETRADERS") for n, total in (("1", SUM), ("2", SUM + Decimal("0.01")), ("3", SUM + 1), ("4", None), ("5", None))]
    got = dedupe.near_without_supplier(spark.createDataFrame(rows, KEYS))
    pairs = [(r.a_job_id, r.b_job_id) for r in got.collect()]
    far = {("1", "3"), ("2", "3")}
    assert sorted(pairs) == sorted((a, b) for a in "12345" for b in "12345" if a != b and tuple(sorted((a, b))) not in far)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


@pytest.mark.parametrize("crowd", [0, 3, 100])
def test_names_are_compared_for_crowds_only(spark, monkeypatch, crowd):
    """Whatever a crowd is, the pairs are those of a plain loop; only documents of a crowded total have their names looked up."""
    rng, looked = random.Random(5), []
    totals = [None] + [SUM + Decimal(c) / 100 for c in (0, 0, 0, 1, 2, 500)]
    rows = [(f"j{i}", 0, f"s{i}", "", f"INV20260{rng.randrange(4)}{'X' * rng.randrange(3)}", DAY, rng.choice(totals), f"Supplier#0000{rng.randrange(12):05d}{' Ltd' * rng.randrange(2)}") for i in range(60)]
    rows += [(f"k{i}", 0, f"t{i}", "", "INV2026001", DAY, SUM + 10 + i, f"Lone#{i:09d}") for i in range(5)]
    kept = dedupe.similar_names

    def similar_names(a, b, least):
        looked.extend(r.name for r in a.collect())
        return kept(a, b, least)

    monkeypatch.setattr(dedupe, "CROWD", crowd, raising=False)
    monkeypatch.setattr(dedupe, "similar_names", similar_names)
    got = [(r.a_job_id, r.b_job_id) for r in dedupe.near_without_supplier(spark.createDataFrame(rows, KEYS)).collect()]
    close = lambda t, u: t is None or u is None or abs(t - u) <= Decimal("0.01")
    want = [(r[0], s[0]) for r in rows for s in rows if r[0] != s[0] and close(r[6], s[6]) and indel(r[4], s[4]) >= 85 and indel(r[7], s[7]) >= 90]
    assert sorted(got) == sorted(want) and len(want) > 100
    assert looked if crowd < 100 else not looked


def test_longest_numbers_alike_meet(spark):
    """Lengths of 51 and 69 are the farthest that are alike to 85; 18 and 22 of a name are just alike to 90."""
    rows = [("a", 0, "s1", "", "7" * 51, DAY, SUM, "Supplier#000000001"), ("b", 0, "s2", "", "7" * 69, DAY, SUM, "Supplier#000000001 Ltd")]
    assert {(r.a_job_id, r.b_job_id) for r in dedupe.near_without_supplier(spark.createDataFrame(rows, KEYS)).collect()} == {("a", "b"), ("b", "a")}


def test_exact_files_go_out_as_they_come(spark):
    """A pair of one file is exact whatever else it is; such pairs, the squares of a file's copies, are not grouped again."""
    rows = [(j, 0, s, "27AAPFU0939F1ZV", "INV1", DAY, SUM, "A") for j, s in (("a", "x"), ("b", "x"), ("c", "y"), ("d", None))]
    found = dedupe.matches(spark.createDataFrame(rows + rows[:1], KEYS))
    got = sorted((r.a_job_id, r.b_job_id, r.kind) for r in found.collect())
    assert got == sorted((a, b, "exact_file" if {a, b} == {"a", "b"} else "business_key") for a in "abcd" for b in "abcd" if a != b)
    top = found._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert top.startswith("Union")


def test_precedence_compares_no_names_without_a_crowd(spark, monkeypatch):
    """matches() finds documents without a tax number by their totals; names alike are not paired first."""
    looked, kept = [], dedupe.similar_names
    monkeypatch.setattr(dedupe, "similar_names", lambda a, b, least: looked.append(a.count() + b.count()) or kept(a, b, least))
    got = {(r.a_job_id, r.b_job_id): r.kind for r in dedupe.matches(spark.createDataFrame([r for r in ROWS if r[6] is not None], KEYS)).collect()}
    assert got == {p: "near" for p in (("a", "b"), ("b", "a"))} and looked == [0]
