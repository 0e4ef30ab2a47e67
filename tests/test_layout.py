"""Places of tokens: ties, bands against a plain loop, parties and items."""

import random

from docledger.operators import layout, spatial


def test_orientation_of_equal_weights(spark):
    """0.1 + 0.2 + 0.3 is more than 0.6 in doubles; the angles weigh the same, so the smallest counts."""
    rows = [(1, 90, 0.1), (1, 90, 0.2), (1, 90, 0.3), (1, 0, 0.6), (2, 90, 0.6), (2, 0, 0.59), (3, 180, None), (3, 90, None)]
    tokens = spark.createDataFrame(rows, "k int, angle int, conf double").selectExpr("*", "0 as x0", "1 as x1", "0 as y0", "1 as y1")
    assert {tuple(r) for r in spatial.orientation(tokens, ["k"]).collect()} == {(1, 0), (2, 90), (3, 90)}


def native(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(w in plan for w in ("Python", "Pandas", "InArrow"))


def test_bands_against_a_plain_loop(spark):
    rng, rows, expected = random.Random(4), [], {}
    for page in range(30):
        tokens = [(page, i, rng.random(), y, rng.random(), y + 0.01) for i in range(rng.randrange(1, 80)) for y in [rng.randrange(0, 60) * 0.004]]
        heads = []
        for _, i, _, y0, _, y1 in sorted(tokens, key=lambda t: (t[3] + t[5]) / 2):
            c = (y0 + y1) / 2
            if not heads or c - heads[-1] > layout.BAND:
                heads.append(c)
            expected[page, i] = len(heads)
        rows += tokens
    rows += [(99, 3, 0.5, 0.1, 0.6, 0.11), (99, 2, 0.4, None, 0.5, 0.3), (99, 1, 0.2, None, 0.5, None)]
    got = layout.bands(spark.createDataFrame(rows, "k long, token_id long, x0 double, y0 double, x1 double, y1 double"), "k", "long")
    assert {(r.k, r.token_id): r.line_id for r in got.collect()} == expected | {(99, 3): 1, (99, 1): 2, (99, 2): 3}
    assert native(got)  # no page goes to Python by itself


PAGE = [
    ("Seller:", 0.05, 0.20), ("Client:", 0.55, 0.20), ("Acme", 0.05, 0.24), ("Ltd", 0.11, 0.245), ("Zeta", 0.55, 0.24), ("1 Road", 0.05, 0.28), ("Town", 0.05, 0.31), ("Tax Id: 12-A", 0.05, 0.34),
    ("VAT", 0.05, 0.36), ("IBAN: GB1", 0.05, 0.38), ("ITEMS", 0.05, 0.45), ("below", 0.05, 0.47), ("Description", 0.12, 0.50), ("1.", 0.05, 0.55), ("Nut", 0.15, 0.555), ("2,00", 0.39, 0.55), ("more", 0.15, 0.58), ("Total", 0.05, 0.70),
]


def page_of(spark):
    rows = [(7, i, t, x, y, x + 0.04, y + 0.01) for i, (t, x, y) in enumerate(PAGE)] + [(8, 1, "Seller", 0.1, 0.1, 0.2, 0.11)]
    return spark.createDataFrame(rows, "k long, token_id long, text string, x0 double, y0 double, x1 double, y1 double")


def test_parties_in_one_reading(spark):
    got = layout.party_fields(page_of(spark), "k", "long")
    expected = {("supplier_name", "Acme Ltd"), ("supplier_address", "1 Road\nTown"), ("supplier_gstin", "12-A"), ("supplier_gstin", "VAT"), ("buyer_name", "Zeta")}
    assert {(r.field, r.value) for r in got.collect()} == expected
    assert native(got) and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_items_in_one_reading(spark):
    got = layout.item_fields(page_of(spark), "k", "long")
    assert [(r.k, r.item_no, r.line_no, r.description, r.quantity, r.line_total) for r in got.collect()] == [(7, 1, "1", "Nut more", "2.00", None)]
    assert native(got) and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_items_group_tokens_once(spark):
    """Tokens are grouped by page and never again; a line whose only word is empty adds none to a description."""
    more = [("2.", 0.05, 0.60), ("", 0.15, 0.61), ("", 0.15, 0.63), ("x", 0.15, 0.645), (None, 0.20, 0.645), ("7,50", 0.55, 0.645), ("8,50", 0.56, 0.645), ("each", 0.46, 0.645), ("3", 0.05, 0.665), ("", 0.85, 0.665)]
    rows = [(9, i, t, x, y, x + 0.04, y + 0.01) for i, (t, x, y) in enumerate(PAGE + more)] + [(9, 99, "lost", 0.3, None, 0.4, 0.6)]
    got = layout.item_fields(spark.createDataFrame(rows, "k long, token_id long, text string, x0 double, y0 double, x1 double, y1 double"), "k", "long")
    assert [tuple(r) for r in got.orderBy("item_no").collect()] == [(9, 1, "1", "Nut more", "2.00", None, None, None, None), (9, 2, "2", "x", None, None, "7.50", None, None)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Window" not in plan
