"""Benchmark items in very long texts and repeated rows, against a plain distance."""

import random

from docledger.llm import decontaminate


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_long_texts_repeats_and_clashing_columns(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    item = " ".join(word() for _ in range(20))
    edited = list(item)
    for _ in range(int(0.1 * len(item)) - 1):
        edited[rng.randrange(len(edited))] = rng.choice("abcxyz")
    edited = "".join(edited)
    long = " ".join(word() for _ in range(150_000))
    rows = [(1, f"{long} {item} {long}"), (2, f"{long[:5000]} {edited}"), (3, long), (4, item), (4, item), (5, None), (6, ""), (None, item.upper())]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, found string, m string")
    items = spark.createDataFrame([(9, item), (9, item), (10, None), (None, item), (11, "")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(df, items).collect()), key=str)
    assert got == sorted([(1, 9, 0), (2, 9, plain_distance(decontaminate.normalise(item), decontaminate.normalise(edited))), (4, 9, 0), (4, 9, 0), (None, 9, 0)], key=str)
    clean = decontaminate.clean(df, items)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [3, 5, 6]
    assert decontaminate.clean(df, items.limit(0)).count() == len(rows) and decontaminate.contaminated(df.limit(0), items).count() == 0
