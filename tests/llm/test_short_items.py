from docledger.llm import decontaminate


def test_short_items(spark):
    items = spark.createDataFrame([(1, "Forty  two"), (2, "+7"), (3, ""), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "it is FORTY\ntwo, he said"), (2, "twenty-forty two"), (3, "forty twos and forty tw"), (4, "forty twos, then forty two"), (5, "x+7 and"), (6, "+72"), (7, None)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.distance, r.budget) for r in decontaminate.contaminated(docs, items).collect()} == {(1, 1, 0, 0), (2, 1, 0, 0), (4, 1, 0, 0), (5, 2, 0, 0)}
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {3, 6, 7}
