"""Repairs: tax numbers by characters read for one another, totals by the amount in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docledger.functions import dims, ids

#: What each place of a GSTIN holds: digits (0), letters (1) or either (2).
PLACES = "001111100001212"
MOST_PLACES = 6


def confusions() -> list[tuple[str, str, str]]:
    """(kind of place, character seen, what it may stand for)."""
    out = set()
    for digit, likes in dims.DIGIT_LIKE.items():
        for c in (x.upper() for x in likes):
            out |= {(k, c, digit) for k in "02"}
            if c.isalpha():
                out |= {(k, digit, c) for k in "12"}
    for letter, likes in dims.LETTER_LIKE.items():
        out |= {(k, c.upper(), letter) for c in likes for k in "12"}
    return sorted(x for x in out if x[1] != x[2])


def candidates(rows: DataFrame, key: str, col: str) -> DataFrame:
    """key, candidate and cost: valid tax numbers one or two characters away, by characters that are read for one another.

    At most MOST_PLACES places of a number can change, the first ones. Costs add up: 0.3 for the place before the check
    character, 1.3 for others.
    """
    like = rows.sparkSession.sql("select * from values " + ", ".join(f"('{k}', '{c}', '{t}')" for k, c, t in confusions()) + " as v(kind, char, to)")
    seen = rows.select(key, F.upper(F.regexp_replace(col, "[\\s-]+", "")).alias("g")).where(F.length("g") == 15)
    chars = seen.select(key, "g", F.posexplode(F.split("g", "")).alias("at", "char")).withColumn("kind", F.substr(F.lit(PLACES), F.col("at") + 1, F.lit(1)))
    swaps = chars.join(F.broadcast(like), ["kind", "char"]).withColumn("place", F.dense_rank().over(W.partitionBy(key).orderBy("at"))).where(F.col("place") <= MOST_PLACES)
    swaps = swaps.select(key, "g", "at", "to", F.when(F.col("at") == 13, 0.3).otherwise(1.3).alias("cost"))
    put = lambda g, at, to: F.concat(F.substr(g, F.lit(1), at), to, F.substr(g, at + 2, F.lit(15)))
    one = swaps.select(key, put(F.col("g"), F.col("at"), F.col("to")).alias("candidate"), "at", "cost")
    two = one.join(swaps.select(key, F.col("at").alias("b_at"), F.col("to").alias("b_to"), F.col("cost").alias("b_cost")), key).where("at < b_at")
    made = one.select(key, "candidate", "cost").union(two.select(key, put(F.col("candidate"), F.col("b_at"), F.col("b_to")), F.col("cost") + F.col("b_cost")))
    # Grouped first: the checksum then reads a finished column, not the expression that makes it.
    return made.groupBy(key, "candidate").agg(F.min("cost").alias("cost")).where(ids.gstin_valid(F.col("candidate")))


#: How much dearer the second candidate must be for the first to be taken; bounds of a repaired value's confidence.
CLEAR, LEAST_SURE, MOST_SURE = 0.5, 0.60, 0.85


def decide(made: DataFrame, key: str, independent: DataFrame | None = None) -> DataFrame:
    """key, value (repaired, or null if ambiguous) and top: the three best candidates.

    The best candidate that another source gives too is taken; else the only one, or one that is cheaper than the next by CLEAR.
    """
    if independent is not None:
        made = made.join(independent.select(key, F.col("value").alias("candidate"), F.lit(True).alias("known")).distinct(), [key, "candidate"], "left")
    else:
        made = made.withColumn("known", F.lit(None).cast("boolean"))
    order = F.struct(F.round("cost", 6).alias("cost"), "candidate")
    g = made.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("all"), F.min(F.when(F.col("known"), order)).alias("match"))
    gap = F.get("all", F.lit(1))["cost"] - F.get("all", F.lit(0))["cost"]
    value = F.coalesce(F.col("match.candidate"), F.when((F.size("all") == 1) | (gap >= CLEAR), F.get("all", F.lit(0))["candidate"]))
    return g.select(key, value.alias("value"), F.transform(F.slice("all", 1, 3), lambda x: x["candidate"]).alias("top"))


def repaired_confidence(before: Column) -> Column:
    return F.least(F.lit(MOST_SURE), F.greatest(before.cast("double"), F.lit(LEAST_SURE)))


def repaired_fields(fields: DataFrame, key: str, independent: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fields, corrections, open candidates) of tax numbers that are not valid.

    fields: key, field, value, confidence, status, alternatives (array<string>). A repaired field is corrected, keeps the old
    value as its first alternative and has a confidence of 0.60 to 0.85. Where candidates are ambiguous their best three are
    given with GSTIN_REPAIR_AMBIGUOUS (none, if nothing valid is near).
    """
    one = F.concat_ws("\u0001", F.col(key).cast("string"), F.col("field"))
    bad = fields.where(F.col("field").isin("supplier_gstin", "buyer_gstin") & (F.coalesce("value", F.lit("")) != "") & ~ids.gstin_valid(F.col("value"))).withColumn("_one", one)
    others = bad.select("_one", F.explode("alternatives").alias("value")).select("_one", F.upper(F.replace("value", F.lit(" "), F.lit(""))).alias("value"))
    if independent is not None:
        others = others.union(bad.select(key, "_one").join(independent.select(key, F.col("value").alias("_v")), key).select("_one", "_v"))
    decided = decide(candidates(bad, "_one", "value"), "_one", others)
    x = bad.join(decided.select("_one", F.col("value").alias("_new"), "top"), "_one", "left")
    after = repaired_confidence(F.col("confidence"))
    done = x.where("_new is not null").select(
        key, F.concat(F.lit("invoice."), "field").alias("field_path"), F.col("value").alias("original"), F.col("_new").alias("corrected"), F.lit("gstin_checksum").alias("method"),
        F.lit("Unique OCR-confusion candidate passes GSTIN checksum").alias("reason"), F.col("confidence").cast("double").alias("confidence_before"), after.alias("confidence_after"),
    )
    open_ = x.where("_new is null").select(key, F.concat(F.lit("invoice."), "field").alias("field_path"), F.coalesce("top", F.array().cast("array<string>")).alias("candidates"), F.lit("GSTIN_REPAIR_AMBIGUOUS").alias("reason"))
    new = x.where("_new is not null").select(key, "field", "_new")
    out = fields.join(new, [key, "field"], "left")
    on = F.col("_new").isNotNull()
    out = out.withColumns({
        "alternatives": F.when(on, F.slice(F.concat(F.array("value"), F.coalesce("alternatives", F.array().cast("array<string>"))), 1, 3)).otherwise(F.col("alternatives")),
        "confidence": F.when(on, after).otherwise(F.col("confidence").cast("double")), "status": F.when(on, "corrected").otherwise(F.col("status")), "value": F.coalesce("_new", "value"),
    }).drop("_new")
    return out, done, open_


def total_from_words(rows: DataFrame) -> DataFrame:
    """Corrects `total` where the words, surely read, equal the total that the parts make, outside spreadsheets.

    rows: total, expected, words_amount, certainty, input_kind. Adds corrected and original.
    """
    fits = (F.col("certainty") >= 0.85) & (F.col("words_amount") == F.col("expected")) & (F.col("total") != F.col("words_amount")) & ~F.col("input_kind").isin("csv", "xlsx", "excel")
    fits = F.coalesce(fits, F.lit(False))
    return rows.withColumns({"original": F.when(fits, F.col("total")), "corrected": fits}).withColumn("total", F.when(fits, F.col("words_amount")).otherwise(F.col("total")))
