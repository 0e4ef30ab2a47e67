"""Merging hypotheses: doc_id, field, source, value, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docledger.functions import confidence


def noisy_or(hyps: DataFrame, by: list[str], carried: str | None = None, order: Column | None = None) -> DataFrame:
    """score: 1 minus the product of what each family of sources leaves open (its best counts), at most 0.99.

    carried: a column to keep of the hypothesis that is last in `order`.
    """
    last = [] if carried is None else [F.max_by(carried, order).alias(carried), F.max(order).alias("_order")]
    best = hyps.withColumn("family", confidence.family(F.col("source"))).groupBy(*by, "family").agg(F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence").cast("double")))).alias("c"), F.array_sort(F.collect_set("source")).alias("s"), *last)
    left = F.aggregate(F.array_sort(F.collect_list("c")), F.lit(1.0), lambda a, c: a * (F.lit(1.0) - c))
    last = [] if carried is None else [F.max_by(carried, "_order").alias(carried)]
    return best.groupBy(*by).agg(F.least(F.lit(0.99), F.lit(1.0) - left).alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("sources"), *last)


def merge(hyps: DataFrame, gap: float = 0.15, alternatives: int = 3, carried: str | None = None, order: Column | None = None) -> DataFrame:
    """doc_id, field, value, score, sources, alternatives and ambiguous: the best value of each field.

    Values are ranked by score, then by value; a value that a QR code gives wins. Ambiguous: the next one is nearer than `gap`
    and no QR code decides. carried: a column to keep of the best value's hypothesis that is last in `order`.
    """
    keys = ["doc_id", "field"]
    scored = noisy_or(hyps, [*keys, "value"], carried, order).withColumn("qr", F.array_contains("sources", "qr"))
    w = W.partitionBy(*keys).orderBy(F.desc("qr"), F.desc("score"), "value")
    ranked = scored.withColumns({"rank": F.row_number().over(w), "next": F.lead("score").over(w)})
    others = F.filter(F.array_sort(F.collect_list(F.when((F.col("rank") > 1) & (F.col("rank") <= alternatives + 1), F.struct("rank", "value", "score")))), lambda x: x.isNotNull())
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c))).alias(c)
    kept = [] if carried is None else [F.min_by(carried, "rank").alias(carried)]
    return ranked.groupBy(*keys).agg(first("value"), first("score"), first("sources"), F.transform(others, lambda x: x["value"]).alias("alternatives"), F.max((F.col("rank") == 1) & ~F.col("qr") & F.coalesce(F.col("score") - F.col("next") < gap, F.lit(False))).alias("ambiguous"), *kept)


def representative(hyps: DataFrame, by: list[str], order: str, carried: list[str]) -> DataFrame:
    """by and the carried columns of the surest hypothesis of each group; of equals the first in order."""
    return hyps.groupBy(*by).agg(F.max_by(F.struct(*carried), F.struct(F.col("confidence").cast("double"), -F.col(order))).alias("r")).select(*by, "r.*")


def vote(values: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The value that most copies have; of ties the one whose last copy comes first."""
    n = values.groupBy(*by, value).agg(F.count("*").alias("n"), F.max(order).alias("seen"))
    return n.groupBy(*by).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), "seen", value)).alias("v")).select(*by, f"v.{value}", F.col("v.n").alias("votes"))


def align_lines(a: DataFrame, b: DataFrame, key: str, pos: str, field: str) -> DataFrame:
    """Lines of two sources side by side by position: a full outer join."""
    x, y = a.select(key, pos, F.col(field).alias("left_value")), b.select(key, pos, F.col(field).alias("right_value"))
    return x.join(y, [key, pos], "full_outer")


#: Confidence of a critical value that no token on its page bears out.
UNGROUNDED = 0.375


def ground(values: DataFrame, tokens: DataFrame, most: int = 1, handwritten: int = 2) -> DataFrame:
    """doc_id, field, value, and the token nearest to the value by edit distance; of ties the first; grounded or not.

    A token may be up to `most` edits away, one of kind handwritten (a column `kind` of tokens) up to `handwritten`. Where both
    sides have a column page, only tokens of the value's page count; the token's box (x0, y0, x1, y1) comes along where tokens
    have one. `confidence`, where values have it, falls to UNGROUNDED at most for a value without a token.
    """
    have = set(tokens.columns)
    box = [c for c in ("x0", "y0", "x1", "y1") if c in have]
    on = ["doc_id", *(["page"] if "page" in have and "page" in values.columns else [])]
    room = F.when(F.col("kind") == "handwritten", handwritten).otherwise(most) if "kind" in have else F.lit(most)
    slim = tokens.select(*on, "token", "pos", room.alias("_room"), *box)
    met = values.select(*on, "field", "value").join(slim, on).withColumn("d", F.levenshtein(F.upper("value"), F.upper("token"), max(most, handwritten))).where("d >= 0 and d <= _room")
    best = met.groupBy("doc_id", "field").agg(F.min_by(F.struct("token", "d", "pos", *box), F.struct("d", "pos")).alias("t"))
    out = values.join(best, ["doc_id", "field"], "left")
    sure = [F.when(F.col("t").isNull(), F.least(F.col("confidence").cast("double"), F.lit(UNGROUNDED))).otherwise(F.col("confidence").cast("double")).alias("confidence")] if "confidence" in values.columns else []
    return out.select("doc_id", "field", "value", "t.token", F.col("t.d").alias("distance"), F.col("t").isNotNull().alias("grounded"), *[F.col(f"t.{c}").alias(c) for c in box], *sure)
