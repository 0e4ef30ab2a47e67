"""Tokens on pages: lines, bands, overlaps. Greedy clustering needs a page's tokens in order, so it goes by page through Arrow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docledger.functions import confidence


def cluster_lines(tokens: DataFrame, by: list[str], schema_by: str, tolerance: float | None = None, most_gap: float = 3.0) -> DataFrame:
    """line_id of each token (token_id, x0, y0, x1, y1): tokens from top to bottom join the first line whose first token is as high,
    within half the median height (or `tolerance`), unless a gap of more than three heights lies between.
    """

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_c=(pdf.y0 + pdf.y1) / 2, _h=pdf.y1 - pdf.y0).sort_values(["_c", "x0", "token_id"], kind="stable")
        tol = float(pdf["_h"].median()) / 2 if tolerance is None else tolerance
        heads, right, ids = [], [], []
        for r in pdf.itertuples():
            found = next((i for i, (c, _) in enumerate(heads) if abs(r[pdf.columns.get_loc("_c") + 1] - c) <= tol and (most_gap <= 0 or r.x0 - right[i] <= most_gap * max(1e-9, heads[i][1]))), None)
            if found is None:
                heads.append((r[pdf.columns.get_loc("_c") + 1], r[pdf.columns.get_loc("_h") + 1]))
                right.append(r.x1)
                found = len(heads) - 1
            right[found] = max(right[found], r.x1)
            ids.append(found + 1)
        return pdf.assign(line_id=ids)[[*by, "token_id", "line_id"]]

    return tokens.select(*by, "token_id", "x0", "y0", "x1", "y1").groupBy(*by).applyInPandas(page, f"{schema_by}, token_id long, line_id int")


def pages(tokens: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """by, tokens (an array of a page's tokens) and what else to aggregate of each page."""
    rest = [c for c in tokens.columns if c not in by]
    return tokens.groupBy(*by).agg(F.collect_list(F.struct(*rest)).alias("tokens"), *more)


def let(value: Column, then) -> Column:
    """then(value), with the value made once: in a lambda function it would be made again for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _heads(centres: Column, tolerance: float) -> Column:
    """The centres that begin a line, from top to bottom."""
    begins = lambda heads, c: F.coalesce(c - F.get(heads, F.size(heads) - 1) > tolerance, F.lit(True))
    centres = F.sort_array(F.array_distinct(F.array_compact(centres)))
    return F.aggregate(centres, F.array().cast("array<double>"), lambda heads, c: F.when(begins(heads, c), F.concat(heads, F.array(c))).otherwise(heads))


def lined(tokens: Column, tolerance: float, centre, row) -> Column:
    """row(token, line_id) of each token of an array, with lines as in banded(); the page stays one row."""
    at = lambda t: F.nanvl(centre(t), F.lit(None).cast("double"))
    place = lambda t: F.struct(t["x0"].alias("x0"), t["token_id"].alias("token_id"))
    astray = F.sort_array(F.transform(F.filter(tokens, lambda t: at(t).isNull()), place))
    line = lambda t, heads: F.when(at(t).isNull(), F.size(heads) + F.array_position(astray, place(t)).cast("int")).otherwise(F.size(F.filter(heads, lambda h: h <= centre(t))))
    return let(_heads(F.transform(tokens, at), tolerance), lambda heads: F.transform(tokens, lambda t: row(t, line(t, heads))))


def banded(page: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """by, the columns of the tokens of pages(), and line_id: from top to bottom a token joins the line above it if its centre is
    within the tolerance of that line's first one's, else it begins a line. A token without a place is a line of its own, after the others.

    A page is one row, so no token is grouped again, and nothing leaves the built-in expressions.
    """
    at = lambda t: F.nanvl((t["y0"] + t["y1"]) / 2, F.lit(None).cast("double"))
    heads = _heads(F.transform("tokens", at), tolerance)
    place = lambda t: F.struct(t["x0"].alias("x0"), t["token_id"].alias("token_id"))
    astray = F.sort_array(F.transform(F.filter("tokens", lambda t: at(t).isNull()), place))
    lines = page.select(*by, "tokens", heads.alias("_heads"), astray.alias("_astray"))  # once a page: beside explode() they would run for each token
    x = lines.select(*by, "_heads", "_astray", F.explode("tokens").alias("_t")).withColumn("_c", at(F.col("_t")))
    line = F.when(F.col("_c").isNull(), F.size("_heads") + F.array_position("_astray", place(F.col("_t")))).otherwise(F.size(F.filter("_heads", lambda h: h <= F.col("_c"))))
    return x.select(*by, "_t.*", line.cast("int").alias("line_id"))


def suppress(boxes: DataFrame, by: list[str], schema_by: str, most: float = 0.5) -> DataFrame:
    """token_id of the boxes that stay: from the surest on, a box goes if it overlaps one that stays by more than `most`."""

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for r in pdf.sort_values(["conf", "token_id"], ascending=[False, True]).itertuples():
            area = lambda b: max(0.0, b.x1 - b.x0) * max(0.0, b.y1 - b.y0)
            both = lambda b: max(0.0, min(r.x1, b.x1) - max(r.x0, b.x0)) * max(0.0, min(r.y1, b.y1) - max(r.y0, b.y0))
            if all(both(b) <= most * max(area(r) + area(b) - both(b), 1e-12) for b in kept):
                kept.append(r)
        return pd.DataFrame([[*[getattr(r, c) for c in by], r.token_id] for r in kept], columns=[*by, "token_id"])

    return boxes.select(*by, "token_id", "conf", "x0", "y0", "x1", "y1").groupBy(*by).applyInPandas(page, f"{schema_by}, token_id long")


def layout_text(tokens: DataFrame, by: list[str]) -> DataFrame:
    """The text of each line, its tokens from left to right."""
    parts = F.array_sort(F.collect_list(F.struct("x0", "token_id", "text")))
    return tokens.groupBy(*by, "line_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def bands(headers: DataFrame, by: list[str]) -> DataFrame:
    """left and right of each column: halfway to its neighbours."""
    w = W.partitionBy(*by).orderBy("center")
    return headers.withColumns({"left": F.coalesce((F.lag("center").over(w) + F.col("center")) / 2, F.lit(float("-inf"))), "right": F.coalesce((F.lead("center").over(w) + F.col("center")) / 2, F.lit(float("inf")))})


def into_bands(tokens: DataFrame, columns: DataFrame, by: list[str]) -> DataFrame:
    """Each token with the column in whose band its centre lies."""
    met = tokens.join(columns, by)
    x = (F.col("x0") + F.col("x1")) / 2
    return met.where((x >= F.col("left")) & (x < F.col("right")))


def joined_cells(placed: DataFrame, by: list[str]) -> DataFrame:
    """The text of each cell: the tokens that fell into one band of a row, from left to right."""
    parts = F.array_sort(F.collect_list(F.struct("x0", "token_id", "text")))
    return placed.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def nearest_header(words: DataFrame, headers: DataFrame, by: list[str]) -> DataFrame:
    """The header that each word is nearest to: by right edge under numeric columns, else by centre; of ties the leftmost."""
    met = words.join(headers, by)
    gap = F.when(F.col("numeric"), F.abs(F.col("x1") - F.col("h_x1"))).otherwise(F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("h_x0") + F.col("h_x1")) / 2))
    return met.groupBy(*by, "token_id").agg(F.min_by("header", F.struct(gap, "h_x0")).alias("header"))


def occluded(tokens: DataFrame, stamps: DataFrame, by: list[str]) -> DataFrame:
    """Tokens, with the confidence of those whose centre lies under a stamp lowered to four fifths."""
    boxes = stamps.groupBy(*by).agg(F.collect_list(F.array("s_x0", "s_y0", "s_x1", "s_y1")).alias("boxes"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    under = F.coalesce(F.exists("boxes", lambda b: confidence.inside(x, y, b)), F.lit(False))
    return tokens.join(boxes, by, "left").withColumn("conf", F.when(under, F.col("conf") * 0.8).otherwise(F.col("conf"))).drop("boxes")


def union_box(tokens: DataFrame, by: list[str]) -> DataFrame:
    return tokens.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def line_features(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Mean confidence, spread of heights over their mean, spread of bottoms (population)."""
    h = F.col("y1") - F.col("y0")
    return tokens.groupBy(*by).agg(F.avg("conf").alias("mean_conf"), (F.stddev_pop(h) / F.avg(h)).alias("height_cv"), F.stddev_pop("y1").alias("bottom_std"), F.median(h).alias("median_height"))


def orientation(tokens: DataFrame, by: list[str]) -> DataFrame:
    """The angle whose landscape tokens weigh most (confidence times width, to nine places); of ties the smallest.

    Weights are summed as decimals: sums of doubles hang on the order of the rows, and angles of equal weight would differ in noise.
    """
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    one = (F.col("conf") * w).cast("double").try_cast("decimal(28,9)")
    s = tokens.groupBy(*by, "angle").agg(F.coalesce(F.sum(F.when(w >= h, one)), F.lit(0)).alias("weight"))
    return s.groupBy(*by).agg(F.min_by("angle", F.struct(-F.col("weight"), "angle")).alias("angle"))
