"""Confidence expressions, scores and box geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions import dims


def source_confidence(source: Column, reported: Column, handwritten: Column) -> Column:
    base = F.coalesce(F.element_at(dims.mapping(dims.SOURCE_TRUST), source), F.lit(0.65))
    base = F.when(reported.isNotNull(), F.least(base, F.greatest(reported, F.lit(0.0)))).otherwise(base)
    return F.when((source == "ocr") & handwritten, F.least(base, F.lit(0.80))).otherwise(base)


def family(source: Column) -> Column:
    return F.coalesce(F.element_at(dims.mapping(dims.SOURCE_FAMILY), source), source)


def cap(conf: Column, invalid: Column, gstin_valid: Column, ambiguous: Column, ungrounded: Column) -> Column:
    v = F.when(invalid, conf * 0.5).otherwise(conf)
    v = F.when(gstin_valid, F.greatest(v, F.lit(0.95))).when(~gstin_valid, F.least(v, F.lit(0.60))).otherwise(v)
    v = F.when(ambiguous, F.least(v, F.lit(0.92))).otherwise(v)
    v = F.when(ungrounded, v * 0.5).otherwise(v)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))


def logistic(features: Column, mean: Column, std: Column, weights: Column, bias: Column) -> Column:
    """1 / (1 + exp(-(w . (x - mean) / std + b))), the exponent held within 25."""
    z = F.transform(F.arrays_zip(features.alias("f"), mean.alias("m"), std.alias("s"), weights.alias("w")), lambda t: (t["f"] - t["m"]) / t["s"] * t["w"])
    x = F.aggregate(z, F.lit(0.0), lambda a, v: a + v) + bias
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-25.0), F.least(F.lit(25.0), x))))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap of two boxes (x0, y0, x1, y1) over their union."""
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: F.greatest(zero, x[2] - x[0]) * F.greatest(zero, x[3] - x[1])
    return w * h / F.greatest(area(a) + area(b) - w * h, F.lit(1e-12))


def rotate(box: list[Column], angle: Column) -> Column:
    """A normalised box after turning the page by 0, 90, 180 or 270 degrees clockwise."""
    x0, y0, x1, y1 = box
    one = F.lit(1.0)
    by = lambda *c: F.array(*c)
    return F.when(angle == 90, by(one - y1, x0, one - y0, x1)).when(angle == 180, by(one - x1, one - y1, one - x0, one - y0)).when(angle == 270, by(y0, one - x1, y1, one - x0)).otherwise(by(x0, y0, x1, y1))


def inside(x: Column, y: Column, box: Column) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])
