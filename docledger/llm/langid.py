"""Language identification by mixture inference over character n-grams.

A document is a mixture of languages. Expectation-maximisation estimates the shares of a set of languages from the
likelihoods of the document's hashed character trigrams; the set grows by the language of steepest gain for as long as
the likelihood gains more than a penalty for each language.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import Shared, arrow_limits, trimmed

#: The model: hashed trigrams, smoothing, labelled documents learnt from per language (a hash sample of about so many),
#: and how many languages there may be.
BUCKETS, SMOOTHING, PER_LANGUAGE, MOST_LANGUAGES = 1 << 15, 0.5, 4000, 512
#: Sums of counts are made in so many parts for each language first.
PARTS = 64
#: Inference: the penalty for a language more is PENALTY * log(number of trigrams).
PENALTY, EM_STEPS, SETTLED = 3.0, 60, 1e-4
UNKNOWN = "und"

_letters: list = []


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    likelihood: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0)))


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of a text in lower case: letters as they are, each run of anything else one space. Without letters: none."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters[0][points]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter | np.concatenate(([True], letter[:-1]))  # the first of each run of other characters
    c = np.where(letter, points, 32)[keep].astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ c[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(49)).astype(np.int64)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Trigram counts of each language, over a hash sample of about PER_LANGUAGE labelled documents of it, whole texts.

    Rows without text or language teach nothing; no rows give a model of no language.
    """
    arrow_limits(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null")
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Model()
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, PER_LANGUAGE / n))]), F.col("lang"))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 32)) / F.lit(float(1 << 32))

    def count(batches):
        by: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = by.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, own in by.items():
            yield _counts(lang, own)

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS, np.int64)
        for raw in group.column("counts"):
            total += np.frombuffer(zlib.decompress(raw.as_py()), np.int64)
        return pa.Table.from_batches([_counts(group.column("lang")[0].as_py(), total)])

    # Sums of a few tasks first, then of all: a row for each language comes to the driver, MOST_LANGUAGES of 256 kB at most.
    layout = "lang string, counts binary"
    part = docs.where(place < share).select("lang", "text").mapInArrow(trimmed(count), layout)
    part = part.groupBy("lang", F.pmod(F.spark_partition_id(), F.lit(PARTS))).applyInArrow(add, layout).groupBy("lang").applyInArrow(add, layout)
    rows = sorted(((r["lang"], np.frombuffer(zlib.decompress(r["counts"]), np.int64)) for r in part.collect()), key=lambda r: r[0])
    if not rows:
        return Model()
    table = np.stack([x for _, x in rows], 1) + SMOOTHING
    return Model([x for x, _ in rows], (table / table.sum(0)).astype(np.float32))


def _counts(lang: str, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([lang], pa.string()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["lang", "counts"])


def mixture(model: Model, features: np.ndarray) -> np.ndarray:
    """The languages' shares, 0 for those that are not selected."""
    shares = np.zeros(len(model.languages))
    if not len(features) or not len(shares):
        return shares
    bins = np.bincount(features, minlength=BUCKETS)
    at = np.flatnonzero(bins)
    n, p = bins[at].astype(float), model.likelihood[at].astype(float)
    total, price = n.sum(), PENALTY * np.log(max(2.0, float(n.sum())))
    alone = n @ np.log(p)
    shares[int(np.argmax(alone))], best = 1.0, float(alone.max())
    fit = p @ shares
    while True:
        slope = (n / fit) @ p / total - 1  # the gain of moving towards each language; the likelihood is concave, so it bounds the whole gain
        new = int(np.argmax(np.where(shares > 0, -np.inf, slope))) if (shares == 0).any() else -1
        if new < 0 or slope[new] * total <= price:
            return shares
        chosen = np.flatnonzero(shares > 0).tolist() + [new]
        part, q = np.append(shares[chosen[:-1]] * 0.8, 0.2), p[:, chosen]
        for _ in range(EM_STEPS):
            f = q @ part
            old, part = part, part * ((n / f) @ q) / total
            if np.abs(part - old).max() < SETTLED:
                break
        f = q @ part
        value = float(n @ np.log(f))
        if value - best <= price:
            return shares
        shares = np.zeros(len(shares))
        shares[chosen], best, fit = part, value, f


def predict(shared: Shared, text: Column) -> Column:
    """struct<lang_pred string, score double, shares array<struct<lang string, share double>>>.

    lang_pred has the largest share (of ties the first by name), and score is that share. A null text, one without a
    letter, and, as nothing else could be named, a model without languages give `und`, 0 and no shares. Whole texts count,
    however long.
    """

    @F.pandas_udf("lang_pred string, score double, shares array<struct<lang:string,share:double>>")
    def infer(texts: pd.Series) -> pd.DataFrame:
        model, rows = shared.get(), []
        for t in texts:
            x = mixture(model, trigrams(t))
            if not x.any():
                rows.append((UNKNOWN, 0.0, []))
            else:
                top = int(np.argmax(x))
                rows.append((model.languages[top], min(1.0, float(x[top])), [{"lang": model.languages[i], "share": float(x[i])} for i in np.flatnonzero(x)]))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "shares"])

    return infer(text)


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """Adds the struct of predict(); every row stays, repeated ones too."""
    arrow_limits(docs.sparkSession)
    return docs.withColumn(out, predict(Shared(docs.sparkSession, model), F.col(text_col)))
