"""Corpus preparation: language, near-duplicates, benchmark leaks, personal data, tokens.

Each stage gets the documents that the one before it kept, as written Parquet, and works on all of them. run() leaves the
stages' files in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.llm import bpe, decontaminate, langid, pii, simhash
from docledger.llm.common import fresh, materialize, table
from docledger.llm.queries import SURROGATE_KEY, held_out

#: A document in which no language has this share is none of the known languages.
LEAST_SHARE = 0.4

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a language; those without a letter, null texts, and mixtures without a main language, go.

    Repeated rows stay or go alike; if nothing can be learnt (no text with a label) no document has a language and all go.
    """
    model = langid.train(docs.where(~held_out()))
    found = fresh("language")
    rows = langid.identify(docs, model, out=found)
    return rows.where((F.col(f"{found}.lang_pred") != langid.UNKNOWN) & (F.col(f"{found}.score") >= LEAST_SHARE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the least id.

    Links have a Jaccard similarity of 0.8 or more over 5-word shingles; candidates come from SimHash. Rows of one id are
    one document; rows without an id stay; texts without words are alike.
    """
    gone = materialize(simhash.duplicates(docs), "pipeline-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no item of the benchmark occurs; null and empty texts hold none. No items: all stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets; n_chars, where it is there, counts a changed text anew. Null texts stay null."""
    replaced = fresh("replaced")
    rows = pii.surrogates(docs, SURROGATE_KEY, count=replaced)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(replaced) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digests of ids and decoded text; null texts count as empty."""
    rows = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("personal_data", personal_data), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage, over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
