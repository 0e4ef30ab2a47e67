"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source, ranked there, and sorted by fractional rank; cutting that
sequence into equal pieces gives every shard the mixture of the whole table.

Both rankings are distributed: rows fall into hash (then rank) buckets, bucket counts are summed into offsets, and a
window ranks within one bucket only, so that neither a hot source nor the whole table meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docledger.llm.common import materialize

#: Hash buckets within a source, and rank buckets of the whole table.
SOURCE_BUCKETS, RANK_BUCKETS = 4096, 16384


def _head(hex_digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest, as a long."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("long")


def _offsets(counts: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """Adds `before` (rows in lower buckets) and `total` (rows of all buckets) within `by`."""
    every = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    upto = every.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumns({"before": F.coalesce(F.sum("n").over(upto), F.lit(0)), "total": F.sum("n").over(every)})


def interleave(docs: DataFrame, n_shards: int = 16, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Shard (0 to n_shards - 1) and slot (gapless from 0 in each shard) of every row.

    Returns the id, size (UTF-8 bytes of the text, plus 1), text_crc32, source, shard and slot. Shards differ by one
    row at most. A null text counts as empty, a null source as the empty source, a null id as an empty id. Rows alike
    in id, source and text may trade places. No rows give no rows. Columns besides the three named are ignored.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.col(text_col).alias("text"),
        key.alias("key"),
    ).withColumn("bucket", F.shiftright(_head(F.col("key")) * F.lit(SOURCE_BUCKETS), 32).cast("int"))
    offsets = _offsets(rows.groupBy("source", "bucket").agg(F.count("*").alias("n")), ["source"], "bucket").drop("n")
    slim = rows.select(
        "doc_id", "source", "key", "bucket",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    within = W.partitionBy("source", "bucket").orderBy("key", "text_crc32", "size")
    #: Each source starts at its own place between two ranks, else sources of one row would all meet at one half.
    place = (_head(F.md5(F.col("source").cast("binary"))).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    ranked = (
        slim.withColumn("rn", F.row_number().over(within))
        .join(offsets, ["source", "bucket"])
        .withColumn("fraction", ((F.col("before") + F.col("rn")).cast("double") - place) / F.col("total").cast("double"))
        .select("doc_id", "source", "size", "text_crc32", "key", "fraction", F.least(F.floor(F.col("fraction") * RANK_BUCKETS), F.lit(RANK_BUCKETS - 1)).cast("int").alias("bucket"))
    )
    ranked = materialize(ranked, "interleave")
    offsets = _offsets(ranked.groupBy("bucket").agg(F.count("*").alias("n")), [], "bucket").drop("n")
    rank = F.col("before") + F.row_number().over(W.partitionBy("bucket").orderBy("fraction", "source", "key", "text_crc32", "size")) - 1
    return (
        ranked.join(offsets, "bucket")
        .withColumn("rank", rank)
        .withColumn("shard", F.expr(f"int((rank * {n_shards}) div total)"))
        .withColumn("slot", F.expr(f"rank - (shard * total + {n_shards - 1}) div {n_shards}"))
        .select("doc_id", "size", "text_crc32", "source", "shard", "slot")
    )
