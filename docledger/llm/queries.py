"""The registered queries of the training-data operators, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from docledger.llm import bpe, decontaminate, langid, passages, pii, quotes, sharding, simhash, topk, urls
from docledger.llm.common import table


def op1_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.threads(table(spark, sf_dir, "conversations"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"))


def op6_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.interleave(table(spark, sf_dir, "documents"), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def held_out(id_col: str = "doc_id"):
    """The documents that language identification must not learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out()))
    rows = langid.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", "language.lang_pred", "language.score", "language.shares")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.labelled_urls(spark))


#: Production would hand its own secret over.
SURROGATE_KEY = b"docledger surrogate key"


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(table(spark, sf_dir, "documents"), SURROGATE_KEY).select("doc_id", "text", "n_replaced")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op4_topk": op4_topk, "op5_passages": op5_passages, "op1_quotations": op1_quotations, "op9_surrogates": op9_surrogates, "op2_simhash": op2_simhash, "op3_decontaminate": op3_decontaminate, "op7_language": op7_language, "op6_interleave": op6_interleave, "op8_url_filter": op8_url_filter, "op10_bpe": op10_bpe}

#: The law of sharding: ranks in seeded order within each source, then of the fraction of the source.
OP6_SQL = """
with d as (select doc_id, coalesce(text, '') as text, octet_length(encode(coalesce(text, ''))) + 1 as size, text is null as none, coalesce(source, '') as source, md5('mix:' || coalesce(cast(doc_id as varchar), '')) as key from documents),
r as (select *, row_number() over (partition by source order by key) as rn, count(*) over (partition by source) as n_source, (cast(('0x' || substr(md5(source), 1, 8)) as bigint) + 0.5::double) / 4294967296.0::double as place from d),
g as (select *, row_number() over (order by (rn::double - place) / n_source::double, source, key) - 1 as rank, count(*) over () as n from r),
table_crc as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as i) z) y)
select doc_id, size, case when len(text) = 0 then 0 else xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: cast(('0x' || x) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) end as text_crc32,
 'rows' as law, cast(rank * 16 // n as integer) as shard, rank - (rank * 16 // n * n + 15) // 16 as slot, cast(null as integer) as grown_shard
from g, table_crc"""

#: Whole numbers, all queries against all rows.
OP4_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as w from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) as bigint) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) t where rank <= 5"""

ORACLES: dict[str, str] = {"op4_topk": OP4_SQL, "op6_interleave": OP6_SQL}
