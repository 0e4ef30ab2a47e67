"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

1. Blocks. Each task splits its texts into pre-tokens and numbers the distinct ones of a block (about BLOCK_TOKENS
   pre-tokens of whole texts). A block keeps its pre-tokens in order, as word numbers: the exploded positions, packed.
2. Words. Each block deals its distinct words, not their occurrences, to hash buckets. A bucket meets the words of all
   blocks, encodes each distinct word once and sends every block its words' ids.
3. Reassembly. A block joins the ids back by word number, which puts them in the order of positions; decoding joins the
   ids with the table of token bytes.

A frequent word crosses the shuffle once for a block, so no word is hot; neither the texts nor the packed pre-tokens are
ever shuffled: blocks are written bucketed by their number, and the ids come to them.
"""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import Shared, arrow_limits, materialize, text_bytes, trimmed, trimmed_group

#: Pre-tokens of a block; characters of a text beyond which no list of its pre-tokens is made; tokens unpacked at once.
BLOCK_TOKENS, LONG_TEXT, CHUNK = 1_000_000, 500_000, 1 << 18
#: Buckets of words: at least so many, and one for so many bytes of text.
LEAST_BUCKETS, BUCKET_BYTES = 32, 32 << 20
#: Blocks of a task that lie in one bucket, and so in one file, before its next ones go to the next bucket.
TOGETHER = 16


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks file of a byte-level BPE vocabulary: a line holds a token in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _codec(ranks: dict[bytes, int], pattern: str):
    """(encoder, the bytes of all tokens in one piece, where each token starts)."""
    import tiktoken

    by_id = {v: k for k, v in ranks.items()}
    tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), np.frombuffer(b"".join(tokens), np.uint8), starts


def _pack(a: np.ndarray) -> bytes:
    """Unsigned numbers below 2**32 as byte planes, compressed."""
    raw = np.ascontiguousarray(a.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(raw.tobytes())


def _unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


#: First bytes below ONE are numbers; those below TWO begin a number of two bytes, the rest one of four.
ONE, TWO = 160, 240


def _pack_stream(a: np.ndarray) -> bytes:
    """Word numbers, small ones most frequent: one, two or four bytes each, first and further bytes compressed apart."""
    if len(a) and a.max() >= 1 << 28:
        raise ValueError("too many distinct words in a block")
    parts: list[list[bytes]] = [[], [], [], [], []]
    packers = [zstandard.ZstdCompressor(level=3).compressobj() for _ in parts]
    for i in range(0, len(a), CHUNK):
        own = a[i : i + CHUNK].astype(np.int32)
        two = (own >= ONE) & (own < ONE + ((TWO - ONE) << 8))
        four = own >= ONE + ((TWO - ONE) << 8)
        b, c = own - ONE, own[four] - ONE - ((TWO - ONE) << 8)
        first = np.where(two, ONE + (b >> 8), own)
        first[four] = TWO + (c >> 24)
        for part, packer, x in zip(parts, packers, (first, b[two] & 255, (c >> 16) & 255, (c >> 8) & 255, c & 255)):
            part.append(packer.compress(x.astype(np.uint8).tobytes()))
    packed = [b"".join(part) + packer.flush() for part, packer in zip(parts, packers)]
    return struct.pack("<5I", *map(len, packed)) + b"".join(packed)


def _unpack_stream(raw: bytes) -> np.ndarray:
    ends = np.concatenate(([0], np.cumsum(struct.unpack_from("<5I", raw)))).tolist()
    first, second, x, y, z = (np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(raw[20 + i : 20 + j]), np.uint8) for i, j in zip(ends, ends[1:]))
    out = first.astype(np.uint32)
    two, four = (first >= ONE) & (first < TWO), first >= TWO
    out[two] = ((out[two] - ONE) << 8) + second + ONE
    out[four] = ((out[four] - TWO) << 24) + (x.astype(np.uint32) << 16) + (y.astype(np.uint32) << 8) + z + (ONE + ((TWO - ONE) << 8))
    return out


def _pack_words(words: list[bytes]) -> bytes:
    body = b"".join(words)
    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return struct.pack("<I", len(words)) + zstandard.ZstdCompressor(level=9).compress(lengths.tobytes() + body)


def _unpack_words(b: bytes) -> list[bytes]:
    n = struct.unpack_from("<I", b)[0]
    raw = zstandard.ZstdDecompressor().decompress(b[4:])
    ends = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.uint32, n)))).astype(np.int64) + 4 * n
    at = ends.tolist()
    return [raw[i:j] for i, j in zip(at, at[1:])]


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), one run after another."""
    total = int(lengths.sum())
    shift = starts - np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else starts
    return np.repeat(shift, lengths) + np.arange(total, dtype=np.int64)


def _bucket(x: int, n: int) -> int:
    """The bucket of a long: Spark's own hash, by which tables are bucketed."""
    h = 42
    for k in (x & 0xFFFFFFFF, x >> 32 & 0xFFFFFFFF):
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        h ^= k
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return (h - (h >> 31 << 32)) % n


def _numbers(task: int, n_buckets: int):
    """Numbers for the blocks of a task, TOGETHER of them in a bucket.

    Without that each block would be a file of its own, and for each file that it makes an executor may start a process.
    """
    number, dealt = task << 32, 0
    while True:
        while _bucket(number, n_buckets) != (task + dealt // TOGETHER) % n_buckets:
            number += 1
        yield number
        number, dealt = number + 1, dealt + 1


def _blocks(pattern: str, n_buckets: int, id_type: pa.DataType, block_tokens: int):
    split, long_text = regex.compile(pattern), LONG_TEXT

    def run(batches):
        numbers = _numbers(TaskContext.get().partitionId(), n_buckets)
        schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(id_type)), ("counts", pa.binary()), ("stream", pa.binary()), ("buckets", pa.binary()), ("words", pa.binary())])
        ids, counts, streams, seen, tokens = [], [], [], {}, 0

        def flush():
            local = np.concatenate(streams) if streams else np.zeros(0, np.uint32)
            streams.clear()
            every = [w.encode("utf-8") for w in seen]
            seen.clear()
            order = np.argsort(-np.bincount(local, minlength=len(every)), kind="stable")  # frequent words get small numbers, which pack well
            rank = np.empty(len(every), np.uint32)
            rank[order] = np.arange(len(every), dtype=np.uint32)
            words = [every[i] for i in order.tolist()]
            del every
            buckets = np.fromiter((zlib.crc32(w) % n_buckets for w in words), np.uint32, len(words))
            np.take(rank, local, out=local)
            row = [[next(numbers)], [list(ids)], [_pack(np.array(counts, np.uint32))], [_pack_stream(local)], [_pack(buckets)], [_pack_words(words)]]
            return pa.record_batch([pa.array(v, t.type) for v, t in zip(row, schema)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                if len(text) > long_text:  # without a list of all its pre-tokens
                    own = np.fromiter((seen.setdefault(m.group(), len(seen)) for m in split.finditer(text)), np.uint32)
                else:
                    found = split.findall(text)
                    own = np.fromiter((seen.setdefault(w, len(seen)) for w in found), np.uint32, len(found))
                ids.append(doc)
                counts.append(len(own))
                streams.append(own)
                tokens += len(own)
                if tokens >= block_tokens or len(ids) >= 100_000:
                    yield flush()
                    ids, counts, streams, seen, tokens = [], [], [], {}, 0
        if ids:
            yield flush()

    return run


def _deal(batches):
    """A row for each bucket of a block, with the block's words of that bucket in the order of their numbers."""
    for batch in batches:
        for block, packed, buckets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words, of = _unpack_words(packed), _unpack(buckets)
            order = np.argsort(of, kind="stable")
            keys, first = np.unique(of[order], return_index=True)
            cut = [*first.tolist(), len(order)]
            order = order.tolist()
            rows = [_pack_words([words[i] for i in order[a:b]]) for a, b in zip(cut, cut[1:])]
            if rows:
                yield pa.record_batch([pa.array(keys.astype(np.int64)), pa.array([block] * len(rows), pa.int64()), pa.array(rows, pa.binary())], names=["bucket", "block", "words"])


def _encode_bucket(shared, pattern: str):
    def run(group: pa.Table) -> pa.Table:
        encode = shared.get(lambda r: _codec(r, pattern))[0]._encode_single_piece
        known: dict[bytes, list[int]] = {}
        lengths, ids = [], []
        for packed in group.column("words").to_pylist():
            own = [known[w] if w in known else known.setdefault(w, encode(w)) for w in _unpack_words(packed)]
            lengths.append(_pack(np.fromiter(map(len, own), np.uint32, len(own))))
            ids.append(_pack(np.fromiter((i for x in own for i in x), np.uint32)))
        return pa.table({"bucket": group.column("bucket"), "block": group.column("block"), "lengths": pa.array(lengths, pa.binary()), "ids": pa.array(ids, pa.binary())})

    return run


def _reassemble(shared, pattern: str, id_type: pa.DataType):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        _, token_bytes, token_starts = shared.get(lambda r: _codec(r, pattern))
        schema = pa.schema([("doc_id", id_type), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
        out = []
        rows = sorted(zip(right.column("bucket").to_pylist(), right.column("lengths").to_pylist(), right.column("ids").to_pylist()))
        for docs, counts, stream, buckets in zip(*[left.column(c).to_pylist() for c in ("ids", "counts", "stream", "buckets")]):
            counts, stream, of = _unpack(counts).astype(np.int64), _unpack_stream(stream), _unpack(buckets)
            order = np.argsort(of, kind="stable")  # the words as the buckets have them, one bucket after another
            dealt = np.concatenate([_unpack(r[1]) for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
            pool = np.concatenate([_unpack(r[2]) for r in rows]) if rows else np.zeros(0, np.uint32)
            if len(dealt) != len(of):
                raise ValueError("a block's words did not all come back")
            lengths, starts = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
            lengths[order], starts[order] = dealt, np.concatenate(([0], np.cumsum(dealt)))[:-1]
            ends = np.concatenate(([0], np.cumsum(counts)))
            i = 0
            while i < len(counts):  # texts of about CHUNK pre-tokens together
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + CHUNK, "right")) - 1)
                own = stream[ends[i] : ends[j]]
                per = lengths[own]
                ids = pool[_gather(starts[own], per)].astype("<u4")
                cut = np.concatenate(([0], np.cumsum(per)))[ends[i : j + 1] - ends[i]]
                size = token_starts[ids.astype(np.int64) + 1] - token_starts[ids]
                text = b"".join(token_bytes[_gather(token_starts[ids[k : k + CHUNK]], size[k : k + CHUNK])].tobytes() for k in range(0, len(ids), CHUNK))
                at = np.concatenate(([0], np.cumsum(size)))[cut].tolist()
                raw, cut = ids.tobytes(), cut.tolist()
                arrays = [docs[i:j], np.diff(cut).tolist(), [raw[4 * x : 4 * y] for x, y in zip(cut, cut[1:])], [text[x:y] for x, y in zip(at, at[1:])]]
                out.append(pa.table([pa.array(v, t.type) for v, t in zip(arrays, schema)], schema=schema))
                i = j
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _grouped(f):
    trimming = trimmed_group(f)

    def run(group: pa.Table) -> pa.Table:
        return trimming(group)

    return run


def _cogrouped(f):
    trimming = trimmed_group(f)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return trimming(left, right)

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded (bytes) of every row.

    path: ranks file of a vocabulary that has all single bytes; it is read on the driver (its size is fixed) and sent
    to the workers. pattern: what a pre-token is. A null text counts as empty; empty texts have no ids; repeated rows
    and repeated or null ids are kept each. A text lies in one block whole, however long; a block has block_tokens
    pre-tokens and one text more at most, and rows of a block and a bucket of words are as many as their numbers' product, so
    that executors with more memory should be given larger blocks. Other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = Shared(spark, load_ranks(path))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    size = text_bytes(docs, "text")
    n_buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    sql_kind = kind.simpleString()
    blocks = docs.mapInArrow(trimmed(_blocks(pattern, n_buckets, to_arrow_type(kind), block_tokens)), f"block long, ids array<{sql_kind}>, counts binary, stream binary, buckets binary, words binary")
    blocks = materialize(blocks, "bpe-blocks", bucket_by="block", n_buckets=n_buckets)
    dealt = blocks.select("block", "words", "buckets").mapInArrow(trimmed(_deal), "bucket long, block long, words binary")
    encoded = dealt.groupBy("bucket").applyInArrow(_grouped(_encode_bucket(shared, pattern)), "bucket long, block long, lengths binary, ids binary")
    left = blocks.select("block", "ids", "counts", "stream", "buckets").groupBy("block")
    return left.cogroup(encoded.groupBy("block")).applyInArrow(_cogrouped(_reassemble(shared, pattern, to_arrow_type(kind))), f"doc_id {sql_kind}, n_tokens long, ids binary, decoded binary")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Replaces nothing: adds `text`, the decoded ids, to rows that hold ids as encode() gives them.

    Null ids give a null text; bytes that are no UTF-8 are replaced; an unknown id fails.
    """
    spark = encoded.sparkSession
    arrow_limits(spark)
    shared = Shared(spark, load_ranks(path))

    @F.pandas_udf("string")
    def text(ids):
        table = shared.get(lambda r: {v: k for k, v in r.items()}, "table")
        return ids.map(lambda b: None if b is None else b"".join(table[i] for i in np.frombuffer(b, "<u4").tolist()).decode("utf-8", "replace"))

    return encoded.withColumn("text", text(F.col(ids_col)))
