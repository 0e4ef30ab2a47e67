"""Exact top-k by inner product, in three phases with a uniform threshold.

A vector's components are cut into LISTS segments; a segment's products are one list of local scores. The candidates stay
where they are, in the partitions of a written table; the queries come to them in blocks of bounded size.

1. Each partition gathers the k best of every list of a query, and the totals of these few. Over all partitions the k-th
   best of them is a safe cutoff: at least k candidates reach it.
2. The cutoffs are broadcast. A candidate that reaches a cutoff has cutoff / LISTS in one list at least; each partition
   collects the entries that do, and drops those whose other lists cannot make up the rest. Candidates and queries whose
   norms cannot reach a cutoff (Cauchy's bound over the segments) are left out before anything is multiplied.
3. What is left is resolved exactly, and the k best of all partitions are the answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docledger.llm.common import Shared, arrow_limits, materialize

#: Lists; bytes of the vectors of a block of queries (as doubles); queries multiplied at once.
LISTS, BLOCK_BYTES, TILE = 4, 64 << 20, 256
#: Products of whole numbers are exact in doubles below this.
EXACT = 2.0**53


def valid(vector: Column) -> Column:
    """Neither null nor with a null, infinite or undefined component."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))


def _partials(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """The local scores of each list, exact: as doubles where they fit, else as Python's integers."""
    cut = _cuts(q.shape[1])
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound < EXACT:
        return [q[:, a:b] @ c[:, a:b].T for a, b in zip(cut, cut[1:])]
    as_int = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    q, c = as_int(q), as_int(c)
    return [q[:, a:b].dot(c[:, a:b].T) if b > a else np.zeros((len(q), len(c)), dtype=object) for a, b in zip(cut, cut[1:])]


def _cuts(dim: int) -> list[int]:
    return [dim * i // LISTS for i in range(LISTS + 1)]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], dtype=np.int64)


SCORES = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
LIMIT = 2**63 - 1


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    clip = lambda v: max(-LIMIT - 1, min(LIMIT, int(v)))
    return pa.record_batch([pa.array([clip(r[k]) for r in rows], pa.int64()) for k in range(4)], schema=SCORES)


def _norms(m: np.ndarray) -> np.ndarray:
    """The length of each segment of each row."""
    cut = _cuts(m.shape[1])
    return np.stack([np.sqrt((m[:, a:b] ** 2).sum(1)) for a, b in zip(cut, cut[1:])], 1)


class Block:
    """A block of queries, by the length of their vectors: ids, keys and a matrix."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        self.by_dim: dict[int, list] = {}
        for query_id, key, raw in rows:
            self.by_dim.setdefault(len(raw) // 8, []).append((query_id, key, raw))
        for dim, own in self.by_dim.items():
            matrix = np.frombuffer(b"".join(r[2] for r in own), np.float64).reshape(len(own), dim)
            self.by_dim[dim] = (np.array([r[0] for r in own], np.int64), [r[1] for r in own], matrix)


def _shapes(batch: pa.RecordBatch):
    """(ids, matrix) of the rows of each vector length."""
    ids, vectors = batch.column(0).to_numpy(), batch.column(1)
    dims = np.asarray(vectors.value_lengths())
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield ids[at], np.floor(256.0 * flat).reshape(len(at), dim)


def _heads(list_: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of a list for each query, its own row last."""
    n = list_.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(list_), 1))
    if list_.dtype == object:
        return np.array([sorted(range(n), key=lambda i: (bool(o[i]), -row[i]))[:k] for row, o in zip(list_, own)])
    return np.argpartition(np.where(own, -np.inf, list_), n - k, axis=1)[:, n - k :]


def _gather(shared: Shared, k: int):
    """Phase 1: of each query the k best totals among the k best of each list."""

    def run(batches):
        block, held, floor = shared.get(Block), {}, {}
        for batch in batches:
            for ids, c in _shapes(batch):
                if c.shape[1] not in block.by_dim:
                    continue
                names, _, q = block.by_dim[c.shape[1]]
                for i in range(0, len(q), TILE):
                    parts = _partials(q[i : i + TILE], c)
                    own = ids[None, :] == names[i : i + TILE, None]
                    seen = np.concatenate([_heads(p, own, k) for p in parts], 1)
                    total = sum(np.take_along_axis(p, seen, 1) for p in parts)
                    fits = ~np.take_along_axis(own, seen, 1)
                    # Most batches have nothing above what a query holds already.
                    least = np.array([floor.get((c.shape[1], i + r), -np.inf) for r in range(len(total))])
                    fits &= (total > least[:, None]).astype(bool)
                    for r in np.flatnonzero(fits.any(1)).tolist():
                        at = c.shape[1], i + r
                        mine = held.setdefault(at, {})
                        for x in np.flatnonzero(fits[r]).tolist():
                            who = int(ids[seen[r, x]])
                            mine[who] = max(int(total[r, x]), mine.get(who, -LIMIT - 1))
                        if len(mine) >= k:
                            held[at] = dict(sorted(mine.items(), key=lambda x: (-x[1], x[0]))[:k])
                            floor[at] = float(min(held[at].values()))
        for (dim, i), mine in held.items():
            names, keys, _ = block.by_dim[dim]
            best = sorted(mine.items(), key=lambda x: (-x[1], x[0]))[:k]
            if best:
                yield _rows([(names[i], keys[i], x, s) for x, s in best])

    return run


def _resolve(shared: Shared, cutoffs: Shared, k: int):
    """Phases 2 and 3: what may reach the cutoff, exactly."""

    def run(batches):
        block, cutoff = shared.get(Block), cutoffs.get()
        for batch in batches:
            rows = []
            for ids, c in _shapes(batch):
                if c.shape[1] not in block.by_dim:
                    continue
                names, keys, q = block.by_dim[c.shape[1]]
                cuts = np.array([float(cutoff.get((int(n), x), -np.inf)) for n, x in zip(names, keys)])
                for i in range(0, len(q), TILE):
                    bound = _norms(q[i : i + TILE]) @ _norms(c).T
                    may = (bound * (1 + 1e-9) + 1 >= cuts[i : i + TILE, None]) & (ids[None, :] != names[i : i + TILE, None])
                    own, kept = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
                    if not len(own):
                        continue
                    parts = _partials(q[i + own], c[kept])
                    for r, at in enumerate(own.tolist()):
                        reach, can = cuts[i + at], may[at, kept]
                        if np.isfinite(reach):
                            share = reach / LISTS
                            seen = [p[r] >= share for p in parts]
                            known = sum((np.where(s, p[r], 0) for s, p in zip(seen, parts)), np.zeros(len(kept)))
                            hidden = LISTS - sum(s.astype(np.int64) for s in seen)
                            can = can & (hidden < LISTS) & (known + hidden * share >= reach - 1)  # a unit of room for the share's rounding
                        left = np.flatnonzero(can)
                        if len(left):
                            total = sum((p[r, left] for p in parts[1:]), parts[0][r, left])
                            for x in _best(total, ids[kept[left]], k).tolist():
                                if total[x] >= reach:
                                    rows.append((names[i + at], keys[i + at], ids[kept[left[x]]], total[x]))
            if rows:
                yield _rows(rows)

    return run


def _floored(batches):
    for batch in batches:
        vectors = [np.floor(256.0 * np.array(v, np.float64)).tobytes() for v in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], names=["query_id", "query_key", "vector"])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each query (all, if fewer).

    Components are floor(256 * x) as whole numbers; scores are exact, and held within 64 bits if beyond. Ties go to the
    smaller id. A query's own id is never its candidate: no row with that id is, whatever its vector. Vectors that are null
    or hold a null or non-finite component take no part; a query meets vectors of its own length only. Query rows alike in id
    and vector are answered once, rows of one id and several vectors each; repeated candidates count as often as they are
    there. Null ids take no part. Other columns are ignored. No queries or no candidates give no rows. The candidates are
    read twice for each block of queries.
    """
    spark = queries.sparkSession
    arrow_limits(spark)

    def shaped(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
        return df.where(F.col("vec_id").isNotNull() & valid(F.col("vector")))

    key = ["query_id", "query_key"]
    q = shaped(queries).select(F.col("vec_id").alias("query_id"), F.xxhash64("vec_id", "vector").alias("query_key"), "vector").dropDuplicates(key)
    q = materialize(q.mapInArrow(_floored, "query_id long, query_key long, vector binary"), "topk-queries")
    c = materialize(shaped(candidates), "topk-candidates")
    size = q.agg(F.coalesce(F.sum(F.length("vector") + 64), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, -(-size // block_bytes))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), "vec_id")))
    layout, answers = "query_id long, query_key long, vec_id long, score long", []
    for b in range(n_blocks):
        rows = q.where(F.pmod("query_key", F.lit(n_blocks)) == b).collect()  # about block_bytes
        shared = Shared(spark, [(r[0], r[1], bytes(r[2])) for r in rows])
        cutoffs = ranked(c.mapInArrow(_gather(shared, k), layout)).where(F.col("rank") == k).select(*key, "score").collect()  # one for each query of the block
        reach = Shared(spark, {(r[0], r[1]): r[2] for r in cutoffs})
        found = ranked(c.mapInArrow(_resolve(shared, reach, k), layout)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        answers.append(found if n_blocks == 1 else materialize(found, "topk-answers"))
    out = answers[0]
    if n_blocks > 1:
        out = spark.read.schema(out.schema).parquet(*[p for df in answers for p in df.inputFiles()])
    return out
