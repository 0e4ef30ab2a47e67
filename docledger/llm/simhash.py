"""SimHash near-duplicates by a forest of vantage-point trees.

Fingerprints of 64 bits link at RADIUS (3) or fewer differing bits. Two halves of 32 bits carry a tree each: linked
fingerprints differ in one bit at most in one of the halves. Each branch of a tree has a vantage point of its own, on the
bits that its level owns; the levels' bits are disjoint, and the distance over them is a metric. A fingerprint is at home
in one leaf and visits the leaves that its ball of radius 1 reaches over a boundary, by the triangle bound
|d(x, v) - d(y, v)| <= d(x, y). Crossing one boundary uses up the one differing bit, so that no visitor crosses another:
copies grow with the number of levels, not with its power.

Each leaf prunes further by vantage points of its own, on all 64 bits, and links its exact pairs to one root each, so that
no group is written as all its pairs. A leaf with very many fingerprints is dealt to several tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm.common import arrow_limits, free, materialize, trimmed
from docledger.llm.graphs import components
from docledger.llm.passages import shingles

RADIUS, WORDS, SEED = 3, 3, 42
#: Fingerprints at home in a leaf, about, and in one task's share of a leaf at most; pairs compared at once.
LEAF, SHARE, TILE, SMALL = 2000, 20_000, 1 << 21, 256
#: Pairs of wide fingerprints compared at once: in a dense cloud nearly all of them are candidates.
WIDE_TILE = 1 << 18
#: Bits of a tree, and so its levels at most.
BITS = 32
#: Similar documents: five-word shingles, their Jaccard similarity, and a fingerprint of four words of 64 bits. The first word
#: has PARTS trees of 64 / PARTS bits: words that differ in fewer than 2 * PARTS bits differ in one bit at most in one of them.
#: Candidates differ in WIDE_RADIUS of all 256 bits at most: at a similarity of 0.8 the mean is 39 and the deviation 6.
SHINGLE, SIMILARITY, WIDE, PARTS, WIDE_RADIUS = 5, 0.8, 4, 8, 52
#: Nearest candidates that each tree gives a document in the first and in the second round; who has more is compared by shingles.
NEAREST, MORE = 1, 4


def level_bits(tree: int, levels: int, bits: int = BITS) -> list[np.uint64]:
    """The bits that each level of a tree owns: an odd number of the tree's own, in a fixed pseudo-random order."""
    order = np.random.Generator(np.random.PCG64(SEED + tree)).permutation(bits) + bits * tree
    size = bits // max(1, levels)
    size -= 1 - size % 2
    return [np.bitwise_or.reduce(np.uint64(1) << order[i * size : (i + 1) * size].astype(np.uint64)) for i in range(levels)]


def vantage(tree: int, level: int, branch: np.ndarray) -> np.ndarray:
    """The vantage points of branches: fixed pseudo-random bits."""
    x = branch.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(xxhash.xxh64_intdigest(f"{tree}:{level}", SEED))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None) -> int:
    """SimHash of the text's 3-word shingles, repeats included; A-Z in lower case; no words: 0."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        return digest(joined, SEED)  # one shingle: its own hash
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first, last = [0, *ends[:-WORDS].tolist()], (ends[WORDS - 1 :] - 1).tolist()
    counts, step = np.zeros(64, np.int64), 1 << 15
    for i in range(0, len(first), step):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[i : i + step], last[i : i + step])], ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(first)).view(">u8")[0])


def fingerprints(text: Column) -> Column:
    """The fingerprint of a text column, its 64 bits as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return of(text)


def plant(fps: np.ndarray, tree: int, levels: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which fingerprint, leaf, whether at home) for all places of the fingerprints in a tree."""
    who, code = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    home = np.ones(len(fps), bool)
    for level, own in enumerate(level_bits(tree, levels, bits)):
        d = np.bitwise_count((fps[who] ^ vantage(tree, level, code)) & own).astype(np.int64)
        t = int(own).bit_count() // 2  # as many distances up to here as beyond
        right = d > t
        over = home & ((d == t) | (d == t + 1))  # the ball reaches the other side; a visitor has no radius left
        code = np.concatenate((code * 2 + right, code[over] * 2 + ~right[over]))
        home = np.concatenate((home, np.zeros(over.sum(), bool)))
        who = np.concatenate((who, who[over]))
    return who, code, home


def _by_leaf(tree: int, who: np.ndarray, code: np.ndarray, home: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """tree, leaf, home and visitors: the records of each leaf, packed."""
    order = np.lexsort((~home, code))
    code, mine, at_home = code[order], records[who[order]], home[order]
    leaves, first = np.unique(code, return_index=True)
    cut = [*first.tolist(), len(code)]
    sets = [(mine[a:b], int(at_home[a:b].sum())) for a, b in zip(cut, cut[1:])]
    columns = [pa.array([tree] * len(sets), pa.int32()), pa.array(leaves, pa.int64()), pa.array([x[:n].tobytes() for x, n in sets], pa.binary()), pa.array([x[n:].tobytes() for x, n in sets], pa.binary())]
    return pa.record_batch(columns, names=["tree", "leaf", "home", "visitors"])


def _plant(levels: int):
    """Deals fingerprints to the leaves of both trees, packed by batch and leaf."""

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for tree in (0, 1):
                yield _by_leaf(tree, *plant(fps, tree, levels), fps)

    return run


def _dealt(planted: DataFrame, share: int, size: int) -> DataFrame:
    """tree, leaf, task, home and near: what is compared together.

    A leaf with more records (of `size` bytes) at home than a task's share is dealt to several tasks: each has a part of
    those at home, and meets all.
    """
    planted = materialize(planted, "simhash-leaves")
    sizes = planted.groupBy("tree", "leaf").agg((F.sum(F.length("home")) / size).alias("n"))
    large = sizes.where(F.col("n") > share).select("tree", "leaf", F.ceil(F.col("n") / share).cast("long").alias("tasks"))
    planted = planted.join(materialize(large, "simhash-large"), ["tree", "leaf"], "left").withColumn("tasks", F.coalesce("tasks", F.lit(1).cast("long")))
    none = F.lit(None).cast("binary")
    own = planted.select("tree", "leaf", F.pmod(F.xxhash64("home"), F.col("tasks")).alias("task"), "home", none.alias("near"))
    met = planted.select("tree", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), none.alias("home"), F.concat("home", "visitors").alias("near"))
    return own.union(met)


class _Sets:
    """Disjoint sets of positions; the least is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        out = self.up[at]
        while True:
            further = self.up[out]
            if (further == out).all():
                self.up[at] = out
                return out
            out = further

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] and b[i]; each round hangs a root under the least root that it is joined with."""
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.up, high, low)
            a, b = low, high


def _link(points: np.ndarray, home: np.ndarray, near: np.ndarray, sets: _Sets, depth: int = 0) -> None:
    """Joins all pairs of a home point and a near point within RADIUS. home, near: positions in points."""
    if not len(home) or not len(near):
        return
    if len(home) > SMALL and len(near) > SMALL and depth < 24:
        v = points[home[len(home) // 2]]  # a vantage point of this branch
        dh, dn = np.bitwise_count(points[home] ^ v).astype(np.int64), np.bitwise_count(points[near] ^ v).astype(np.int64)
        t = int(np.median(dh))
        low, high = dh <= t, dh > t
        if high.any() and low.any():  # by the triangle bound a near point counts on the sides within its radius
            _link(points, home[low], near[dn <= t + RADIUS], sets, depth + 1)
            _link(points, home[high], near[dn > t - RADIUS], sets, depth + 1)
            return
    step = max(1, TILE // len(near))
    for i in range(0, len(home), step):
        own = home[i : i + step]
        a, b = np.nonzero(np.bitwise_count(points[own][:, None] ^ points[near][None, :]) <= RADIUS)
        sets.join(own[a], near[b])


def _leaf(group: pa.Table) -> pa.Table:
    """Links of one task's share of a leaf, from each linked fingerprint to the least of its set here."""
    read = lambda c: np.unique(np.frombuffer(b"".join(x for x in group.column(c).to_pylist() if x), np.uint64))
    home, near = read("home"), read("near")
    points = np.union1d(home, near)
    sets = _Sets(len(points))
    _link(points, np.searchsorted(points, home), np.searchsorted(points, near), sets)
    roots = sets.roots(np.arange(len(points)))
    linked = np.flatnonzero(roots != np.arange(len(points)))
    return pa.table({"u": points[linked].view(np.int64), "v": points[roots[linked]].view(np.int64)})


def link_fingerprints(prints: DataFrame, leaf: int = LEAF, share: int = SHARE) -> DataFrame:
    """fp and root (of its component) of each fingerprint that links to another. prints: distinct fp (long)."""
    n = prints.count()
    levels = min(BITS, max(0, math.ceil(math.log2(n / leaf)))) if n else 0
    dealt = _dealt(prints.select("fp").mapInArrow(_plant(levels), "tree int, leaf long, home binary, visitors binary"), share, 8)
    edges = dealt.groupBy("tree", "leaf", "task").applyInArrow(_leaf, "u long, v long")
    return components(edges).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (64 bits as a signed long) and component_id (least doc_id reachable over links) of every row.

    Texts without words, null or not, have fingerprint 0 and link like any other. Repeated rows are kept each. A null id
    never names a component unless all ids in it are null. No rows give no rows; other columns are ignored.
    """
    arrow_limits(docs.sparkSession)
    prints = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col)).alias("fp")), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    linked = materialize(link_fingerprints(distinct), "simhash-links")
    names = distinct.join(linked, "fp").groupBy("root").agg(F.min("least").alias("name"))
    named = linked.join(names, "root").select("fp", "name")
    classes = materialize(distinct.join(named, "fp", "left").select("fp", F.coalesce("name", "least").alias("component_id")), "simhash-classes")
    # Written first, so that both sides are plain shuffles: a fingerprint with very many copies is split by the skew join.
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | bytes | None) -> np.ndarray:
    """The distinct 5-word shingles, sorted; of a shorter text all words as one; none without words."""
    found = shingles(text)
    if not len(found):
        words = (text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")).lower().split()
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    return np.unique(found)


def wide_fingerprint(members: np.ndarray) -> bytes:
    """SimHash of a set over WIDE words of 64 bits."""
    counts = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(members), 1 << 13):
        h = members[i : i + (1 << 13), None] + np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        counts += np.unpackbits((h ^ (h >> np.uint64(31))).view(np.uint8).reshape(len(h), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(members)).tobytes()


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _digest(members: np.ndarray) -> int:
    """Names a set, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(members.tobytes(), SEED)).astype(np.int64))


def _sketch(batches):
    for batch in batches:
        sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(list(map(_digest, sets)), pa.int64()), pa.array(list(map(len, sets)), pa.int32()), pa.array(list(map(wide_fingerprint, sets)), pa.binary())], names=["doc_id", "digest", "n", "wide"])


#: What a leaf holds of a document: its set, the group it is in, how many are in that, and its fingerprint.
RECORD = np.dtype([("digest", "<i8"), ("n", "<i4"), ("group", "<i8"), ("size", "<i4"), ("wide", "<u8", WIDE)])


def _plant_records(levels: int):
    def run(batches):
        for batch in batches:
            records = np.zeros(batch.num_rows, RECORD)
            for name in ("digest", "n", "group", "size"):
                records[name] = batch.column(name).to_numpy(zero_copy_only=False)
            records["wide"] = np.frombuffer(b"".join(batch.column("wide").to_pylist()), np.uint64).reshape(-1, WIDE)
            for tree in range(PARTS):
                yield _by_leaf(tree, *plant(records["wide"][:, 0], tree, levels, 64 // PARTS), records)

    return run


#: What a leaf says: a pair of candidates (x, y), a document (x) that has more than were given, a document (x) that is one of these.
PAIR, SEEKS, SOUGHT = 0, 1, 2


def _owned(a: np.ndarray, b: np.ndarray, tree: int) -> np.ndarray:
    """Whether no tree before this one brings two first words together: a pair belongs to one tree."""
    differ = a ^ b
    out = np.ones(len(a), bool)
    for t in range(tree):
        out &= np.bitwise_count((differ >> np.uint64(64 // PARTS * t)) & np.uint64((1 << 64 // PARTS) - 1)) > 1
    return out


def _candidates(most: int, similarity: float, first: bool):
    """kind, x and y: of each document at home its nearest candidates of other groups, `most` at most; beyond the first round also
    who has more than these, and who those are.

    There the smaller group looks for the larger one, so that a few that stand alone do not set all of a large group looking.
    """

    def run(group: pa.Table) -> pa.Table:
        read = lambda c: np.unique(np.frombuffer(b"".join(x for x in group.column(c).to_pylist() if x), RECORD))
        home, near, tree = read("home"), read("near"), group.column("tree")[0].as_py()
        kinds, xs, ys = [], [], []

        def say(kind, x, y):
            kinds.append(np.full(len(x), kind, np.int32))
            xs.append(x)
            ys.append(y)

        sought, step = np.zeros(len(near), bool), max(1, WIDE_TILE // max(1, len(near)))
        for i in range(0, len(home), step):
            own = home[i : i + step]
            a, b = np.nonzero(np.bitwise_count(own["wide"][:, 0][:, None] ^ near["wide"][:, 0][None, :]) < 2 * PARTS)
            apart = own["group"][a] != near["group"][b]
            a, b = a[apart], b[apart]
            apart = _owned(own["wide"][a, 0], near["wide"][b, 0], tree)
            a, b = a[apart], b[apart]
            d = np.bitwise_count(own["wide"][a] ^ near["wide"][b]).sum(1, dtype=np.int64)
            sizes = np.minimum(own["n"][a], near["n"][b]) >= similarity * np.maximum(own["n"][a], near["n"][b]) - 1e-9
            fits = (d <= WIDE_RADIUS) & sizes
            if not first:
                fits &= (own["size"][a] < near["size"][b]) | ((own["size"][a] == near["size"][b]) & (own["group"][a] < near["group"][b]))
            a, b, d = a[fits], b[fits], d[fits]
            if not len(a):
                continue
            order = np.lexsort((near["digest"][b], d, a))
            a, b = a[order], b[order]
            begins = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            kept = np.arange(len(a)) - np.repeat(begins, np.diff(np.append(begins, len(a)))) < most
            if not first:
                more = np.unique(a[~kept])
                say(SEEKS, own["digest"][more], np.zeros(len(more), np.int64))
                sought[b[np.isin(a, more)]] = True
            x, y = own["digest"][a[kept]], near["digest"][b[kept]]
            say(PAIR, np.minimum(x, y), np.maximum(x, y))
        say(SOUGHT, near["digest"][sought], np.zeros(int(sought.sum()), np.int64))
        return pa.table({"kind": pa.array(np.concatenate(kinds), pa.int32()), "x": pa.array(np.concatenate(xs), pa.int64()), "y": pa.array(np.concatenate(ys), pa.int64())})

    return run


def _shingle_rows(batches):
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            members = shingle_set(unpack.decompress(raw))
            yield pa.record_batch([pa.array(np.full(len(members), d, np.int64)), pa.array(members.view(np.int64)), pa.array(np.full(len(members), len(members), np.int64))], names=["digest", "shingle", "n"])


def _sharing(pool: DataFrame, groups: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """x and y: pairs of a document that seeks and one that is sought, of different groups, that may be alike by their rarest shingles.

    Of sets of n and m members that are alike, o = s / (1 + s) * (n + m) are common at least; in one order of all shingles, rare
    ones first, a common one is then among the first n - o + 1 of the one and m - o + 1 of the other. So no pair is lost, and
    an edited copy whose edits are its own meets nobody.
    """
    rows = texts.join(pool.select("digest").distinct(), "digest", "left_semi").mapInArrow(_shingle_rows, "digest long, shingle long, n long")
    rows = materialize(rows, "similar-shingles")
    counted = rows.groupBy("shingle").agg(F.count("*").alias("df"))
    nth = F.row_number().over(Window.partitionBy("digest").orderBy("df", "shingle"))
    ranked = rows.join(counted, "shingle").withColumn("at", nth).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1)
    ranked = materialize(ranked.join(groups, "digest"), "similar-prefixes")
    side = lambda kind, p: ranked.join(pool.where(F.col("kind") == kind).select("digest").distinct(), "digest", "left_semi").select(F.col("digest").alias(p), "shingle", *[F.col(c).alias(f"{p}_{c}") for c in ("n", "at", "group")])
    o = F.ceil((F.col("x_n") + F.col("y_n")) * (similarity / (1 + similarity)) - 1e-9)
    fits = (F.col("x_group") != F.col("y_group")) & (F.col("x_at") <= F.col("x_n") - o + 1) & (F.col("y_at") <= F.col("y_n") - o + 1)
    met = side(SEEKS, "x").join(side(SOUGHT, "y"), "shingle").where(fits)
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _texts(batches):
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        raw = [(d, (t or "").encode("utf-8", "surrogatepass")) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        kept = [(d, pack(t)) for d, t in raw if _digest(shingle_set(t)) == d]
        if kept:
            yield pa.record_batch([pa.array([d for d, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.binary())], names=["digest", "text"])


def _verify(similarity: float):
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        last = members = None
        for batch in batches:
            good = []
            for y, a, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if last != y:
                    last, members = y, shingle_set(unpack.decompress(b))
                good.append(jaccard(shingle_set(unpack.decompress(a)), members) >= similarity)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["x", "y", "good"])

    return run


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, leaf: int = LEAF, share: int = SHARE) -> DataFrame:
    """doc_id and first: every row with an id, and the least id of its group.

    A group is what links of a Jaccard similarity of `similarity` or more over the distinct 5-word shingles hold together.
    Candidates are near in SimHash and come from vantage-point trees; each link is verified on the whole texts. Links go by
    rounds: the nearest candidates first, then more of those that are still in another group; who has still more is compared
    with those that share one of its rarest shingles, which loses no link. So a large group is never compared in all its pairs. Texts of fewer than five words count as one shingle; those without
    words, null or not, are alike. Rows without an id are left out; rows of one id are one document.
    """
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    kind = rows.schema["doc_id"].dataType.simpleString()
    prints = materialize(rows.mapInArrow(trimmed(_sketch), f"doc_id {kind}, digest long, n int, wide binary"), "similar-prints")
    distinct = materialize(prints.groupBy("digest").agg(F.min("doc_id").alias("least"), F.any_value("n").alias("n"), F.any_value("wide").alias("wide")), "similar-distinct")
    n = distinct.count()
    levels = min(64 // PARTS, max(0, math.ceil(math.log2(n / leaf)))) if n else 0
    grouped = distinct.select("digest", F.col("digest").alias("group"), F.lit(1).alias("size"))
    held: list[DataFrame] = []  # texts, each document's once

    def text_of(digests: DataFrame) -> DataFrame:
        needed = digests.distinct()
        for known in held:
            needed = needed.join(known.select("digest"), "digest", "left_anti")
        needed = materialize(distinct.join(needed, "digest", "left_semi").select("digest", F.col("least").alias("doc_id")), "similar-needed")
        held.append(materialize(rows.join(needed, "doc_id").select("digest", "text").mapInArrow(trimmed(_texts), "digest long, text binary").dropDuplicates(["digest"]), "similar-texts"))
        out = held[0]
        for more in held[1:]:
            out = out.union(more)
        return out

    def verified(pairs: DataFrame) -> DataFrame:
        texts = text_of(pairs.select(F.col("x").alias("digest")).union(pairs.select("y")))
        full = pairs.join(texts.select(F.col("digest").alias("x"), F.col("text").alias("a")), "x").join(texts.select(F.col("digest").alias("y"), F.col("text").alias("b")), "y").select("x", "y", "a", "b")
        return materialize(full.mapInArrow(trimmed(_verify(similarity)), "x long, y long, good boolean"), "similar-verified")

    def regrouped(edges: DataFrame) -> DataFrame:
        labels = materialize(components(edges, "x", "y"), "similar-labels")
        sizes = labels.groupBy("root").agg(F.count("*").cast("int").alias("size"))
        named = distinct.select("digest").join(labels.select(F.col("node").alias("digest"), "root"), "digest", "left").join(sizes, "root", "left")
        return materialize(named.select("digest", F.coalesce("root", "digest").alias("group"), F.coalesce("size", F.lit(1)).alias("size")), "similar-groups")

    edges = tried = None
    for most in (NEAREST, MORE):
        state = distinct.select("digest", "n", "wide").join(grouped, "digest")
        if tried is not None:  # who had no candidate in the first round has none
            state = state.join(materialize(tried.select(F.col("x").alias("digest")).union(tried.select("y")).distinct(), "similar-met"), "digest", "left_semi")
        planted = state.mapInArrow(_plant_records(levels), "tree int, leaf long, home binary, visitors binary")
        found = materialize(_dealt(planted, share, RECORD.itemsize).groupBy("tree", "leaf", "task").applyInArrow(_candidates(most, similarity, most == NEAREST), "kind int, x long, y long"), "similar-found")
        pairs = found.where(F.col("kind") == PAIR).select("x", "y").distinct()
        checked = verified(materialize(pairs if tried is None else pairs.join(tried, ["x", "y"], "left_anti"), "similar-pairs"))
        good = checked.where("good").select("x", "y")
        tried, edges = (checked.select("x", "y"), good) if tried is None else (tried.union(checked.select("x", "y")), edges.union(good))
        grouped = regrouped(edges)
    pool = materialize(found.where(F.col("kind") != PAIR).select("kind", F.col("x").alias("digest")).distinct(), "similar-pool")
    if not pool.isEmpty():
        pairs = _sharing(pool, grouped.select("digest", "group"), text_of(pool.select("digest")), similarity)
        checked = verified(materialize(pairs.join(tried, ["x", "y"], "left_anti"), "similar-pairs"))
        grouped = regrouped(edges.union(checked.where("good").select("x", "y")))
    free(*held)
    named = distinct.join(grouped.select("digest", F.col("group").alias("root")), "digest")
    firsts = named.groupBy("root").agg(F.min("least").alias("first"))
    named = materialize(named.join(firsts, "root").select("digest", "first"), "similar-named")
    return prints.join(named, "digest").select("doc_id", "first")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The ids (doc_id) to drop, each once, so that one document of each group of similar_groups() stays: the one of the least id."""
    return similar_groups(docs, id_col, text_col, similarity).where("doc_id > first").select("doc_id").distinct()
