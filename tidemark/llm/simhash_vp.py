"""SimHash near-duplicates through a vantage-point tree over Hamming space.

Documents become 64-bit fingerprints of their word shingles.  Equal
fingerprints collapse to one point first, so any number of exact copies costs
one point.  A vantage-point tree, fitted on a bounded sample of the points,
splits the fingerprints into leaves by their distance to vantage points.  A
point can have partners only in leaves that its ball of ``max_bits`` overlaps:
with ``d`` the distance to a node's vantage point and ``mu`` the node's radius,
the triangle inequality rules out the inner branch when ``d - max_bits > mu``
and the outer branch when ``d + max_bits <= mu``.  Each point goes to its own
leaf as data and to the overlapping leaves of higher number as query, so every
pair is met exactly once, and exactly.  Leaves are cut into cells of bounded
size; a cell returns one edge per linked point (to its local root), never all
pairs.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import Cells, UnionFind, bounded_sample, components, named, stored

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Points of the sample that fits the tree, and points a leaf should hold.
SAMPLE_POINTS = 8_192
LEAF_POINTS = 16_384
#: Bounds the temporary arrays of one comparison (elements).
CHUNK = 262_144


def fingerprint_bytes(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Fingerprint of UTF-8 ``text``: ASCII lower case, words between ASCII
    white space, shingles joined by one space; a bit is set if it is set in
    over half of the shingles' XXH64 values."""
    import xxhash
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(ends + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in
                       zip(starts[: len(words) - shingle_words + 1].tolist(), ends[shingle_words - 1:].tolist())],
                      dtype=np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The word whose bits are set in over half of ``hashes`` (uint64)."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 32_768):
        bits = np.unpackbits(hashes[i:i + 32_768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp long)``, one row per document; null text counts as no words."""
    def run(batches):
        for b in batches:
            fps = [0 if t is None else fingerprint_bytes(t, shingle_words, seed) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
            .mapInArrow(run, "doc_id long, fp long"))


@dataclass
class VpTree:
    """Node n has children 2n+1 (inner, d <= mu) and 2n+2 (outer); the leaves
    are the 2**depth nodes of the last level."""
    depth: int
    points: np.ndarray
    mu: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int) -> "VpTree":
        """Vantage point of a node: of a few candidates the one whose distances
        to the node's sample spread most; radius: their median."""
        n = 2 ** depth - 1
        points, mu = np.zeros(n, np.uint64), np.zeros(n, np.int16)
        parts = {0: sample}
        for node in range(n):
            own = parts.pop(node)
            if len(own):
                tried = own[:: max(1, len(own) // 8)][:8]
                d = np.bitwise_count(tried[:, None] ^ own[None, :])
                best = int(d.astype(float).std(axis=1).argmax())
                points[node], mu[node] = tried[best], int(np.median(d[best]))
                inner = d[best] <= mu[node]
            else:
                inner = np.zeros(0, bool)
            parts[2 * node + 1], parts[2 * node + 2] = own[inner], own[~inner]
        return cls(depth, points, mu)

    def home(self, fps: np.ndarray) -> np.ndarray:
        node = np.zeros(len(fps), np.int64)
        for _ in range(self.depth):
            d = np.bitwise_count(fps ^ self.points[node])
            node = 2 * node + 1 + (d > self.mu[node])
        return node - (2 ** self.depth - 1)

    def overlapping(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(point index, leaf) of every leaf that the point's ball overlaps."""
        at, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for _ in range(self.depth):
            d = np.bitwise_count(fps[at] ^ self.points[node]).astype(np.int16)
            inner, outer = d - radius <= self.mu[node], d + radius > self.mu[node]
            at, node = (np.concatenate([at[inner], at[outer]]),
                        np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2]))
        return at, node - (2 ** self.depth - 1)

    def visits(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Overlapped leaves numbered above the point's own one."""
        at, leaf = self.overlapping(fps, radius)
        above = leaf > self.home(fps)[at]
        return at[above], leaf[above]


def close_pairs(queries: np.ndarray, data: np.ndarray, radius: int, vantage: np.uint64, upper: bool):
    """Yield (query index, data index) arrays of all pairs within ``radius``.

    Both sides are ordered by distance to ``vantage``; a query is compared with
    the data shells within ``radius`` of its own distance (triangle bounds).
    ``upper``: both sides are the same array, yield pairs with query < data.
    """
    dq, dd = np.bitwise_count(queries ^ vantage), np.bitwise_count(data ^ vantage)
    oq, od = np.argsort(dq, kind="stable"), np.argsort(dd, kind="stable")
    edges = np.searchsorted(dd[od], np.arange(66 + 2 * radius) - radius)     # start of shell s at s + radius
    shells = np.searchsorted(dq[oq], np.arange(66))
    for s in range(65):
        own = oq[shells[s]:shells[s + 1]]
        near = od[edges[s]:edges[s + 2 * radius + 1]]
        if not len(own) or not len(near):
            continue
        right, step = data[near], max(1, CHUNK // len(near))
        for i in range(0, len(own), step):
            left = own[i:i + step]
            a, b = np.nonzero(np.bitwise_count(queries[left][:, None] ^ right[None, :]) <= radius)
            a, b = left[a], near[b]
            if upper:
                a, b = a[a < b], b[a < b]
            if len(a):
                yield a, b


def near_pairs_edges(points: DataFrame, max_bits: int = MAX_BITS, sample_points: int = SAMPLE_POINTS,
                     leaf_points: int = LEAF_POINTS, cell_rows: int | None = None) -> DataFrame:
    """``points(fp, rep)`` with distinct fp -> edges ``(a, b)`` over rep.

    The edges connect exactly what the pairs within ``max_bits`` connect.  The
    tree (at most ``sample_points`` long values) and the leaf counts are the
    only things the driver holds.
    """
    n = points.count()
    if n < 2:
        return points.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    sample = np.array([r.fp for r in bounded_sample(points.select("fp"), "fp", sample_points).collect()],
                      np.int64).view(np.uint64)
    depth = int(np.ceil(np.log2(max(1, n / leaf_points))))
    tree = VpTree.fit(sample, min(max(depth, 2), int(np.log2(max(4, len(sample)))) - 1))

    def count(batches):
        home, visit = {}, {}
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for into, leaves in ((home, tree.home(fps)), (visit, tree.visits(fps, max_bits)[1])):
                for leaf, k in zip(*(x.tolist() for x in np.unique(leaves, return_counts=True))):
                    into[leaf] = into.get(leaf, 0) + k
        rows = [(False, *x) for x in home.items()] + [(True, *x) for x in visit.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["visiting", "leaf", "n"])

    counts = (points.select("fp").mapInArrow(count, "visiting boolean, leaf long, n long")
              .groupBy("visiting", "leaf").agg(F.sum("n").alias("n")).collect())      # two rows per leaf
    cells = Cells({r.leaf: r.n for r in counts if not r.visiting}, {r.leaf: r.n for r in counts if r.visiting},
                  *([cell_rows] if cell_rows else []))

    def deal(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            reps = b.column(1).to_numpy(zero_copy_only=False)
            salt = ((fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)
            at, leaf = tree.visits(fps, max_bits)
            for idx, (i, lf, x, y, q) in ((np.arange(len(fps)), cells.deal(tree.home(fps), salt, False)),
                                          (at, cells.deal(leaf, salt[at], True))):
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lf), pa.array(x), pa.array(y), pa.array(q), pa.array(fps[idx[i]].view(np.int64)),
                         pa.array(reps[idx[i]])], names=["leaf", "x", "y", "query", "fp", "rep"])

    def link(key, t):
        fps = t.column("fp").to_numpy().view(np.uint64)
        reps, query = t.column("rep").to_numpy(), t.column("query").to_numpy(zero_copy_only=False)
        order = np.argsort(reps, kind="stable")
        fps, reps, query = fps[order], reps[order], query[order]
        leaf, x, y = (k.as_py() for k in key)
        data, asked = np.flatnonzero(~query), np.flatnonzero(query)
        if x == y:                                     # a home block against itself
            asked = data
        sets = UnionFind(len(fps))
        vantage = tree.points[(leaf + 2 ** tree.depth - 2) // 2]
        for a, b in close_pairs(fps[asked], fps[data], max_bits, vantage, x == y):
            sets.join(asked[a], data[b])
        moved = np.flatnonzero(sets.up != np.arange(len(fps)))
        return pa.table({"a": reps[moved], "b": reps[sets.up[moved]]}, schema=pa.schema([("a", "int64"), ("b", "int64")]))

    dealt = points.select("fp", "rep").mapInArrow(
        deal, "leaf long, x long, y long, query boolean, fp long, rep long")
    return dealt.groupBy("leaf", "x", "y").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, **options) -> DataFrame:
    """``(doc_id, fp long, component_id)``, one row per row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other.  Rows
    with a null id keep their fingerprint, link with nothing and have a null
    component.  Repeated rows are copies of one another.  Only the id and text
    columns are read, so other columns may have any name.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle_words))
    points = stored(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # one document can carry two fingerprints (a repeated id): then its rows meet in one component
    repeated = fps.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    shared = fps.join(repeated.select("doc_id"), "doc_id", "left_semi").join(points, "fp").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    edges = near_pairs_edges(points, max_bits, **options).union(shared)
    comp = components(edges)
    labelled = points.join(comp, points.rep == comp.node, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(labelled, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
             max_bits: int = MAX_BITS, **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicate texts: the one with the
    smallest id, among equal ids the smallest hash of the text.

    Groups are formed over texts: rows that share an id but not a similar text both
    stay.  Of rows equal in id and text one stays.  Rows with a null id stay.
    """
    text_hash = F.xxhash64(F.col(text_col))
    own = docs.where(F.col(id_col).isNotNull())
    keyed = own.select(F.col(id_col).cast("long").alias("doc"), text_hash.alias("th"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            fps = [0 if t is None else fingerprint_bytes(t, shingle_words) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc", "th", "fp"])

    fps = stored(keyed.mapInArrow(run, "doc long, th long, fp long"))
    points = stored(fps.groupBy("fp").agg(F.min(F.struct("doc", "th")).alias("first")))
    comp = components(near_pairs_edges(points.select("fp", F.col("fp").alias("rep")), max_bits, **options))
    group = points.join(comp, points.fp == comp.node, "left").select(F.coalesce("component", "fp").alias("group"), "first")
    kept = group.groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.doc").alias("__doc"), F.col("first.th").alias("__th"))
    one = (own.withColumn("__doc", F.col(id_col).cast("long")).withColumn("__th", text_hash).join(kept, ["__doc", "__th"], "left_semi")
           .dropDuplicates(["__doc", "__th"]))
    return one.select(named(docs.columns)).union(docs.where(F.col(id_col).isNull()).select(named(docs.columns)))
