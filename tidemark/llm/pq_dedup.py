"""Near-duplicate vectors by product quantisation, exact after reranking.

Equal vectors collapse to one point first.  Points go to the nearest of the
coarse centroids (inverted lists); their residuals are coded by one codebook
per subspace.  Centroids and codebooks are fitted on a bounded sample, every
point is indexed.

Lists hold about ``LIST_ROWS`` points whatever their number: beyond what the
sample can fit in one level, each list is cut again by a second set of centroids
over the residuals, shared by all lists.

Probes.  A point is compared with the points of its own list and, as a query,
with those of its next nearest lists, ``PROBES`` in all; a pair is met if either
of the two probes the other's list, and counted by one of them.  So the work
grows with the number of points.  Recall is measured against brute force (tests
and README); every link found is exact.

``probes=None`` is the exact mode: let c be x's own centroid, c' another, and y a point
of the list of c' within distance r of x.  As y is no nearer to c than to c',
``x.(c - c') <= |x - y| |c - c'| <= r |c - c'|``: lists that fail the bound hold
no partner, all others are probed, the ones of higher number only.  That loses
nothing, but without clusters it probes a large part of all lists.

Inside a list the distance of a query to a code is a sum of table lookups
(asymmetric: the query is not quantised).  A code's distance differs from the
vector's by at most the vector's own quantisation error, which is kept; pairs
above ``r + error`` are dropped, the rest get their exact cosine in double
precision.  So no link inside the probed lists is lost, whatever the quality of the fit.

Cells return, per vector with links, the weighted number of its partners and
one edge to its local root; pairs never leave a cell.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import Cells, UnionFind, bounded_sample, components, stored

MIN_COSINE = 0.95
#: Points of the sample that fits centroids and codebooks; points a list should hold; sample points per centroid at least.
SAMPLE_ROWS, LIST_ROWS, FIT_ROWS = 65_536, 256, 16
#: Lists a point is compared with, its own included.
PROBES = 8
SUBSPACES, CODES = 8, 64
CHUNK = 131_072
#: Elements of a block of (vector, centre) products: memory of a fit does not grow with vectors times centres.
BLOCK = 2_097_152
#: Slack of the pruning bounds for rounding.
SLACK = 1e-6


def _closest(x: np.ndarray, c: np.ndarray, half: np.ndarray | float = 0.0) -> np.ndarray:
    """Per row of ``x`` the row of ``c`` with the largest product less ``half``, block by block."""
    out, step = np.zeros(len(x), np.int64), max(1, BLOCK // max(1, len(c)))
    for i in range(0, len(x), step):
        out[i:i + step] = (x[i:i + step] @ c.T - half).argmax(1)
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, unit: bool = False) -> np.ndarray:
    """Lloyd from evenly spaced rows; empty clusters keep their centre."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _closest(x, c, 0.5 * (c * c).sum(1))
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass
class Quantiser:
    """Centroids (unit vectors), in the two-level form shared second-level ones,
    and codebooks over the subspaces of what remains."""
    coarse: np.ndarray
    fine: np.ndarray | None
    books: list[np.ndarray]
    cuts: list[tuple[int, int]]
    radius: float

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, min_cosine: float, levels: bool = True) -> "Quantiser":
        most = max(1, len(sample) // FIT_ROWS)
        coarse = np.unique(_kmeans(sample, min(lists, most), unit=True), axis=0)
        residual = sample - coarse[_closest(sample, coarse)]
        fine = np.unique(_kmeans(residual, min(-(-lists // most), most)), axis=0) if levels and lists > most else None
        quantiser = cls(coarse, fine, [], [], float(np.sqrt(2 - 2 * min_cosine)))
        residual = sample - quantiser.centre(quantiser.nearest(sample, 1)[:, 0])
        edges = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        quantiser.cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        quantiser.books = [_kmeans(residual[:, a:b], min(CODES, len(sample))) for a, b in quantiser.cuts]
        return quantiser

    @property
    def lists(self) -> int:
        return len(self.coarse) * (1 if self.fine is None else len(self.fine))

    def centre(self, which: np.ndarray) -> np.ndarray:
        if self.fine is None:
            return self.coarse[which]
        return self.coarse[which // len(self.fine)] + self.fine[which % len(self.fine)]

    def nearest(self, x: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest lists of each row, nearest first."""
        out = []
        wide = max(len(self.coarse), 0 if self.fine is None else min(count, len(self.coarse)) * max(len(self.fine), x.shape[1]))
        step = max(1, min(2_048, BLOCK // wide))
        for i in range(0, len(x), step):
            own = x[i:i + step]
            far = -own @ self.coarse.T
            k = min(count, far.shape[1])
            at = np.argpartition(far, k - 1, axis=1)[:, :k] if k < far.shape[1] else np.tile(np.arange(k), (len(own), 1))
            far = np.take_along_axis(far, at, 1)
            if self.fine is not None:
                rest = own[:, None, :] - self.coarse[at]
                far = ((rest * rest).sum(2)[:, :, None] - 2 * rest @ self.fine.T + (self.fine ** 2).sum(1)).reshape(len(own), -1)
                at = (at[:, :, None] * len(self.fine) + np.arange(len(self.fine))).reshape(len(own), -1)
            order = np.lexsort((at, far), axis=1)[:, :count]
            out.append(np.take_along_axis(at, order, 1))
        return np.concatenate(out) if out else np.zeros((0, 1), np.int64)

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.nearest(x, 1)[:, 0]

    def probes(self, x: np.ndarray, count: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(point, list) of the lists to visit beside the own one."""
        if count is not None:
            near = self.nearest(x, count)
            point, at = np.nonzero(near != self.home(x)[:, None])
            return point, near[point, at]
        dots, c = x @ self.coarse.T, self.coarse
        own = self.home(x)
        apart = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
        open_ = dots[np.arange(len(x)), own][:, None] - dots <= self.radius * apart[own] + SLACK
        open_ &= np.arange(len(c))[None, :] > own[:, None]
        return np.nonzero(open_)

    def encode(self, x: np.ndarray, centroid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the distance of each vector to its code."""
        r = x - centroid
        codes = np.stack([_closest(r[:, a:b], book, 0.5 * (book * book).sum(1)) for (a, b), book in zip(self.cuts, self.books)], 1)
        back = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], 1)
        return codes, np.linalg.norm(r - back, axis=1)

    def tables(self, q: np.ndarray, centroid: np.ndarray) -> list[np.ndarray]:
        """Per subspace the squared distance of each query to each code."""
        r = q - centroid
        return [((r[:, a:b] ** 2).sum(1)[:, None] - 2 * r[:, a:b] @ book.T + (book * book).sum(1)).astype(np.float32)
                for (a, b), book in zip(self.cuts, self.books)]


def _unit_rows(column: pa.Array, dims: int | None) -> np.ndarray:
    """Rows of a list column as double unit vectors, padded with zeros to ``dims``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(ends) and (ends == dims).all():
        x = flat.reshape(-1, dims)
    else:
        x = np.zeros((len(ends), dims or 1))
        at = np.concatenate([[0], np.cumsum(ends)]).astype(int)
        for i, n in enumerate(ends.tolist()):
            x[i, :n] = flat[at[i]:at[i] + n]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def points_of(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, key, v): key hashes the components of a usable vector, else null."""
    v = F.col(vec_col).cast("array<double>")
    usable = (F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
              & F.exists(v, lambda x: x != 0))
    v = F.transform(v, lambda x: F.when(x == 0, 0.0).otherwise(x))          # one zero
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), v).alias("v")).select(
        "vec_id", "v", F.when(F.col("v").isNotNull(), F.md5(F.to_json("v").cast("binary"))).alias("key"))


def links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", min_cosine: float = MIN_COSINE,
          sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS, probes: int | None = PROBES, cell_rows: int = 16_384) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, like rows with a null id.  Repeated rows count as copies;
    rows that share an id but not the vector are vectors of their own, each with its
    own links.  Vectors shorter than the longest count as padded with zeros.
    """
    rows = stored(points_of(vectors, id_col, vec_col))
    points = stored(rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
        .withColumn("point", F.monotonically_increasing_id()))
    about = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    out = points.select("key", "rep", "copies", "point")
    if about.n < 2:
        out = out.withColumn("links", F.lit(0).cast("long")).withColumn("component", F.col("rep"))
    else:
        found = stored(_point_links(points, about.n, about.dims, min_cosine, sample_rows, list_rows, probes, cell_rows))
        comp = components(found.where("root <> point").select(F.col("point").alias("a"), F.col("root").alias("b")))
        total = found.groupBy("point").agg(F.sum("links").alias("links"))
        out = out.join(total, "point", "left").join(comp.withColumnRenamed("node", "point"), "point", "left")
        least = out.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least"))
        out = out.join(least, "component", "left").select("key", "copies", F.coalesce("links", F.lit(0)).alias("links"),
                                                          F.coalesce("least", "rep").alias("component"))
    return (rows.select("vec_id", "key").join(out, "key", "left")
            .select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def _point_links(points, n, dims, min_cosine, sample_rows, list_rows, probes, cell_rows):
    """(point, links, root) of the points that have partners in a cell."""
    sample = bounded_sample(points.select("key", "v"), "key", sample_rows).toArrow()
    quantiser = Quantiser.fit(_unit_rows(sample.column("v").combine_chunks(), dims), max(1, -(-n // list_rows)), min_cosine, probes is not None)
    model = points.sparkSession.sparkContext.broadcast(quantiser)         # at most sample_rows / FIT_ROWS centroids a level

    def count(batches):
        tally: dict[tuple[bool, int], int] = {}
        for b in batches:
            x = _unit_rows(b.column(0), dims)
            for visit, lists in ((False, model.value.home(x)), (True, model.value.probes(x, probes)[1])):
                for at, m in zip(*(v.tolist() for v in np.unique(lists, return_counts=True))):
                    tally[visit, at] = tally.get((visit, at), 0) + m
        if tally:
            yield pa.RecordBatch.from_arrays([pa.array([k[1] for k in tally]), pa.array([k[0] for k in tally]), pa.array(list(tally.values()))],
                                             names=["list", "visit", "m"])

    counts = (points.select("v").mapInArrow(count, "list long, visit boolean, m long")
              .groupBy("list", "visit").agg(F.sum("m").alias("m")).collect())          # two rows per list
    cells = Cells({r.list: r.m for r in counts if not r.visit}, {r.list: r.m for r in counts if r.visit}, cell_rows)

    def deal(batches):
        for b in batches:
            x = _unit_rows(b.column(2), dims)
            salt = b.column(0).to_numpy(zero_copy_only=False) * 2654435761 % (1 << 31)
            at, probed = model.value.probes(x, probes)
            for idx, (i, leaf, p, q, asks) in ((np.arange(len(x)), cells.deal(model.value.home(x), salt, False)),
                                               (at, cells.deal(probed, salt[at], True))):
                for k in range(0, len(i), 20_000):
                    part = slice(k, k + 20_000)
                    take = pa.array(idx[i[part]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaf[part]), pa.array(p[part]), pa.array(q[part]), pa.array(asks[part]),
                         b.column(0).take(take), b.column(1).take(take), b.column(2).take(take)],
                        names=["list", "x", "y", "query", "point", "copies", "v"])

    def link(key, t):
        leaf, p, q = (k.as_py() for k in key)
        quant = model.value
        t = t.sort_by("point")
        x = _unit_rows(t.column("v").combine_chunks(), dims)
        point, copies = t.column("point").to_numpy(), t.column("copies").to_numpy()
        asks = t.column("query").to_numpy(zero_copy_only=False)
        data, asked = np.flatnonzero(~asks), np.flatnonzero(asks)
        if p == q:
            asked = data
        centre = quant.centre(np.array([leaf]))[0]
        codes, error = quant.encode(x[data], centre)
        limit = ((quant.radius + SLACK + error) ** 2 + SLACK).astype(np.float32)
        total, sets = np.zeros(len(x), np.int64), UnionFind(len(x))
        step = max(1, CHUNK // max(1, len(data)))
        for i in range(0, len(asked) if len(data) else 0, step):
            own = asked[i:i + step]
            far = np.zeros((len(own), len(data)), np.float32)
            for table, code in zip(quant.tables(x[own], centre), codes.T):
                far += table[:, code]
            a, b = np.nonzero(far <= limit)
            a, b = own[a], data[b]
            if p == q:
                a, b = a[a < b], b[a < b]
            for j in range(0, len(a), CHUNK):
                u, v = a[j:j + CHUNK], b[j:j + CHUNK]
                near = np.einsum("ij,ij->i", x[u], x[v]) >= min_cosine
                u, v = u[near], v[near]
                if len(u) and p != q and probes is not None:
                    # met from both sides: the point of the lower list counts it
                    from_, at = np.unique(u, return_inverse=True)
                    lower = quant.home(x[from_])[at]
                    to, at = np.unique(v, return_inverse=True)
                    back = (quant.nearest(x[to], probes)[at] == lower[:, None]).any(1)
                    once = (lower <= leaf) | ~back
                    u, v = u[once], v[once]
                if len(u):
                    np.add.at(total, u, copies[v])
                    np.add.at(total, v, copies[u])
                    sets.join(u, v)
        hit = np.flatnonzero(total)
        return pa.table({"point": point[hit], "links": total[hit], "root": point[sets.up[hit]]},
                        schema=pa.schema([("point", "int64"), ("links", "int64"), ("root", "int64")]))

    return (points.select("point", "copies", "v")
            .mapInArrow(deal, "list long, x long, y long, query boolean, point long, copies long, v array<double>")
            .groupBy("list", "x", "y").applyInArrow(link, "point long, links long, root long"))
