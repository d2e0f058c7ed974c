"""Exact nearest neighbours in continuous space (M1), and rows synthesised
between neighbours (P9).

``nearest`` joins every query with its k nearest data rows without forming all
pairs.  Equal data vectors collapse to one.  Cuts of a k-d tree, fitted on a bounded
sample, deal the vectors to partitions; the box around a partition's vectors
tells how near to a query anything in it can be.

A query visits its partitions by this bound, in rounds of 1, 8, 64, ... of them,
and is finished when the next bound lies beyond its kth distance: the answer is
then proven.  Partitions are dealt as blocks of bounded size against bounded
groups of queries, so neither a crowded partition nor a crowded query meets one
task.  Inside a block the same cuts go on down to leaves of ``LEAF_ROWS`` vectors, and a
query is compared with the leaves whose box lies within its kth distance so far.
Each round is a stored table; a lost executor costs one round at most.

How many vectors a query meets depends on the data (``compared`` counts them): columns of few
values and clusters leave few leaves, spread-out vectors in many dimensions approach all of them.
"""
from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.stats import ordered_prefix, top_k_per_key
from tidemark.session import stored

K = 5
EUCLIDEAN, MANHATTAN = "euclidean", "manhattan"
#: Rows that the cuts are fitted on; distinct vectors per partition; vectors and queries of one cell; vectors of a leaf.
SAMPLE_ROWS, PART_ROWS, CELL_ROWS, CELL_QUERIES, LEAF_ROWS = 32_768, 16_384, 32_768, 8_192, 128
#: Elements compared at once, slack of the bounds for rounding, digits that decide ties.
CHUNK, SLACK, DIGITS = 2_000_000, 1e-6, 9
#: Visits (a query at a partition) of one batch; queries of a cell that are searched together.
VISITS, ASKED = 65_536, 1_024


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Matrix of distances; the euclidean one by products, so good to about 1e-7."""
    if metric == MANHATTAN:
        out = np.zeros((len(q), len(x)))
        for a, b in zip(q.T, x.T):
            out += np.abs(a[:, None] - b[None, :])
        return out
    square = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T
    return np.sqrt(np.maximum(0, square))


def pair_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of ``a`` to the same row of ``b``, from differences."""
    d = a - b
    return np.abs(d).sum(1) if metric == MANHATTAN else np.sqrt((d * d).sum(1))


def _matrix(column, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


@dataclass
class Pivots:
    """Partitions by nearest pivot, bounded by their radii."""
    centres: np.ndarray
    metric: str
    inner: np.ndarray | None = None
    outer: np.ndarray | None = None
    size: np.ndarray | None = None

    @classmethod
    def fit(cls, sample: np.ndarray, count: int, metric: str, rounds: int = 6) -> "Pivots":
        c = sample[np.linspace(0, len(sample) - 1, count).astype(int)].copy()
        for _ in range(rounds):
            near = distances(sample, c, EUCLIDEAN).argmin(1)
            n = np.bincount(near, minlength=count)
            total = np.zeros_like(c)
            np.add.at(total, near, sample)
            c[n > 0] = total[n > 0] / n[n > 0, None]
        return cls(c, metric)

    @property
    def at_once(self) -> int:
        """Rows whose distances to all pivots fit into one block of ``CHUNK`` elements."""
        return max(1, CHUNK // max(1, len(self.centres)))

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part, far = np.zeros(len(x), np.int64), np.zeros(len(x))
        for i in range(0, len(x), self.at_once):
            d = distances(x[i:i + self.at_once], self.centres, self.metric)
            part[i:i + self.at_once], far[i:i + self.at_once] = d.argmin(1), d.min(1)
        return part, far

    def order(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query the partitions by lower bound (ties: nearer pivot first), and the bounds."""
        d = distances(q, self.centres, self.metric)
        low = np.maximum(np.maximum(d - self.outer, self.inner - d), 0)
        if self.metric == EUCLIDEAN:
            own = d.argmin(1)
            apart = distances(self.centres[own], self.centres, EUCLIDEAN)          # rows asked x pivots, not pivots x pivots
            plane = (d * d - (d.min(1) ** 2)[:, None]) / np.maximum(2 * apart, 1e-12)
            low = np.maximum(low, np.where(apart > 1e-9, plane, 0))
        low[:, self.size == 0] = np.inf
        at = np.lexsort((d, low), axis=1) if len(q) else np.zeros(d.shape, int)
        return at, np.take_along_axis(low, at, 1)


def _cut(x: np.ndarray) -> tuple[int, float] | None:
    """Column of the largest variance and the value at about its middle (left: at most the value); None for equal rows."""
    spread = x.max(0) > x.min(0)
    if not spread.any():
        return None
    with np.errstate(over="ignore", invalid="ignore"):
        f = int(np.where(spread, np.nan_to_num(x.var(0), nan=np.inf), -1).argmax())
    v = np.sort(x[:, f])
    at = np.searchsorted(v, v[len(v) // 2])
    return f, float(v[at - 1] if at else v[0])


def box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray, metric: str) -> np.ndarray:
    """Matrix of the least distances from each query to anything inside each box."""
    out = np.zeros((len(q), len(low)))
    for a, lo, hi in zip(q.T, low.T, high.T):
        gap = np.maximum(np.maximum(lo[None, :] - a[:, None], a[:, None] - hi[None, :]), 0)
        out += gap if metric == MANHATTAN else gap * gap
    return out if metric == MANHATTAN else np.sqrt(out)


@dataclass
class Boxes:
    """Partitions by the cuts of a k-d tree (``feature`` -1: ``left`` is the partition), with the boxes around their vectors."""
    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    metric: str
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    size: np.ndarray | None = None

    @classmethod
    def fit(cls, sample: np.ndarray, count: int, metric: str) -> "Boxes":
        """At most ``count`` partitions, the largest cut first."""
        nodes, todo, done = [[-1, 0.0, 0, 0]], [(-len(sample), 0, np.arange(len(sample)))], []
        while todo and len(todo) + len(done) < count:
            _, node, own = heapq.heappop(todo)
            cut = _cut(sample[own]) if len(own) else None
            if cut is None:
                done.append(node)
                continue
            left = sample[own, cut[0]] <= cut[1]
            nodes[node] = [*cut, len(nodes), len(nodes) + 1]
            for part in (own[left], own[~left]):
                heapq.heappush(todo, (-len(part), len(nodes), part))
                nodes.append([-1, 0.0, 0, 0])
        for i, node in enumerate(sorted(done + [node for _, node, _ in todo])):
            nodes[node][2] = i
        columns = [*zip(*nodes)]
        return cls(np.array(columns[0]), np.array(columns[1], float), np.array(columns[2]), np.array(columns[3]), metric)

    @property
    def count(self) -> int:
        return int((self.feature < 0).sum())

    def home(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while (at := np.flatnonzero(self.feature[node] >= 0)).size:
            i = node[at]
            node[at] = np.where(x[at, self.feature[i]] <= self.value[i], self.left[i], self.right[i])
        return self.left[node]

    @property
    def at_once(self) -> int:
        """Rows whose bounds to all partitions fit into one block of ``CHUNK`` elements."""
        return max(1, CHUNK // (8 * max(1, len(self.size))))

    def visits(self, q: np.ndarray, kth: np.ndarray, seen: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, partition): the next ``width`` partitions, by bound, of those within each query's kth distance."""
        low = box_bounds(q, self.low, self.high, self.metric)
        low[:, self.size == 0] = np.inf
        open_ = np.isfinite(low) & (low <= (kth + SLACK * (1 + kth))[:, None])
        if width == 1 and not seen.any():
            part = low.argmin(1) if len(q) else np.zeros(0, np.int64)
            row = np.flatnonzero(open_[np.arange(len(q)), part])
            return row, part[row]
        row, part = np.nonzero(open_)
        order = np.lexsort((part, low[row, part], row))
        row, part = row[order], part[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        now = (rank >= seen[row]) & (rank < seen[row] + width)
        return row[now], part[now]


class Leaves:
    """The vectors of one block, cut down to leaves with boxes."""

    def __init__(self, x: np.ndarray, metric: str):
        self.x, self.metric, self.cuts = x, metric, Boxes.fit(x, max(1, -(-3 * len(x) // (2 * LEAF_ROWS))), metric)
        home = self.cuts.home(x)
        order, leaves = np.argsort(home, kind="stable"), np.arange(self.cuts.count)
        self.own = np.split(order, np.searchsorted(home[order], leaves[1:]))               # no leaf is empty
        self.low, self.high = np.stack([x[own].min(0) for own in self.own]), np.stack([x[own].max(0) for own in self.own])

    def far(self, q: np.ndarray, leaf: int, own: np.ndarray) -> np.ndarray:
        """Distances from the queries to the vectors ``own`` of a leaf; columns that are constant in the leaf count once."""
        vary = self.high[leaf] > self.low[leaf]
        gap = np.abs(q[:, ~vary] - self.low[leaf, ~vary])
        out = np.repeat((gap if self.metric == MANHATTAN else gap * gap).sum(1)[:, None], len(own), 1)
        part = np.empty_like(out)
        for f in np.flatnonzero(vary):
            np.subtract(q[:, f, None], self.x[own, f][None, :], out=part)
            (np.abs(part, out=part) if self.metric == MANHATTAN else np.multiply(part, part, out=part))
            out += part
        return out if self.metric == MANHATTAN else np.sqrt(out)

    def nearest(self, q: np.ndarray, kth: np.ndarray, size: np.ndarray, ids: np.ndarray, load: np.ndarray, k: int):
        """Blocks of (query, d, id, payload) and the vectors met per query: the k nearest of the rows (id, payload), ``size``
        of them a vector, sorted by vector and id, that lie within the queries' kth distances."""
        own = [o[size[o] > 0] for o in self.own]
        first = np.cumsum(size) - size
        lead = ids[np.minimum(first, len(ids) - 1)]
        met, found, order = np.zeros(len(q), np.int64), [], np.argsort(self.cuts.home(q), kind="stable")      # queries side by side ask the same leaves
        for i in range(0, len(q), ASKED):
            at = order[i:i + ASKED]
            some = np.zeros(len(at), np.int64)
            a, *rest = self._some(q[at], kth[at], own, some, size, first, lead, ids, load, k)
            met[at] = some
            found.append((at[a], *rest))
        return found, met

    def _some(self, q, kth, own, met, size, first, lead, ids, load, k):
        best = np.full((len(q), k), np.inf)
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        limit, held = kth + SLACK * (1 + kth), 0

        def reduced():
            """The k vectors by (distance, least id) of every query among the pairs so far."""
            a, b = (np.concatenate([p[j] for p in pairs]) for j in (0, 1))
            far = np.concatenate([p[2] for p in pairs])
            keep = far <= limit[a]
            a, b, far = a[keep], b[keep], far[keep]
            d = np.concatenate([np.round(pair_distances(q[a[j:j + VISITS]], self.x[b[j:j + VISITS]], self.metric), DIGITS)
                                for j in range(0, len(a), VISITS)] or [np.zeros(0)])
            order = np.lexsort((lead[b], d, a))
            a, b, d, far = a[order], b[order], d[order], far[order]
            keep = np.arange(len(a)) - np.searchsorted(a, a) < k
            return a[keep], b[keep], far[keep], d[keep]

        def meet(rows, leaf):
            nonlocal pairs, held
            here = own[leaf]
            for j in range(0, len(rows), max(1, CHUNK // (4 * len(here)))):
                some = rows[j:j + max(1, CHUNK // (4 * len(here)))]
                far = self.far(q[some], leaf, here)
                best[some] = np.partition(np.concatenate([best[some], far], 1), k - 1, axis=1)[:, :k]
                least = np.minimum(kth[some], best[some, k - 1])
                limit[some] = least = least + SLACK * (1 + least)
                a, b = np.nonzero(far <= least[:, None])
                pairs.append((some[a], here[b], far[a, b]))
                met[some] += len(here)
                held += len(a)
                if held > max(VISITS, 4 * k * len(q)):
                    pairs = [reduced()[:3]]
                    held = len(pairs[0][0])

        def turn(leaf_of, bound_of):
            """Every query at one leaf of its own."""
            for leaf in np.unique(leaf_of).tolist():
                rows = np.flatnonzero(leaf_of == leaf)
                rows = rows[np.isfinite(bound_of[rows]) & (bound_of[rows] <= limit[rows])]
                if len(rows) and len(own[leaf]):
                    meet(rows, leaf)

        home, everyone = self.cuts.home(q), np.arange(len(q))
        gap = np.maximum(np.maximum(self.low[home] - q, q - self.high[home]), 0)
        turn(home, gap.sum(1) if self.metric == MANHATTAN else np.sqrt((gap * gap).sum(1)))
        gap = np.maximum(np.maximum(self.low - q.max(0), q.min(0) - self.high), 0)             # from the box around the queries
        apart = gap.sum(1) if self.metric == MANHATTAN else np.sqrt((gap * gap).sum(1))
        may = np.flatnonzero((apart <= limit.max()) & [len(o) > 0 for o in own])
        if len(may):
            bound = box_bounds(q, self.low[may], self.high[may], self.metric)
            bound[home[:, None] == may[None, :]] = np.inf
            second = bound.argmin(1)
            turn(may[second], bound[everyone, second])
            bound[everyone, second] = np.inf
            for i, leaf in enumerate(may.tolist()):
                rows = np.flatnonzero(np.isfinite(bound[:, i]) & (bound[:, i] <= limit))
                if len(rows):
                    meet(rows, leaf)
        if not pairs:
            none = np.zeros(0, np.int64)
            return none, np.zeros(0), none, np.zeros(0)
        a, b, _, d = reduced()
        n = size[b]
        entry = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[b], n)
        a, d = np.repeat(a, n), np.repeat(d, n)
        order = np.lexsort((ids[entry], d, a))
        a, d, entry = a[order], d[order], entry[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        return a[keep], d[keep], ids[entry[keep]], load[entry[keep]]


def _finite(x):
    return x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def _upto(n):
    """The longs 0 .. n - 1."""
    return F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)


_ROWS = "array<struct<id:long,payload:double,fold:long>>"


def _vectors(data: DataFrame, k: int) -> DataFrame:
    """(vec, x, rows array<struct<id, payload, fold>>): distinct vectors with the k smallest ids of every fold."""
    keyed = data.withColumn("vec", F.xxhash64("x")).withColumn("_own", F.struct("vec", "x", "fold"))      # the hash first: sorted by it
    few = top_k_per_key(keyed.select("_own", "x", "vec", "id", "payload", "fold"), "_own", ["id"], k)
    return few.groupBy("x").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list(F.struct("id", "payload", "fold"))).alias("rows"))


_NEAR = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64()), ("payload", pa.float64())]))


def nearest(queries: DataFrame, data: DataFrame, k: int = K, metric: str = EUCLIDEAN, sample_rows: int = SAMPLE_ROWS,
            part_rows: int = PART_ROWS, cell_rows: int = CELL_ROWS, cell_queries: int = CELL_QUERIES, fold: str | None = None) -> DataFrame:
    """``queries(qid long, x array<double>)`` against ``data(id long, x, payload double)`` ->
    ``(qid, x, best array<struct<d, id, payload>>, compared)``: the k nearest rows by
    distance (9 decimals), then id.  One row per query row with distinct qid.

    Fewer than k data rows give shorter lists, no data empty ones.  Rows whose
    vector is null or holds null or non-finite values are no neighbours and, as
    queries, get an empty list.  All vectors have one length.

    With ``fold``, a whole-number column of both tables without nulls, a query meets only data rows of other folds: one
    search for all folds of a cross validation instead of one a fold.  Its column is returned too, and one row per (qid, fold).
    """
    if metric not in (EUCLIDEAN, MANHATTAN):
        raise ValueError(f"unknown metric {metric}")
    if k < 1:
        raise ValueError("k must be positive")
    none = F.array().cast("array<struct<d:double,id:long,payload:double>>")
    of = lambda other: (F.col(fold) if fold else F.lit(other)).cast("long").alias("fold")
    by = ["qid", "fold"]
    shown = ["qid", "x", *([F.col("fold").alias(fold)] if fold else []), "best", "compared"]
    asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col("x").cast("array<double>").alias("x"), of(-1))
    clean = data.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"),
                        F.col("payload").cast("double").alias("payload"), of(0)).where(_finite(F.col("x")))
    vectors = stored(_vectors(clean, k))
    about = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dims")).first()
    state = stored(asked.select("qid", "x", "fold", none.alias("best"), F.lit(0).alias("seen"), F.lit(0).cast("long").alias("compared"),
                                _finite(F.col("x")).alias("open")))
    if not about.n:
        return state.select(*shown)
    dims = about.dims
    drawn = vectors.select("x", "vec").orderBy(F.xxhash64(F.lit(3), "vec"), "vec").limit(sample_rows).toArrow()
    sample = _matrix(drawn.column("x"), dims)
    boxes = Boxes.fit(sample, int(np.clip(-(-about.n // part_rows), 1, len(sample))), metric)
    shared = vectors.sparkSession.sparkContext.broadcast(boxes)              # at most a node and a half a sampled vector
    count = boxes.count

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.home(_matrix(b.column("x"), dims))), *b.columns], names=["part", *b.schema.names])

    placed = stored(vectors.mapInArrow(place, f"part long, x array<double>, vec long, rows {_ROWS}"))

    def around(batches):
        low, high, size = np.full((count, dims), np.inf), np.full((count, dims), -np.inf), np.zeros(count, np.int64)
        for b in batches:
            if b.num_rows:
                part, x = b.column("part").to_numpy(), _matrix(b.column("x"), dims)
                order = np.argsort(part, kind="stable")
                own, at = np.unique(part[order], return_index=True)
                low[own] = np.minimum(low[own], np.minimum.reduceat(x[order], at))
                high[own] = np.maximum(high[own], np.maximum.reduceat(x[order], at))
                size += np.bincount(part, minlength=count)
        own = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(low[own]), pa.list_(pa.float64())), pa.array(list(high[own]), pa.list_(pa.float64())),
                                          pa.array(size[own])], names=["part", "low", "high", "n"])

    def whole(key, t):
        low, high = _matrix(t.column("low"), dims).min(0), _matrix(t.column("high"), dims).max(0)
        return pa.table({"part": [key[0].as_py()], "low": [low.tolist()], "high": [high.tolist()], "n": [int(t.column("n").to_numpy().sum())]})

    shape = "part long, low array<double>, high array<double>, n long"
    boxes.low, boxes.high, boxes.size = np.zeros((count, dims)), np.zeros((count, dims)), np.zeros(count, np.int64)
    for r in placed.select("part", "x").mapInArrow(around, shape).groupBy("part").applyInArrow(whole, shape).collect():      # a row per partition
        boxes.low[r.part], boxes.high[r.part], boxes.size[r.part] = r.low, r.high, r.n
    shared = vectors.sparkSession.sparkContext.broadcast(boxes)
    blocks = np.maximum(1, -(-boxes.size // cell_rows))
    sizes = F.array(*[F.lit(int(n)) for n in blocks]) if (blocks > 1).any() else None
    of_block = F.pmod("vec", sizes[F.col("part").cast("int")]) if sizes is not None else F.lit(0)
    placed = placed.select("part", of_block.cast("long").alias("block"), "x", "rows")

    def next_parts(batches, width):
        p = shared.value
        for b in batches:
            x = _matrix(b.column("x"), dims)
            kth, seen = b.column("kth").to_numpy(), b.column("seen").to_numpy()
            for i in range(0, len(x), p.at_once):
                now = slice(i, i + p.at_once)
                row, part = p.visits(x[now], kth[now], seen[now], width)
                for j in range(0, len(row), VISITS):
                    take = pa.array(row[j:j + VISITS] + i)
                    yield pa.RecordBatch.from_arrays([*[b.column(c).take(take) for c in ("qid", "x", "fold", "kth")], pa.array(part[j:j + VISITS])],
                                                     names=["qid", "x", "fold", "kth", "part"])

    def search(key, left, right):
        out = pa.schema([("qid", pa.int64()), ("fold", pa.int64()), ("met", pa.int64()), ("near", _NEAR)])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        x, q = _matrix(left.column("x"), dims), _matrix(right.column("x"), dims)
        rows = left.column("rows").combine_chunks()
        inside = rows.flatten()
        held = {n: inside.field(n).to_numpy(zero_copy_only=False) for n in ("id", "payload", "fold")}
        vector = np.repeat(np.arange(len(x)), rows.value_lengths().to_numpy())
        qid, kth, fold_of, leaves, tables = right.column("qid"), right.column("kth").to_numpy(), right.column("fold").to_numpy(), Leaves(x, metric), []
        for f in np.unique(fold_of).tolist():
            own, may = np.flatnonzero(fold_of == f), np.flatnonzero(held["fold"] != f)
            at, d, ids, load, met = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(len(own), np.int64)
            if len(may):
                found, met = leaves.nearest(q[own], kth[own], np.bincount(vector[may], minlength=len(x)), held["id"][may], held["payload"][may], k)
                at, d, ids, load = (np.concatenate(c) for c in zip(*found))
                order = np.argsort(at, kind="stable")                              # query after query, each by distance
                at, d, ids, load = at[order], d[order], ids[order], load[order]
            ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(own)))]).astype(np.int32)
            near = pa.StructArray.from_arrays([pa.array(d), pa.array(ids, pa.int64()), pa.array(load, pa.float64(), from_pandas=True)], fields=list(_NEAR.value_type))
            tables.append(pa.table([qid.take(pa.array(own)), pa.array(np.full(len(own), f)), pa.array(met),
                                    pa.ListArray.from_arrays(pa.array(ends), near, type=_NEAR)], schema=out))
        return pa.concat_tables(tables)

    width, done = 1, []
    while True:
        kth = F.when(F.size("best") >= k, F.element_at("best", -1)["d"]).otherwise(float("inf"))
        open_ = state.where("open").select("qid", "x", "fold", "seen", kth.alias("kth"))
        step = width
        visits = stored(open_.mapInArrow(lambda batches: next_parts(batches, step), "qid long, x array<double>, fold long, kth double, part long"))
        crowd = {r.part: r.n for r in visits.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}     # a row per partition
        if not crowd:
            done.append(state)
            break
        groups = np.array([max(1, -(-crowd.get(p, 0) // cell_queries)) for p in range(count)])
        of_group = F.array(*[F.lit(int(g)) for g in groups]) if (groups > 1).any() else None
        size_of = lambda c: of_group[c.cast("int")] if of_group is not None else F.lit(1)
        right = visits.withColumn("group", F.pmod(F.xxhash64("qid"), size_of(F.col("part"))).cast("long"))
        block_of = sizes[F.col("part").cast("int")] if sizes is not None else F.lit(1)
        right = right.withColumn("block", F.explode(_upto(block_of)))
        left = placed.where(F.col("part").isin(sorted(crowd))).withColumn("group", F.explode(_upto(size_of(F.col("part")))))
        keys = ("part", "block", "group")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
            search, "qid long, fold long, met long, near array<struct<d:double,id:long,payload:double>>")
        new = found.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("new"), F.sum("met").alias("met"))
        if len(done) or not state.where("NOT open").isEmpty():
            done.append(state.where("NOT open"))
        merged = F.slice(F.array_sort(F.concat("best", "new")), 1, k)
        going = state.where("open").select("qid", "x", "fold", "best", "seen", "compared").join(new, by, "left")
        state = stored(going.select(
            "qid", "x", "fold", F.when(F.col("new").isNull(), F.col("best")).otherwise(merged).alias("best"), (F.col("seen") + width).alias("seen"),
            (F.col("compared") + F.coalesce("met", F.lit(0))).alias("compared"),
            (F.col("new").isNotNull() & (F.col("seen") + width < count)).alias("open")))
        width *= 8
    out = done[0].select(*shown)
    for part in done[1:]:
        out = out.unionByName(part.select(*shown))
    return out


def vote(found: DataFrame, weights: str = "uniform") -> DataFrame:
    """M1: ``probability`` of class 1 among the neighbours (payload 0 or 1) and the
    class, ties to 0.  ``distance`` weighs by 1 / d; neighbours at distance zero,
    if any, are then the only ones that count.  No neighbours: null."""
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, n: s + f(n))
    if weights == "uniform":
        p = F.try_divide(total(F.col("best"), lambda n: n["payload"]), F.size("best"))
    elif weights == "distance":
        same = F.filter("best", lambda n: n["d"] == 0)
        pool = F.when(F.size(same) > 0, same).otherwise(F.col("best"))
        w = lambda n: F.when(n["d"] == 0, 1.0).otherwise(F.try_divide(F.lit(1.0), n["d"]))
        p = F.try_divide(total(pool, lambda n: w(n) * n["payload"]), total(pool, w))
    else:
        raise ValueError(f"unknown weights {weights}")
    return found.withColumn("probability", p).withColumn("pred", (F.col("probability") > 0.5).cast("int"))


def knn_predict(train: DataFrame, rows: DataFrame, features, id_col: str, label: str = "label", k: int = K,
                weights: str = "uniform", metric: str = EUCLIDEAN, **options) -> DataFrame:
    """M1: ``rows`` (distinct ids) with the vote of their k nearest labelled training
    rows: ``(id_col, probability, pred, best, compared)``."""
    train = train.where(F.col(label).isNotNull())
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    data = train.select(F.col(id_col).alias("id"), x.alias("x"), F.col(label).cast("double").alias("payload"))
    found = nearest(rows.select(F.col(id_col).alias("qid"), x.alias("x")), data, k, metric, **options)
    return vote(found, weights).select(F.col("qid").alias(id_col), "probability", "pred", "best", "compared")


def smote_hash(*parts):
    """60 bits of the md5 of the parts joined by colons (DuckDB computes the same)."""
    text = F.concat_ws(":", *[p.cast("string") if hasattr(p, "cast") else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def smote(train: DataFrame, features, id_col: str, label: str = "label", k: int = K, seed: int = 42, **options) -> DataFrame:
    """The rows that bring the smaller of two classes to parity:
    ``(id_col [parent], copy, neighbour, weight, label, features...)``.

    Every row of the smaller class gets the same number of new rows, those with
    the smallest hashes one more, so the classes are equal exactly.  A new row
    lies at a hash-chosen weight between its parent and a hash-chosen one of the
    parent's k nearest rows of the class.  A class of one row is copied; with one class
    only, or equal classes, nothing is added.
    """
    features = list(features)
    sizes = sorted((r["n"], r[label]) for r in train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect())
    if len(sizes) > 2:
        raise ValueError("two classes expected")
    few, missing = (sizes[0], sizes[1][0] - sizes[0][0]) if len(sizes) == 2 else ((1, None), 0)
    each, rest = divmod(missing, few[0])
    own = train.where(F.col(label) == F.lit(few[1]))
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    rows = own.select(F.col(id_col).alias("qid"), x.alias("x"))
    if missing == 0:
        rows = rows.limit(0)
    found = nearest(rows, rows.select(F.col("qid").alias("id"), "x", F.lit(0.0).alias("payload")), k + 1, **options)
    near = found.select("qid", "x", F.slice(F.filter(F.transform("best", lambda n: n["id"]), lambda i: i != F.col("qid")), 1, k).alias("near"))
    near = ordered_prefix(near.withColumn("_h", smote_hash(F.col("qid"), seed)), "_h", [], tie="qid")
    quota = F.lit(each) + (F.col("_pos") <= rest).cast("int")
    new = near.where(quota > 0).select("qid", "x", "near", F.explode(F.sequence(F.lit(1), quota)).alias("copy"))
    pick = smote_hash(F.col("qid"), F.col("copy"), seed, "n") % F.greatest(F.size("near"), F.lit(1))
    new = new.select("qid", "x", "copy", F.get("near", pick.cast("int")).alias("neighbour"),
                     (smote_hash(F.col("qid"), F.col("copy"), seed, "u") / F.lit(float(16 ** 15))).alias("weight"))
    other = rows.select(F.col("qid").alias("neighbour"), F.col("x").alias("y"))
    new = new.join(other, "neighbour", "left")
    mixed = F.zip_with("x", F.coalesce("y", "x"), lambda a, b: a + F.col("weight") * (b - a))
    new = new.withColumn("_m", mixed)
    return new.select(F.col("qid").alias(id_col), "copy", "neighbour", "weight", F.lit(few[1]).alias(label),
                      *[F.col("_m")[i].alias(f) for i, f in enumerate(features)])


def balanced(train: DataFrame, features, id_col: str, label: str = "label", **options) -> DataFrame:
    """The training rows and the new ones of :func:`smote`: ``(id_col, copy, label, features...)``, copy 0 for given rows."""
    columns = [id_col, "copy", label, *[f"`{f}`" for f in features]]
    return train.withColumn("copy", F.lit(0)).select(*columns).unionByName(smote(train, features, id_col, label, **options).select(*columns))
