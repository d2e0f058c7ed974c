"""Exact decision trees (M3, M11) and exact tree explanations.

Growth.  Splits are looked for between all neighbouring values of a feature, not
between bins.  As long as a node holds more than ``local_rows`` rows, a pass counts its
rows and positives per feature and bin, a level of all trees at a time.  That gives the cost
of every split between bins, and a lower bound for those inside one: the cost is
concave in (rows, positives) to the left, so inside a bin it is nowhere below its corners
(all positives first, all others first).  A second pass orders the values of those bins
only that may hold the best split.  The rows of a smaller node go to one task, which
grows the rest of its subtree level by level over all its nodes at once.  Both follow
the same rule, so ``local_rows`` and ``bins`` change nothing but the cost.

A tree is grown once for many settings: the split of a node does not depend on
when growth stops, so a smaller depth or a larger minimum split size is a
truncation of the full tree (:meth:`Tree.truncated`).
"""
from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.sums import array_sums
from tidemark.session import stored

MAX_DEPTH, MIN_SPLIT = 10, 2        # fixed values: defaults of the model type
GINI, ENTROPY = "gini", "entropy"
LOCAL_ROWS = 100_000
#: Bins of a feature, rows of the sample they are fitted on, values that one task orders in the second pass.
BINS, SAMPLE_ROWS, TASK_VALUES = 4_096, 65_536, 65_536
#: Impurities are compared at this many digits, so that equal splits tie in every order of summation.
DIGITS = 12


def impurity(pos, n, criterion: str):
    """Impurity of n rows of which pos are positive (arrays)."""
    p = np.divide(pos, n, out=np.zeros(np.shape(n)), where=np.asarray(n) > 0)
    if criterion == GINI:
        return 2 * p * (1 - p)
    if criterion != ENTROPY:
        raise ValueError(f"unknown criterion {criterion}")
    with np.errstate(divide="ignore", invalid="ignore"):
        return -np.nan_to_num(p * np.log2(p)) - np.nan_to_num((1 - p) * np.log2(1 - p))


@dataclass
class Tree:
    """Nodes as arrays, node 0 the root: ``feature`` (-1: leaf), ``threshold`` (left when
    value <= threshold), ``left``, ``right``, rows ``n`` and positive rows ``pos``."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    n: np.ndarray
    pos: np.ndarray
    criterion: str = GINI

    @classmethod
    def of(cls, nodes: dict[int, tuple], criterion: str) -> "Tree":
        """From heap-numbered nodes (children of i: 2i+1, 2i+2) -> (feature, threshold, n, pos)."""
        ids = sorted(nodes)
        return cls.of_columns(np.array(ids, np.int64), *(np.array([nodes[i][k] for i in ids], t) for k, t in enumerate((np.int64, float, float, float))), criterion)

    @classmethod
    def of_columns(cls, ids, feature, threshold, n, pos, criterion: str) -> "Tree":
        """From columns of heap-numbered nodes, each node once."""
        order = np.argsort(ids)
        ids, feature, threshold, n, pos = (c[order] for c in (ids, feature, threshold, n, pos))

        def child(side):
            at = np.minimum(np.searchsorted(ids, 2 * ids + side), len(ids) - 1)
            return np.where(ids[at] == 2 * ids + side, at, -1)
        return cls(feature.astype(np.int64), threshold.astype(float), child(1), child(2), n.astype(float), pos.astype(float), criterion)

    @property
    def value(self) -> np.ndarray:
        return np.divide(self.pos, self.n, out=np.zeros(len(self.n)), where=self.n > 0)

    def depths(self) -> np.ndarray:
        out, at = np.zeros(len(self.feature), np.int64), np.zeros(1, np.int64)
        while (at := at[self.feature[at] >= 0]).size:
            depth = out[at[0]] + 1
            at = np.concatenate([self.left[at], self.right[at]])
            out[at] = depth
        return out

    def leaves(self) -> np.ndarray:
        """The nodes below the root that are not split."""
        out, at = [], np.zeros(1, np.int64)
        while at.size:
            out.append(at[self.feature[at] < 0])
            at = at[self.feature[at] >= 0]
            at = np.concatenate([self.left[at], self.right[at]])
        return np.concatenate(out)

    def sums(self, of_leaf: np.ndarray) -> np.ndarray:
        """Per node the sum of ``of_leaf`` over the leaves below it, itself included."""
        out, levels, at = of_leaf.copy(), [], np.zeros(1, np.int64)
        while (at := at[self.feature[at] >= 0]).size:
            levels.append(at)
            at = np.concatenate([self.left[at], self.right[at]])
        for at in reversed(levels):
            out[at] += out[self.left[at]] + out[self.right[at]]
        return out

    def truncated(self, max_depth: int = MAX_DEPTH, min_split: int = MIN_SPLIT) -> "Tree":
        """The tree that growth under these limits would have given."""
        stop = (self.depths() >= max_depth) | (self.n < min_split)
        return Tree(np.where(stop, -1, self.feature), self.threshold, self.left, self.right, self.n, self.pos, self.criterion)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row ends in."""
        node = np.zeros(len(x), np.int64)
        while (at := np.flatnonzero(self.feature[node] >= 0)).size:
            i = node[at]
            node[at] = np.where(x[at, self.feature[i]] <= self.threshold[i], self.left[i], self.right[i])
        return node

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Share of positive training rows in each row's leaf."""
        return self.value[self.leaf(x)]

    def reachable(self) -> np.ndarray:
        """Marks the nodes that truncation left below the root."""
        out = np.zeros(len(self.feature), bool)
        out[0] = True
        for i in range(len(out)):
            if out[i] and self.feature[i] >= 0:
                out[[self.left[i], self.right[i]]] = True
        return out

    def importances(self, width: int) -> np.ndarray:
        """Impurity decrease of each feature's splits, weighed by rows, summing to 1."""
        out = np.zeros(width)
        cost = self.n * impurity(self.pos, self.n, self.criterion)
        for i in np.flatnonzero(self.reachable() & (self.feature >= 0)):
            out[self.feature[i]] += cost[i] - cost[self.left[i]] - cost[self.right[i]]
        return out / out.sum() if out.sum() > 0 else out

    def paths(self, background: np.ndarray):
        """Per leaf (value, features, low, high, background inside): its box over the features on its path."""
        out, todo = [], [(0, {})]
        while todo:
            i, box = todo.pop()
            if self.feature[i] < 0:
                f = sorted(box)
                low, high = np.array([box[j][0] for j in f]), np.array([box[j][1] for j in f])
                out.append((float(self.value[i]), np.array(f, np.int64), low, high, (background[f] > low) & (background[f] <= high) if f else np.zeros(0, bool)))
                continue
            f, t = int(self.feature[i]), float(self.threshold[i])
            low, high = box.get(f, (-np.inf, np.inf))
            todo.append((int(self.right[i]), {**box, f: (max(low, t), high)}))
            todo.append((int(self.left[i]), {**box, f: (low, min(high, t))}))
        return out


def best_split(n: np.ndarray, pos: np.ndarray, total_n, total_pos, criterion: str) -> np.ndarray:
    """Weighted impurity after a split with n rows, pos positive, to the left."""
    return np.round(n * impurity(pos, n, criterion) + (total_n - n) * impurity(total_pos - pos, total_n - n, criterion), DIGITS)


def grow_local(x: np.ndarray, y: np.ndarray, criterion: str, max_depth: int, min_split: int, root: int = 0) -> dict[int, tuple]:
    """Subtree of heap node ``root`` (whose depth counts) over rows in memory."""
    return {i: v for i, *v in zip(*(c.tolist() for c in grow_columns(x, y, criterion, max_depth, min_split, root)))}


def grow_columns(x: np.ndarray, y: np.ndarray, criterion: str, max_depth: int, min_split: int, root: int = 0) -> list[np.ndarray]:
    """The same as columns (heap node, feature, threshold, n, pos).  A level is one step over all its nodes: columns of two
    values are counted, the others kept in order of (node, value)."""
    y = y.astype(np.int64)
    flags, orders, codes = {}, {}, {}
    for f in range(x.shape[1] if len(x) else 0):
        values, code = np.unique(x[:, f], return_inverse=True)
        if len(values) == 2:
            flags[f] = (code == 1, values)
        elif len(values) > 2:
            codes[f], orders[f] = code, np.argsort(code, kind="stable")
    out = [(np.array([root]), np.array([-1]), np.zeros(1), np.array([len(x)]), np.array([int(y.sum())]))]
    heap, n, pos, depth = out[0][0], out[0][3], out[0][4], (root + 1).bit_length() - 1
    rows = np.arange(len(x))                                                   # of the open nodes, node after node
    while True:
        open_ = (n >= min_split) & (pos > 0) & (pos < n) & (depth < max_depth)
        rows, orders = _of_open(rows, n, open_), {f: _of_open(o, n, open_) for f, o in orders.items()}
        which = np.flatnonzero(open_)                                          # their places in the last block
        heap, n, pos = heap[open_], n[open_], pos[open_]
        if not len(n):
            return [np.concatenate(c) for c in zip(*out)]
        start, seg = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        best, feature, cut = np.full(len(n), np.inf), np.full(len(n), -1), np.zeros(len(n))
        right = np.zeros(len(rows), bool)
        mine = y[rows]
        for f in range(x.shape[1]):
            if f in flags:
                bit = flags[f][0][rows]
                left_n, left_pos = n - np.bincount(seg, bit, len(n)).astype(np.int64), pos - np.bincount(seg, bit * mine, len(n)).astype(np.int64)
                at = np.flatnonzero((left_n > 0) & (left_n < n))
                cost = best_split(left_n[at].astype(float), left_pos[at].astype(float), n[at], pos[at], criterion)
                low, high = (np.full(len(at), v) for v in flags[f][1])
            elif f in orders:
                own, code = orders[f], codes[f][orders[f]]
                i = np.flatnonzero((seg[1:] == seg[:-1]) & (code[1:] > code[:-1]))
                if not len(i):
                    continue
                seen = np.cumsum(y[own])
                of = seg[i]
                before = seen[start[of]] - y[own[start[of]]]
                every = best_split((i + 1 - start[of]).astype(float), (seen[i] - before).astype(float), n[of], pos[of], criterion)
                at, first = np.unique(of, return_index=True)
                cost = np.minimum.reduceat(every, first)
                hit = np.flatnonzero(every == cost[np.repeat(np.arange(len(at)), np.diff(np.append(first, len(of))))])
                i = i[hit[np.unique(of[hit], return_index=True)[1]]]           # ties: least threshold
                low, high = x[own[i], f], x[own[i + 1], f]
            else:
                continue
            t = (low + high) / 2
            t = np.where(t >= high, low, t)                                    # neighbouring floats
            better = cost < best[at]                                           # ties: first feature
            at = at[better]
            best[at], feature[at], cut[at] = cost[better], f, t[better]
        split = feature >= 0
        right = x[rows, np.maximum(feature, 0)[seg]] > cut[seg]
        out[-1][1][which], out[-1][2][which] = feature, cut
        right_n, right_pos = np.bincount(seg, right, len(n)).astype(np.int64), np.bincount(seg, right * mine, len(n)).astype(np.int64)
        side = np.zeros(len(y), bool)
        side[rows] = right
        place = 2 * (np.cumsum(split) - 1)                                     # of the left child
        child = np.where(split, place, -1)

        def dealt(own):
            to = child[seg] + side[own]
            keep = split[seg]
            own, to = own[keep], to[keep]
            return own[np.argsort(to.astype(np.uint16) if 2 * len(n) < 65_536 else to, kind="stable")]

        rows, orders = dealt(rows), {f: dealt(o) for f, o in orders.items()}
        pair = lambda a, b: np.stack([a[split], b[split]], 1).ravel()
        heap, n, pos, depth = pair(2 * heap + 1, 2 * heap + 2), pair(n - right_n, right_n), pair(pos - right_pos, right_pos), depth + 1
        out.append((heap, np.full(len(heap), -1), np.zeros(len(heap)), n, pos))


def _of_open(rows: np.ndarray, n: np.ndarray, open_: np.ndarray) -> np.ndarray:
    return rows[np.repeat(open_, n)]


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def grow(rows: DataFrame, criteria: dict[int, str], max_depth: int = MAX_DEPTH, min_split: int = MIN_SPLIT,
         local_rows: int = LOCAL_ROWS, bins: int = BINS) -> dict[int, Tree]:
    """``rows(tree int, y int, x array<double>)`` -> one tree per key of ``criteria``; ``tree`` may
    be an array, the trees that a row belongs to, each once.

    Rows with a null label are left out, null and not-a-number values count as zero; a tree
    without rows is one leaf of value 0.  Ties go to the first feature, then to
    the least threshold.  The driver holds the nodes, at most 2 ** (max_depth + 1) a tree, and per node above
    ``local_rows`` rows the counts of its bins, some 2 * sqrt(rows) a feature.
    """
    clean = F.transform("x", lambda v: F.nanvl(F.coalesce(v, F.lit(0.0)), F.lit(0.0)))
    of = F.col("tree") if dict(rows.dtypes)["tree"].startswith("array") else F.array("tree")
    data = stored(rows.where("y IS NOT NULL").select(of.cast("array<int>").alias("trees"), F.col("y").cast("int").alias("y"), clean.alias("x")))
    nodes: dict[int, dict[int, tuple]] = {t: {} for t in criteria}
    sizes = {r.tree: (r.n, r.pos) for r in data.select(F.explode("trees").alias("tree"), "y").groupBy("tree")
             .agg(F.count("y").alias("n"), F.sum("y").alias("pos")).collect()}
    big = {t: [0] for t in criteria if sizes.get(t, (0, 0))[0] > local_rows}
    for t in criteria:
        nodes[t][0] = (-1, 0.0, *sizes.get(t, (0, 0)))
    depth, grid = 0, _Bins.fit(data, bins) if big and max_depth else None
    while any(big.values()) and depth < max_depth:
        for t, splits in _level(data, nodes, big, criteria, grid).items():
            for node, (f, threshold, n, pos) in splits.items():
                _, _, all_n, all_pos = nodes[t][node]
                nodes[t][node] = (f, threshold, all_n, all_pos)
                nodes[t][2 * node + 1], nodes[t][2 * node + 2] = (-1, 0.0, n, pos), (-1, 0.0, all_n - n, all_pos - pos)
        depth += 1
        first = 2 ** depth - 1
        big = {t: [i for i, v in own.items() if i >= first and v[2] > local_rows and v[2] >= min_split and 0 < v[3] < v[2]]
               for t, own in nodes.items()}
    small = {t: [i for i, v in own.items() if v[0] < 0 and v[2] <= local_rows and v[2] >= min_split and 0 < v[3] < v[2]] for t, own in nodes.items()}
    found = _finish(data, nodes, small, criteria, max_depth, min_split) if any(small.values()) else {}
    out = {}
    for t, own in nodes.items():
        kept = [i for i in own if i not in set(small[t])]
        columns = [np.array(kept, np.int64), *(np.array([own[i][k] for i in kept], float) for k in range(4))]
        out[t] = Tree.of_columns(*(np.concatenate([a, b]) for a, b in zip(columns, found.get(t, [np.zeros(0, np.int64)] * 5))), criteria[t])
    return out


def _batches(batches, nodes: dict[int, dict[int, tuple]], wanted: dict[int, list[int]]):
    """Per batch and tree: the tree, the places in the batch of its rows in the wanted nodes, those nodes, the batch's labels and matrix."""
    ids = {t: np.array(sorted(own), np.int64) for t, own in nodes.items()}
    walks = {t: Tree.of(own, GINI) for t, own in nodes.items() if wanted.get(t)}
    for b in batches:
        if not b.num_rows:
            continue
        lists = b.column(b.schema.get_field_index("trees"))
        tree, row = lists.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
        x, y = _matrix(b.column(b.schema.get_field_index("x"))), b.column(b.schema.get_field_index("y")).to_numpy()
        for t, walk in walks.items():
            at = row[tree == t]
            node = ids[t][walk.leaf(x[at])]
            keep = np.isin(node, wanted[t])
            yield b, t, at[keep], node[keep], y, x


@dataclass
class _Bins:
    """Per feature ascending ``edges``: bin i holds the values in (edges[i - 1], edges[i]], the last one what is above all;
    ``one``: the bins in which all rows have the value of the edge."""
    edges: list[np.ndarray]
    one: list[np.ndarray]

    @classmethod
    def fit(cls, data: DataFrame, bins: int) -> "_Bins":
        some = data.select("x").orderBy(F.xxhash64(F.lit(5), "x")).limit(SAMPLE_ROWS).toArrow()
        sample = _matrix(some.column("x"))
        edges = []
        for v in sample.T:
            values = np.unique(v)
            edges.append(values if len(values) <= bins else np.unique(np.sort(v)[np.linspace(0, len(v) - 1, bins).astype(int)]))
        grid = cls(edges, [])
        shared = data.sparkSession.sparkContext.broadcast(grid)                # features x bins values

        def other(batches):
            out = [np.zeros(len(e) + 1) for e in edges]
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(0))
                    for f, e in enumerate(shared.value.edges):
                        code = np.searchsorted(e, x[:, f])
                        out[f][code[e[np.minimum(code, len(e) - 1)] != x[:, f]]] = 1
            return {"other": np.concatenate(out)}
        found = array_sums(data.select("x"), other)["other"]
        grid.one = [v == 0 for v in np.split(found, np.cumsum([len(e) + 1 for e in edges])[:-1])]
        return grid

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, v) for e, v in zip(self.edges, x.T)], 1)


@dataclass
class _Cells:
    """Where a level counts: per big node and feature the first cell and the power of two of bins that share one."""
    nodes: dict[int, np.ndarray]
    first: dict[int, np.ndarray]
    shift: dict[int, np.ndarray]
    span: dict[int, tuple[int, int]]
    total: int

    @classmethod
    def of(cls, nodes, big, grid: _Bins) -> "_Cells":
        ids, first, shift, span, total = {}, {}, {}, {}, 0
        for t, own in big.items():
            if own:
                span[t] = (total, total)
                ids[t] = np.array(sorted(own), np.int64)
                first[t], shift[t] = (np.zeros((len(own), len(grid.edges)), np.int64) for _ in range(2))
                for i, node in enumerate(ids[t].tolist()):
                    most = max(64, 2 * int(nodes[t][node][2] ** 0.5))             # a bin of about sqrt(n) rows bounds the cost well
                    for f, e in enumerate(grid.edges):
                        while (len(e) >> shift[t][i, f]) + 1 > most:
                            shift[t][i, f] += 1
                        first[t][i, f] = total
                        total += int(len(e) >> shift[t][i, f]) + 1
                span[t] = (span[t][0], total)
        return cls(ids, first, shift, span, total)

    def at(self, t, node: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The cells of rows x features."""
        i = np.searchsorted(self.nodes[t], node)
        return self.first[t][i] + (codes >> self.shift[t][i])


#: Cells of one block of counts on their way to the driver.
WIDE = 4_096


def _level(data, nodes, big, criteria, grid: _Bins):
    """Best split (feature, threshold, left n, left pos) of every big node."""
    spark = data.sparkSession
    cells = _Cells.of(nodes, big, grid)
    shared = spark.sparkContext.broadcast((nodes, {t: v for t, v in big.items() if v}, grid, cells))         # nodes above local_rows rows, bins

    def count(batches):
        nodes, wanted, grid, cells = shared.value
        n, pos = (np.zeros(-(-cells.total // WIDE) * WIDE) for _ in range(2))
        last = codes = None
        for b, t, at, node, y, x in _batches(batches, nodes, wanted):
            if last is not b:
                last, codes = b, grid.codes(x)
            lo, hi = cells.span[t]
            cell = cells.at(t, node, codes[at])
            n[lo:hi] += np.bincount(cell.ravel() - lo, minlength=hi - lo)
            pos[lo:hi] += np.bincount(cell.ravel() - lo, np.repeat(y[at], cell.shape[1]), hi - lo)
        return {"n": n.reshape(-1, WIDE), "pos": pos.reshape(-1, WIDE)}

    sums = array_sums(data.select("trees", "y", "x"), count)
    n, pos = (np.atleast_2d(sums[k]).ravel()[:cells.total].astype(np.int64) for k in ("n", "pos"))
    group = np.full(cells.total, -1, np.int64)
    before_n, before_pos = np.zeros(cells.total, np.int64), np.zeros(cells.total, np.int64)
    best: dict[tuple[int, int], tuple] = {}
    about, groups = {}, []
    for t, ids in cells.nodes.items():
        for i, node in enumerate(ids.tolist()):
            all_n, all_pos = (float(v) for v in nodes[t][node][2:])
            maybe, least = [], (np.inf,)
            for f, e in enumerate(grid.edges):
                a, shift = int(cells.first[t][i, f]), int(cells.shift[t][i, f])
                width = (len(e) >> shift) + 1
                own_n, own_pos = n[a:a + width], pos[a:a + width]
                to_n, to_pos = np.cumsum(own_n), np.cumsum(own_pos)
                before_n[a:a + width], before_pos[a:a + width] = to_n - own_n, to_pos - own_pos
                ends = np.flatnonzero((own_n > 0) & (to_n < all_n))                   # splits after a bin
                cost = best_split(to_n[ends].astype(float), to_pos[ends].astype(float), all_n, all_pos, criteria[t])
                used = np.flatnonzero(own_n > 0)
                one = grid.one[f][used] if not shift else np.zeros(len(used), bool)
                corners = [(to_n - own_n + own_pos, to_pos), (to_n - own_pos, to_pos - own_pos), (to_n - own_n, to_pos - own_pos), (to_n, to_pos)]
                low = np.min([best_split(u[used].astype(float), v[used].astype(float), all_n, all_pos, criteria[t]) for u, v in corners], axis=0)
                maybe.append((f, a, shift, used[~one], low[~one]))
                if len(ends):
                    least = min(least, (float(cost.min()),))
                single = np.isin(ends, used[one])
                if single.any():
                    j = int(np.argmin(cost[single]))
                    k = int(ends[single][j])
                    best[t, node] = min(best.get((t, node), (np.inf,)), (float(cost[single][j]), f, float(e[k]), int(to_n[k]), int(to_pos[k])))
            for f, a, shift, used, low in maybe:
                own = a + used[low <= least[0] + 1e-9 * (1 + abs(least[0]))]
                for part in np.split(own, np.flatnonzero(np.diff(np.cumsum(n[own]) // TASK_VALUES)) + 1) if len(own) else []:
                    group[part] = len(groups)
                    groups.append((t, node, f, all_n, all_pos, criteria[t]))
    if groups:
        more = spark.sparkContext.broadcast((group, before_n, before_pos, groups))         # cells of the level

        def values(batches):
            nodes, wanted, grid, cells = shared.value
            group, last, codes = more.value[0], None, None
            for b, t, at, node, y, x in _batches(batches, nodes, wanted):
                if last is not b:
                    last, codes = b, grid.codes(x)
                every = cells.at(t, node, codes[at])
                asked = group[every] >= 0
                for f in np.flatnonzero(asked.any(0)).tolist():
                    own = np.flatnonzero(asked[:, f])
                    cell, v, mine = every[own, f], x[at[own], f], y[at[own]]
                    order = np.lexsort((v, cell))
                    cell, v, mine = cell[order], v[order], mine[order]
                    first = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (v[1:] != v[:-1])))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group[cell[first]]), pa.array(cell[first]), pa.array(v[first]),
                         pa.array(np.diff(np.append(first, len(cell)))), pa.array(np.add.reduceat(mine, first).astype(np.int64))],
                        names=["group", "cell", "v", "n", "pos"])

        def inside(key, table):
            _, before_n, before_pos, groups = more.value
            _, _, _, all_n, all_pos, criterion = groups[key[0].as_py()]
            cell, v, own_n, own_pos = (table.column(c).to_numpy() for c in ("cell", "v", "n", "pos"))
            order = np.lexsort((v, cell))
            cell, v, own_n, own_pos = cell[order], v[order], own_n[order], own_pos[order]
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(cell))))
            run = lambda c, base: (c := np.cumsum(c)) - np.append(0, c)[first][of] + base[cell]
            left_n, left_pos = run(own_n, before_n), run(own_pos, before_pos)
            cost = best_split(left_n.astype(float), left_pos.astype(float), all_n, all_pos, criterion)
            last = np.append(v[1:] != v[:-1], True)                                        # of the rows with equal values from several batches
            last[:-1] |= cell[1:] != cell[:-1]
            cost = np.where(last & (left_n < all_n), cost, np.inf)
            i = np.lexsort((v, cost))[0]
            return pa.table({"group": [key[0].as_py()], "cost": [float(cost[i])], "v": [float(v[i])], "n": [int(left_n[i])], "pos": [int(left_pos[i])]})

        found = (data.select("trees", "y", "x").mapInArrow(values, "group long, cell long, v double, n long, pos long")
                 .groupBy("group").applyInArrow(inside, "group long, cost double, v double, n long, pos long").collect())       # a row per TASK_VALUES rows
        for r in found:
            t, node, f = groups[r.group][:3]
            if r.cost < np.inf:
                best[t, node] = min(best.get((t, node), (np.inf,)), (r.cost, f, r.v, r.n, r.pos))
    best = {k: v for k, v in best.items() if len(v) > 1}

    def above(batches):
        nodes, wanted, _, _ = shared.value
        out: dict[tuple[int, int], float] = {}
        for _, t, at, node, _, x in _batches(batches, nodes, wanted):
            for i in np.unique(node).tolist():
                if (t, i) in best:
                    _, f, low = best[t, i][:3]
                    v = x[at[node == i], f]
                    v = v[v > low]
                    if len(v):
                        out[t, i] = min(out.get((t, i), np.inf), float(v.min()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int32()), pa.array([k[1] for k in out], pa.int64()), pa.array(list(out.values()))],
                                             names=["tree", "node", "v"])

    found = data.select("trees", "y", "x").mapInArrow(above, "tree int, node long, v double").groupBy("tree", "node").agg(F.min("v").alias("high")).collect()
    out: dict[int, dict[int, tuple]] = {}
    for r in found:                                                                        # a row per big node
        _, f, low, left_n, left_pos = best[r.tree, r.node]
        t = (low + r.high) / 2
        out.setdefault(r.tree, {})[r.node] = (f, low if t >= r.high else t, left_n, left_pos)
    return out


def _finish(data, nodes, small, criteria, max_depth, min_split) -> dict[int, list[np.ndarray]]:
    """Per tree the columns (node, feature, threshold, n, pos) of the subtrees below the small nodes, each grown in one task."""
    shared = data.sparkSession.sparkContext.broadcast((nodes, {t: v for t, v in small.items() if v}))       # nodes above local_rows rows and their children

    def place(batches):
        for b, t, at, node, _, _ in _batches(batches, *shared.value):
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(node), b.column(1).take(take), b.column(2).take(take)],
                                             names=["tree", "node", "y", "x"])

    def run(key, table):
        tree, root = (k.as_py() for k in key)
        found = grow_columns(_matrix(table.column("x")), table.column("y").to_numpy().astype(np.int64), criteria[tree], max_depth, min_split, root)
        return pa.table([pa.array(np.full(len(found[0]), tree, np.int32)), *(pa.array(c) for c in found)], names=["tree", "node", "f", "t", "n", "pos"])

    placed = data.select("trees", "y", "x").mapInArrow(place, "tree int, node long, y int, x array<double>")
    got = placed.groupBy("tree", "node").applyInArrow(run, "tree int, node long, f long, t double, n long, pos long").toArrow()       # the nodes of the trees
    tree, columns = got.column("tree").to_numpy(), [got.column(c).to_numpy() for c in ("node", "f", "t", "n", "pos")]
    return {t: [c[tree == t] for c in columns] for t in np.unique(tree).tolist()}


def fit_tree(train: DataFrame, features, label: str = "label", max_depth: int = MAX_DEPTH, min_split: int = MIN_SPLIT,
             criterion: str = GINI, local_rows: int = LOCAL_ROWS) -> Tree:
    """M3: one exact tree over the feature columns."""
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    return grow(train.select(F.lit(0).alias("tree"), F.col(label).alias("y"), x.alias("x")), {0: criterion}, max_depth, min_split, local_rows)[0]


def with_tree(rows: DataFrame, tree: Tree, features) -> DataFrame:
    """``rows`` plus ``probability`` of class 1 and ``pred`` (ties to 0)."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)                 # the nodes of one tree

    @F.pandas_udf("double")
    def run(x):
        import pandas as pd
        return pd.Series(shared.value.probability(np.stack(x.to_list())) if len(x) else np.zeros(0))

    x = F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features])
    return rows.withColumn("probability", run(x)).withColumn("pred", (F.col("probability") > 0.5).cast("int"))


def tree_shapley(x: np.ndarray, tree: Tree, background: np.ndarray) -> tuple[np.ndarray, float]:
    """Exact Shapley values of the tree's probability against one background row.

    A leaf's box is reached by a coalition when the features on its path that
    only x satisfies (a of them) are in it and those that only the background
    satisfies (b of them) are not; each of the former gains value * (a-1)! b! / (a+b)!,
    each of the latter loses value * a! (b-1)! / (a+b)!.  No sampling."""
    out = np.zeros(x.shape)
    for value, f, low, high, theirs in tree.paths(background):
        if not len(f):
            continue
        mine = (x[:, f] > low) & (x[:, f] <= high)
        can = (mine | theirs).all(1)
        for_, against = mine & ~theirs, ~mine & theirs
        a, b = for_.sum(1), against.sum(1)
        most = int((a + b).max(initial=0))
        fact = np.array([factorial(i) for i in range(most + 1)], float)
        gain = np.where(can & (a > 0), value * fact[np.maximum(a - 1, 0)] * fact[b] / fact[a + b], 0.0)
        loss = np.where(can & (b > 0), value * fact[a] * fact[np.maximum(b - 1, 0)] / fact[a + b], 0.0)
        out[:, f] += for_ * gain[:, None] - against * loss[:, None]
    return out, float(tree.probability(background[None])[0])
