"""Helpers shared by the corpus operators."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.session import stored
from tidemark.sources.tables import table

__all__ = ["stored", "table", "named", "bounded_sample", "components", "Cells", "UnionFind"]

#: Largest number of points that one side of a comparison cell holds.
CELL_ROWS = 65_536


def named(columns: list[str]) -> list:
    """Columns by their exact names, dots and backticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, the same ones on every run: smallest hash of ``key``."""
    return df.orderBy(F.xxhash64(F.lit(17), F.col(key)), F.col(key)).limit(n)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, where
    component is the smallest reachable node.  Only nodes with an edge occur.

    Rounds of neighbour minimum and pointer jumping until no label moves; each
    round is one stored table, so a lost executor costs at most a round.  Hub
    nodes meet one label row each, in joins that AQE may split.
    """
    edges = edges.where("a <> b").select("a", "b")
    both = stored(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("component")))
    for _ in range(max_rounds):
        near = (both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node"))
                .agg(F.min("component").alias("m")))
        new = labels.join(near, "node").select("node", F.col("component").alias("old"),
                                               F.least("component", "m").alias("component"))
        target = labels.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        new = stored(new.join(target, "component", "left")
                     .select("node", "old", F.least("component", F.coalesce("jump", "component"))
                             .alias("component")))
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels
    raise RuntimeError(f"components still move after {max_rounds} rounds")


class Cells:
    """Deals points of partitions ("leaves") to comparison cells of bounded size.

    ``home[l]`` points live in leaf l, ``visit[l]`` points of other leaves must
    be compared with them.  Both are cut into blocks of at most ``rows`` points;
    a cell is one home block against one home or visiting block, so no task
    ever holds more than two blocks however many points one leaf gathers.
    """

    def __init__(self, home: dict[int, int], visit: dict[int, int], rows: int = CELL_ROWS):
        self.home = {leaf: -(-n // rows) for leaf, n in home.items()}
        self.visit = {leaf: -(-n // rows) for leaf, n in visit.items() if leaf in home}

    def _deal(self, at: np.ndarray, leaf: int, salt: np.ndarray, visiting: bool):
        nb, nv = self.home.get(leaf, 0), self.visit.get(leaf, 0)
        if not nb or not len(at):
            return
        if visiting:
            block = salt % nv
            for i in range(nb):
                yield at, leaf, np.full(len(at), i), nb + block, True
            return
        block = salt % nb
        for j in range(nb + nv):              # as data of its own block ...
            here = block <= j if j < nb else np.ones(len(at), bool)
            yield at[here], leaf, block[here], np.full(here.sum(), j), False
        for i in range(nb - 1):               # ... and as query of the blocks before
            here = block > i
            yield at[here], leaf, np.full(here.sum(), i), block[here], True

    def deal(self, leaves: np.ndarray, salt: np.ndarray, visiting: bool):
        """Index of the point, cell (leaf, i, j) and role (True: query) of every copy."""
        out = []
        for leaf in np.unique(leaves).tolist():
            at = np.flatnonzero(leaves == leaf)
            out.extend(self._deal(at, leaf, salt[at], visiting))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none, none, np.zeros(0, bool)
        return (np.concatenate([x[0] for x in out]),
                np.concatenate([np.full(len(x[0]), x[1]) for x in out]),
                np.concatenate([x[2] for x in out]).astype(np.int64),
                np.concatenate([x[3] for x in out]).astype(np.int64),
                np.concatenate([np.full(len(x[0]), x[4]) for x in out]))


class UnionFind:
    """Sets over 0..n-1; ``join`` takes arrays of pairs and skips joined ones."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def _find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.up[a] != self.up[b]
        if not apart.any():
            return
        pairs = np.unique(np.stack([self.up[a[apart]], self.up[b[apart]]], 1), axis=0)
        for x, y in pairs.tolist():
            x, y = self._find(x), self._find(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)
        while not np.array_equal(flat := self.up[self.up], self.up):
            self.up = flat
