"""Sums of arrays over all rows: added up inside partitions, then in two grouped steps."""
from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Rows of a matrix that one summing group holds; groups of the first step per block.
BLOCK, SLOTS = 32, 16
_SCHEMA = "name string, block int, slot int, part binary"


def array_sums(df: DataFrame, add: Callable[[Iterable[pa.RecordBatch]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """``add`` turns a partition's batches into named matrices (or vectors) of doubles;
    the sums over partitions come back by name.  What reaches the driver is one
    set of matrices; a summing task holds ``BLOCK`` rows of one of them per partition."""
    def run(batches):
        slot = TaskContext.get().partitionId() % SLOTS
        for name, value in add(batches).items():
            rows = np.atleast_2d(np.asarray(value, float))
            for i in range(0, len(rows), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([f"{name}:{rows.shape[1]}"]), pa.array([i // BLOCK], pa.int32()), pa.array([slot], pa.int32()),
                                                  pa.array([rows[i:i + BLOCK].tobytes()], pa.binary())], names=["name", "block", "slot", "part"])

    def gather(key, t):
        total = sum(np.frombuffer(p, np.float64) for p in t.column("part").to_pylist())
        return t.slice(0, 1).set_column(3, "part", pa.array([total.tobytes()], pa.binary()))

    parts = df.mapInArrow(run, _SCHEMA)
    for keys in (("name", "block", "slot"), ("name", "block")):
        parts = parts.groupBy(*keys).applyInArrow(gather, _SCHEMA)
    found: dict[str, list] = {}
    for r in parts.orderBy("name", "block").collect():
        found.setdefault(r.name, []).append(np.frombuffer(r.part, np.float64))
    out = {}
    for name, blocks in found.items():
        plain, width = name.rsplit(":", 1)
        value = np.concatenate(blocks).reshape(-1, int(width))
        out[plain] = value[0] if len(value) == 1 else value
    return out
