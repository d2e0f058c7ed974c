"""Quality classifier: random Fourier features of document statistics.

Every text becomes a row of statistics (shares of character classes, word and
line shapes, repetition, compressibility).  ``cos(w.x + b)`` with normal w
approximates a Gaussian kernel over the standardised statistics; a ridge on
these features is a kernel machine whose normal equations are sums over rows.
Each partition adds up its own equations per fold, the sums are added in two
steps, and the driver solves one system of fixed size per fold.  Rows are then
scored by the system that left their fold out, and pooled adjacent violators
over a fixed grid of these scores calibrate the final one.

Only statistics are joined with labels, never texts: one pass over the corpus
serves the fit and the scores.
"""
from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import bounded_sample, stored

#: Random features; folds of the calibration; ridge per training row; seed of the features.
FEATURES, FOLDS, RIDGE, SEED = 384, 4, 1e-5, 13
#: Rows whose pairwise distances set the kernel's width, and the factor on their median.
WIDTH_ROWS, WIDTH = 512, 1.5
#: Grid of raw scores for the calibration.
GRID, LOW, HIGH = 4_096, -1.0, 2.0
#: Standardised statistics are cut off here.
CLIP = 4.0
THRESHOLD = 0.3
#: Rows of the normal equations that one summing group holds, first-step groups, rows turned into features at once.
BLOCK, SLOTS, CHUNK = 32, 16, 8_192

_CLASSES = np.full(256, 9, np.int64)          # 9: other punctuation
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b"\t\x0b\x0c",
                           b".,;:?'\"-", b"!", b"|")):
    _CLASSES[list(_set)] = _i
_CLASSES[list(b"#$%&*@~^_=+<>{}[]\\/`")] = 10
_CLASSES[128:] = 11
CLASSES = 12
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c")).astype(np.int8)
STATISTICS = CLASSES + 20


def statistics_of(text: bytes | None) -> np.ndarray:
    """The statistics of one whole text (UTF-8); zeros for null and empty ones."""
    out = np.zeros(STATISTICS, np.float32)
    if not text:
        return out
    size, at = len(text), np.frombuffer(text, np.uint8)
    count = np.bincount(at, minlength=256)
    share = count[count > 0] / size
    out[:CLASSES] = np.bincount(_CLASSES, count, minlength=CLASSES) / size
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    n, k = max(1, len(words)), max(1, len(lines))
    edge = np.flatnonzero(np.diff(_SPACE[at], prepend=1, append=1))          # word starts and the bytes after words
    begins, ends = edge[::2], edge[1::2]
    length = ends - begins if words else np.ones(1, np.int64)
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    equal = sum(map(eq, words, words[1:]))
    kind = np.bincount(_CLASSES[at[ends - 1]], minlength=CLASSES)
    first = np.bincount(_CLASSES[at[begins]], minlength=CLASSES)
    packed = len(zlib.compress(text, 1))
    out[CLASSES:] = (
        np.log1p(size), np.log1p(len(words)), np.log1p(len(lines)), length.mean(), length.std(), (length <= 3).mean(),
        np.log1p(length.max()), len(seen) / n, max(seen.values(), default=0) / n, pairs / n, equal / n,
        kind[0] / n, kind[1] / n, kind[6] / n, (kind[7:11].sum()) / n, first[1] / n, len(set(lines)) / k,
        np.log1p(size / k), packed / size, -(share * np.log2(share)).sum())
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, stats array<float>)``, one row per row of ``docs``.  Only the two
    columns are read; ids may be null or repeated.  A text costs its length."""
    def run(batches):
        for b in batches:
            rows = np.stack([statistics_of(t) for t in b.column(1).to_pylist()]) if b.num_rows else np.zeros((0, STATISTICS), np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, STATISTICS), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], names=["id", "stats"])
    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
            .mapInArrow(run, "id long, stats array<float>"))


@dataclass
class Features:
    """Standardisation and the random cosine features."""
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray

    @classmethod
    def fit(cls, mean, std, sample: np.ndarray, features: int, seed: int) -> "Features":
        scale = np.where(std > 1e-9, std, 1.0)
        x = np.clip((sample - mean) / scale, -CLIP, CLIP)
        square = (x * x).sum(1)
        far = np.sqrt(np.maximum(0, square[:, None] + square[None, :] - 2 * x @ x.T))[np.triu_indices(len(x), 1)]
        width = WIDTH * (float(np.median(far[far > 0])) if (far > 0).any() else 1.0)
        rng = np.random.default_rng(seed)
        return cls(mean, scale, rng.normal(size=(sample.shape[1], features)) / width, rng.uniform(0, 2 * np.pi, features))

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)
        z = np.sqrt(2.0 / len(self.shift)) * np.cos(x @ self.weights + self.shift)
        return np.concatenate([z, np.ones((len(z), 1))], 1)


@dataclass
class Model:
    """Features, ridge weights, and the calibration's knots; without features a constant."""
    features: Features | None
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(stats), self.knots[1][0])
        return np.interp(self.features(stats) @ self.weights, *self.knots)


def isotonic(x: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (x, rate) of the nondecreasing fit to total / n at ascending x."""
    blocks: list[list[float]] = []
    for a, m, t in zip(x.tolist(), n.tolist(), total.tolist()):
        blocks.append([a * m, m, t, a, a])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2] + b[2], blocks[-1][3], b[4]]
    at, rate = [], []
    for _, m, t, low, high in blocks:
        at += [low] if low == high else [low, high]
        rate += [t / m] * (1 if low == high else 2)
    return np.array(at), np.array(rate)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)


def _sums(train: DataFrame, features: Features, folds: int) -> dict[int, np.ndarray]:
    """Per fold the normal equations ``z' [z, y]`` of the rows of that fold."""
    width = len(features.shift) + 1
    shared = train.sparkSession.sparkContext.broadcast(features)            # statistics x features numbers
    schema = "fold int, block int, slot int, part binary"

    def add(batches):
        total = np.zeros((folds, width, width + 1))
        some = False
        for b in batches:
            fold, y, stats = (b.column(i) for i in range(3))
            fold, y = fold.to_numpy(), y.to_numpy().astype(np.float64)
            z = shared.value(_matrix(stats)) if b.num_rows else np.zeros((0, width))
            for f in np.unique(fold):
                own = z[fold == f]
                total[f] += own.T @ np.concatenate([own, y[fold == f][:, None]], 1)
                some = True
        if some:
            slot = TaskContext.get().partitionId() % SLOTS
            for f in range(folds):
                rows = [total[f, i:i + BLOCK].tobytes() for i in range(0, width, BLOCK)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32()),
                     pa.array([slot] * len(rows), pa.int32()), pa.array(rows, pa.binary())], names=["fold", "block", "slot", "part"])

    def gather(key, t):
        total = sum(np.frombuffer(p, np.float64) for p in t.column("part").to_pylist())
        return t.slice(0, 1).set_column(3, "part", pa.array([total.tobytes()], pa.binary()))

    parts = train.select("fold", "y", "stats").mapInArrow(add, schema)
    for key in (("fold", "block", "slot"), ("fold", "block")):
        parts = parts.groupBy(*key).applyInArrow(gather, schema)
    out = {f: np.zeros((width, width + 1)) for f in range(folds)}
    for r in parts.collect():                                               # one row per fold and block
        rows = np.frombuffer(r.part, np.float64).reshape(-1, width + 1)
        out[r.fold][r.block * BLOCK:r.block * BLOCK + len(rows)] = rows
    return out


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", features: int = FEATURES,
        folds: int = FOLDS, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Fit on all rows of ``stats(id, stats)`` that ``labels`` marks 0 or 1.

    Null ids and labels and labels of unknown ids take no part; an id labelled
    twice counts twice.  Without rows or with one class only, the model scores
    every text with the observed rate (0.5 without rows).
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    fold = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(folds)).cast("int").alias("fold")
    train = stored(stats.join(marks, "id").select("id", fold, "y", "stats"))
    column = [F.col("stats")[i].cast("double") for i in range(STATISTICS)]
    about = train.agg(F.count("y"), F.avg("y"), *[F.avg(c) for c in column], *[F.stddev_pop(c) for c in column]).first()
    n, rate = about[0], about[1]
    if not n or rate in (0.0, 1.0):
        return Model(None, np.zeros(0), (np.zeros(1), np.array([0.5 if not n else rate])))
    mean, std = np.array(about[2:2 + STATISTICS], float), np.array(about[2 + STATISTICS:], float)
    sample = _matrix(bounded_sample(train.select("id", "stats"), "id", WIDTH_ROWS).toArrow().column("stats"))
    basis = Features.fit(mean, std, sample, features, seed)
    sums = _sums(train, basis, folds)

    def solve(parts) -> np.ndarray:
        total = sum(parts)
        rows = max(1.0, total[-1, -2])
        penalty = np.full(len(total), ridge * rows)
        penalty[-1] = 0.0
        return np.linalg.solve(total[:, :-1] + np.diag(penalty + 1e-9 * rows), total[:, -1])

    final = solve(sums.values())
    without = np.stack([solve([s for g, s in sums.items() if g != f] if folds > 1 else sums.values()) for f in range(folds)])
    shared = train.sparkSession.sparkContext.broadcast((basis, without))     # fixed size

    def place(batches):
        for b in batches:
            if b.num_rows:
                basis, without = shared.value
                raw = (basis(_matrix(b.column(2))) * without[b.column(0).to_numpy()]).sum(1)
                cell = np.clip((raw - LOW) / (HIGH - LOW) * GRID, 0, GRID - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(1)], names=["cell", "y"])

    cells = sorted((r.cell, r.n, r.ones) for r in train.select("fold", "y", "stats").mapInArrow(place, "cell long, y int")
                   .groupBy("cell").agg(F.count("y").alias("n"), F.sum("y").alias("ones")).collect())      # at most GRID rows
    cell, count, ones = (np.array(c, float) for c in zip(*cells))
    return Model(basis, final, isotonic(LOW + (cell + 0.5) * (HIGH - LOW) / GRID, count, ones))


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` plus ``score`` in 0..1, the calibrated chance of label 1, empty texts included."""
    shared = stats.sparkSession.sparkContext.broadcast(model)                # fixed size

    @F.pandas_udf("double")
    def run(x):
        import pandas as pd
        rows = np.stack(x.to_list()).astype(np.float64) if len(x) else np.zeros((0, STATISTICS))
        return pd.Series(np.concatenate([shared.value.score(rows[i:i + CHUNK]) for i in range(0, len(rows), CHUNK)] or [np.zeros(0)]))

    return stats.withColumn("score", run(F.col("stats")))


def held_out(id_col: Column) -> Column:
    """Fold of the contract: 5 divides the crc32 of the id as text (null ids: no)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))
