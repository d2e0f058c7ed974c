"""Support vector machines (M4): linear, or a Gaussian kernel through random
Fourier features, with probabilities from out-of-fold margins.

``cos(w.x + b)`` with w normal of variance 2 gamma approximates exp(-gamma |x - y|^2)
by a plain product; the error of a kernel value falls as 1 / sqrt(features).  The
machine on these features is linear again, trained by least squares whose systems are
added up inside partitions.  A logistic curve on margins that rows got from machines which did not see
them (folds of M6) turns margins into probabilities.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.sums import array_sums
from tidemark.session import stored

LINEAR, RBF = "linear", "rbf"
SCALE, AUTO = "scale", "auto"
C, MAX_ITER, FOLDS, SEED = 1.0, 1500, 5, 42         # fixed values: defaults of the model type; folds of the probabilities
FEATURES = 256                                       # random features of the Gaussian kernel
#: Half width of the rounded corner of the hinge; relative gain at which the steps end.
ROUND, TOLERANCE = 0.1, 1e-5


@dataclass
class FourierMap:
    weights: np.ndarray
    shift: np.ndarray

    @classmethod
    def draw(cls, width: int, gamma: float, features: int = FEATURES, seed: int = SEED) -> "FourierMap":
        rng = np.random.default_rng(seed)
        return cls(rng.normal(scale=np.sqrt(2 * gamma), size=(width, features)), rng.uniform(0, 2 * np.pi, features))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / len(self.shift)) * np.cos(x @ self.weights + self.shift)


@dataclass
class Svm:
    weights: np.ndarray
    bias: float
    fourier: FourierMap | None = None
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (x if self.fourier is None else self.fourier(x)) @ self.weights + self.bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -500, 500)))

    def decision(self, x: np.ndarray) -> np.ndarray:
        """The machine's own class; it may disagree with a probability above one half."""
        return (self.margin(x) > 0).astype(int)


def gamma_of(rows: DataFrame, width: int, gamma: str) -> float:
    """``scale``: 1 / (width * variance of all values); ``auto``: 1 / width."""
    if gamma == AUTO:
        return 1.0 / width
    if gamma != SCALE:
        raise ValueError(f"unknown gamma {gamma}")
    v = rows.select(F.explode("x").alias("v")).agg(F.var_pop("v")).first()[0]
    return 1.0 / (width * v) if v else 1.0


def fit_machines(rows: DataFrame, width: int, left_out: list, c: float = C, fourier: FourierMap | None = None,
                 max_iter: int = MAX_ITER) -> dict:
    """``rows(y, fold, x)`` -> per entry of ``left_out`` (a fold, or None) the machine of all
    rows outside that fold, without probabilities.

    Minimises C * sum(hinge) + |w|^2 / 2, the hinge rounded over ``ROUND`` around its
    corner, by reweighted least squares: with a = max(|1 - margin|, ROUND) at the
    present point the loss lies below a quadratic that touches it there, whose minimum is
    the next point; the cost never rises.  All machines share the passes, of which
    each returns one system a machine.  One class only gives that class everywhere."""
    d = (width if fourier is None else len(fourier.shift)) + 1

    def systems(points: dict) -> dict[str, np.ndarray]:
        shared = rows.sparkSession.sparkContext.broadcast((points, fourier))                 # a vector a machine

        def add(batches):
            points, fourier = shared.value
            out: dict[str, np.ndarray] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                y, fold = 2.0 * b.column(0).to_numpy() - 1, b.column(1).to_numpy()
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                z = x if fourier is None else fourier(x)
                z = np.concatenate([z, np.ones((len(z), 1))], 1)
                for k, w in points.items():
                    own = slice(None) if k is None else fold != k
                    zo, yo = z[own], y[own]
                    gap = 1 - yo * (zo @ w)
                    a = np.maximum(np.abs(gap), ROUND)
                    loss = ((gap * gap / a + a) / 2 + gap).sum() / 2
                    for name, value in (("head", np.array([loss, len(yo), (yo > 0).sum()])), ("right", (yo * (0.5 / a + 0.5)) @ zo),
                                        ("left", (zo / (2 * a)[:, None]).T @ zo)):
                        out[f"{name}/{k}"] = out.get(f"{name}/{k}", 0) + value
            return out
        return array_sums(rows.select("y", "fold", "x"), add)

    penalty = np.append(np.ones(d - 1), 0.0)
    at, last, out = {k: np.zeros(d) for k in left_out}, {}, {}
    for _ in range(max_iter):
        found = systems(at)
        for k in list(at):
            head = found.get(f"head/{k}")
            if head is None or head[2] in (0, head[1]):                      # no rows, or one class
                out[k] = Svm(np.zeros(0), 0.0 if head is None or not head[1] else 1.0 if head[2] else -1.0, _Nothing())
                del at[k]
                continue
            w = at[k]
            now = c * head[0] + 0.5 * w[:-1] @ w[:-1]
            out[k] = Svm(w[:-1], float(w[-1]), fourier)
            if k in last and last[k] - now <= TOLERANCE * now:
                del at[k]
                continue
            last[k] = now
            at[k] = np.linalg.solve(c * np.atleast_2d(found[f"left/{k}"]) + np.diag(penalty + 1e-9), c * found[f"right/{k}"])
        if not at:
            break
    return out


class _Nothing(FourierMap):
    """Maps rows to no features: the margin is the bias."""

    def __init__(self):
        super().__init__(np.zeros((0, 0)), np.zeros(0))

    def __call__(self, x):
        return np.zeros((len(x), 0))


def platt(margins: np.ndarray, n: np.ndarray, positive: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve through rates positive / n at ``margins``,
    with the usual smoothed targets, by Newton steps."""
    ones = positive.sum()
    high, low = (ones + 1) / (ones + 2), 1 / (n.sum() - ones + 2)
    target = positive * high + (n - positive) * low
    slope, offset = 0.0, float(np.log((ones + 1) / (n.sum() - ones + 1)))

    def loss(a, b):
        z = a * margins + b
        return float((n * np.logaddexp(0, z) - target * z).sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(slope * margins + offset)))
        g = np.array([((n * p - target) * margins).sum(), (n * p - target).sum()])
        w = n * p * (1 - p)
        h = np.array([[(w * margins * margins).sum(), (w * margins).sum()], [(w * margins).sum(), w.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, g)
        rate = 1.0
        while rate > 1e-6 and loss(slope - rate * step[0], offset - rate * step[1]) > loss(slope, offset):
            rate /= 2
        slope, offset = slope - rate * step[0], offset - rate * step[1]
        if np.abs(rate * step).max() < 1e-9:
            break
    return float(slope), float(offset)


#: Cells of margins that the logistic curve is fitted on.
CELLS = 8_192


def fit(train: DataFrame, features, fold: str, label: str = "label", kernel: str = LINEAR, c: float = C, gamma: str = SCALE,
        max_iter: int = MAX_ITER, folds: int = FOLDS, width: int = FEATURES) -> Svm:
    """M4 on scaled columns ``features``; ``fold`` holds each row's fold (M6).  Rows with a
    null label are left out, null features count as zero."""
    x = F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features])
    rows = train.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(fold).alias("fold"), x.alias("x"))
    if kernel not in (LINEAR, RBF):
        raise ValueError(f"unknown kernel {kernel}")
    fourier = FourierMap.draw(len(features), gamma_of(rows, len(features), gamma), width) if kernel == RBF else None
    rows = stored(rows)
    parts = fit_machines(rows, len(features), [None, *range(folds)], c, fourier, max_iter)
    machine = parts.pop(None)
    shared = rows.sparkSession.sparkContext.broadcast(parts)                # one machine a fold

    @F.pandas_udf("double")
    def unseen(x, fold):
        import pandas as pd
        x, out = np.stack(x.to_list()), np.zeros(len(x))
        for f in fold.unique():
            own = (fold == f).to_numpy()
            out[own] = shared.value[int(f)].margin(x[own])
        return pd.Series(out)

    margins = rows.select("y", unseen("x", "fold").alias("m"))
    ends = margins.agg(F.min("m").alias("lo"), F.max("m").alias("hi")).first()
    if ends.lo is not None and ends.hi > ends.lo:
        cell = F.least(F.floor((F.col("m") - ends.lo) / (ends.hi - ends.lo) * CELLS), F.lit(CELLS - 1))
        cells = margins.groupBy(cell.alias("c")).agg(F.avg("m").alias("m"), F.count("y").alias("n"), F.sum("y").alias("p")).orderBy("c").collect()
        machine.slope, machine.offset = platt(*(np.array(v, float) for v in zip(*((r.m, r.n, r.p) for r in cells))))
    return machine


def with_svm(rows: DataFrame, machine: Svm, features) -> DataFrame:
    """``rows`` plus ``probability`` and the machine's own ``pred``."""
    shared = rows.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("struct<probability:double,pred:int>")
    def run(x):
        import pandas as pd
        x = np.stack(x.to_list()) if len(x) else np.zeros((0, len(features)))
        return pd.DataFrame({"probability": shared.value.probability(x), "pred": shared.value.decision(x)})

    x = F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features])
    out = rows.withColumn("_s", run(x))
    return out.withColumn("probability", F.col("_s.probability")).withColumn("pred", F.col("_s.pred")).drop("_s")
