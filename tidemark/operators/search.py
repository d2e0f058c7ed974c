"""Hyperparameter search (M5): sequential proposals by density ratios, mean F1 over folds.

After some random trials a proposal compares two densities over each parameter:
one of the better trials, one of the others; of some draws from the first the one
with the largest ratio is tried.  Seeded, so the trial table is the same on every run.

What the folds share is computed once: sums per fold for all smoothing values of
naive Bayes, one full tree per fold and criterion and the held-out rows below each of its
nodes for all depths and split sizes, the votes of the 50 nearest neighbours outside a row's fold per
metric for all k and weights, one Fourier map per gamma.  A trial of a tree adds up its leaves, one of
neighbours looks its counts up; any other is one pass over the stored training rows.
"""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.operators import neighbours, svm, trees
from tidemark.operators.models import stratified_folds
from tidemark.session import stored

SEED = 42
#: Random trials before the first proposal, draws per proposal, share of better trials.
STARTUP, DRAWS, BETTER = 10, 24, 0.2
#: Parameter ranges, trials and folds by model type.
SPACES = {
    "KNN": {"n_neighbors": ("int", 1, 50), "weights": ("choice", "uniform", "distance"), "metric": ("choice", "euclidean", "manhattan")},
    "NaiveBayes": {"var_smoothing": ("log", 1e-11, 1e-7)},
    "DecisionTree": {"max_depth": ("int", 1, 20), "min_samples_split": ("int", 2, 20), "criterion": ("choice", "gini", "entropy")},
    "SVM": {"C": ("log", 0.1, 10.0), "kernel": ("choice", "linear", "rbf"), "gamma": ("choice", "scale", "auto")},
}
TRIALS, FOLDS, SVM_TRIALS, SVM_FOLDS = 50, 5, 12, 3


def _unit(spec, v) -> float:
    """A parameter value as a number in 0..1 (choices: its place)."""
    if spec[0] == "choice":
        return float(spec[1:].index(v))
    low, high = spec[1:]
    return (math.log(v / low) / math.log(high / low)) if spec[0] == "log" else (v - low + 0.5) / (high - low + 1)


def _value(spec, u: float):
    if spec[0] == "choice":
        return spec[1:][int(u)]
    low, high = spec[1:]
    return low * (high / low) ** u if spec[0] == "log" else int(min(high, low + math.floor(u * (high - low + 1))))


def _density(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Normal kernels at the points on 0..1, cut off at the ends, beside one uniform kernel."""
    width = max(0.05, 1.0 / (1 + len(points)))
    phi = np.vectorize(lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2))))
    inside = phi((1 - points) / width) - phi(-points / width)
    k = np.exp(-0.5 * ((at[:, None] - points[None, :]) / width) ** 2) / (width * math.sqrt(2 * math.pi)) / inside[None, :]
    return (k.sum(1) + 1.0) / (len(points) + 1)


def propose(space: dict, history: list[tuple[dict, float]], rng: np.random.Generator) -> dict:
    """The next setting to try; random as long as there are few trials."""
    out = {}
    ranked = sorted(range(len(history)), key=lambda i: (-history[i][1], i))
    cut = max(1, math.ceil(BETTER * len(history)))
    for name, spec in space.items():
        if len(history) < STARTUP:
            out[name] = _value(spec, rng.integers(len(spec) - 1) if spec[0] == "choice" else rng.random())
            continue
        u = np.array([_unit(spec, history[i][0][name]) for i in ranked])
        good, rest = u[:cut], u[cut:]
        if spec[0] == "choice":
            count = len(spec) - 1
            p, q = ((np.bincount(v.astype(int), minlength=count) + 1.0) / (len(v) + count) for v in (good, rest))
            draws = rng.choice(count, DRAWS, p=p)
            out[name] = _value(spec, draws[np.argmax(p[draws] / q[draws])])
            continue
        centre = rng.integers(len(good) + 1, size=DRAWS)
        width = max(0.05, 1.0 / (1 + len(good)))
        draws = np.where(centre < len(good), np.append(good, 0)[np.minimum(centre, len(good))] + width * rng.normal(size=DRAWS), rng.random(DRAWS))
        draws = np.clip(draws, 0, 1 - 1e-9)
        out[name] = _value(spec, float(draws[np.argmax(_density(good, draws) / _density(rest, draws))]))
    return out


def search(space: dict, evaluate: Callable[[dict], float], trials: int, seed: int = SEED) -> list[tuple[dict, float]]:
    """All trials in order as (setting, score); a setting met before keeps its score."""
    rng, history, known = np.random.default_rng(seed), [], {}
    for _ in range(trials):
        setting = propose(space, history, rng)
        key = tuple(sorted(setting.items()))
        if key not in known:
            known[key] = evaluate(setting)
        history.append((setting, known[key]))
    return history


def mean_f1(counts: dict[int, tuple[int, int, int]]) -> float:
    """Mean over folds of F1 from (true positive, false positive, false negative)."""
    return float(np.mean([2 * tp / (2 * tp + fp + fn) if tp else 0.0 for tp, fp, fn in counts.values()]))


def _x(features):
    return F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features])


def folded(train: DataFrame, features, id_col: str, label: str, folds: int) -> DataFrame:
    """(id, y, fold, x), stored.  Rows with a null label are left out."""
    train = train.where(F.col(label).isNotNull())
    fold = stratified_folds(train.select(id_col, label), id_col, label, folds).select(F.col(id_col).alias("_id"), "fold")
    rows = train.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"), _x(features).alias("x"))
    return stored(rows.join(fold, F.col("id") == F.col("_id")).select("id", "y", "fold", "x"))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def fold_counts(rows: DataFrame, predictors: dict[int, Callable]) -> dict[int, tuple[int, int, int]]:
    """(tp, fp, fn) of each fold's rows under that fold's predictor of classes: one pass."""
    shared = rows.sparkSession.sparkContext.broadcast(predictors)           # one model a fold

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            y, fold, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2)) if b.num_rows else None
            for f in np.unique(fold).tolist():
                own = fold == f
                p, t = shared.value[f](x[own]) == 1, y[own] == 1
                total[f] = total.get(f, np.zeros(3, np.int64)) + [(p & t).sum(), (p & ~t).sum(), (~p & t).sum()]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total))] + [pa.array([int(v[i]) for v in total.values()]) for i in range(3)],
                                             names=["fold", "tp", "fp", "fn"])
    found = (rows.select("y", "fold", "x").mapInArrow(run, "fold long, tp long, fp long, fn long").groupBy("fold")
             .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).collect())
    return {r.fold: (r.tp, r.fp, r.fn) for r in found}


class NaiveBayesFold:
    """Classes by Gaussian naive Bayes from sums (label 0, 1 x count, sums, square sums)."""

    def __init__(self, n, total, square, smoothing: float):
        n = np.maximum(n, 1)
        self.mean = total / n[:, None]
        everyone = square.sum(0) / n.sum() - (total.sum(0) / n.sum()) ** 2
        self.var = np.maximum(square / n[:, None] - self.mean ** 2, 0) + smoothing * everyone.max()
        self.prior = np.log(n / n.sum())

    def __call__(self, x):
        with np.errstate(divide="ignore", invalid="ignore"):
            jll = [self.prior[c] - 0.5 * (np.log(2 * np.pi * self.var[c]) + (x - self.mean[c]) ** 2 / self.var[c]).sum(1) for c in (0, 1)]
        return (jll[1] > jll[0]).astype(int)


def held_out(rows: DataFrame, grown: dict[tuple[int, int], trees.Tree]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Per (fold, criterion) the held-out rows and positive rows below each node of the tree: one pass."""
    shared = rows.sparkSession.sparkContext.broadcast(grown)                # the nodes of the trees

    def run(batches):
        for b in batches:
            y, fold, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2)) if b.num_rows else None
            for (f, c), tree in shared.value.items():
                own = fold == f
                if own.any():
                    node, at = np.unique(tree.leaf(x[own]), return_inverse=True)
                    n, pos = np.bincount(at), np.bincount(at, weights=y[own] == 1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), v)) for v in (f, c)] + [pa.array(v) for v in (node, n, pos)],
                                                     names=["fold", "criterion", "node", "n", "pos"])
    found = (rows.select("y", "fold", "x").mapInArrow(run, "fold long, criterion long, node long, n long, pos long")
             .groupBy("fold", "criterion", "node").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).toPandas())      # a row per leaf
    out = {}
    for (f, c), tree in grown.items():
        own = found[(found.fold == f) & (found.criterion == c)]
        if len(own):
            n, pos = np.zeros(len(tree.n), np.int64), np.zeros(len(tree.n), np.int64)
            n[own.node], pos[own.node] = own.n, own.pos
            out[f, c] = tree.sums(n), tree.sums(pos)
    return out


def naive_bayes_folds(rows: DataFrame, width: int, folds: int):
    """A function of a setting: (tp, fp, fn) of every fold, trained on the others."""
    sums = rows.groupBy("fold", "y").agg(F.count("y").alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width)],
                                         *[F.sum(F.col("x")[i] ** 2).alias(f"q{i}") for i in range(width)]).collect()
    n, total, square = np.zeros((folds, 2)), np.zeros((folds, 2, width)), np.zeros((folds, 2, width))
    for r in sums:
        n[r.fold, r.y], total[r.fold, r.y], square[r.fold, r.y] = r.n, [r[f"s{i}"] for i in range(width)], [r[f"q{i}"] for i in range(width)]

    def evaluate(setting):
        return fold_counts(rows, {f: NaiveBayesFold(*(v.sum(0) - v[f] for v in (n, total, square)), setting["var_smoothing"]) for f in range(folds)})
    return evaluate


def naive_bayes_evaluator(rows: DataFrame, width: int, folds: int):
    counts = naive_bayes_folds(rows, width, folds)
    return lambda setting: mean_f1(counts(setting))


def tree_evaluator(rows: DataFrame, folds: int, max_depth: int = 20, **options):
    names = [trees.GINI, trees.ENTROPY]
    keys = {f * 2 + c: names[c] for f in range(folds) for c in (0, 1)}
    of = F.filter(F.array(*[F.lit(t) for t in keys]), lambda t: F.floor(t / 2) != F.col("fold"))
    trained = trees.grow(rows.select(of.alias("tree"), "y", "x"), keys, max_depth, 2, **options)
    grown = {divmod(t, 2): tree for t, tree in trained.items()}
    held = held_out(rows, grown)

    def evaluate(setting):
        c, counts = names.index(setting["criterion"]), {}
        for f in (f for f in range(folds) if (f, c) in held):
            tree = grown[f, c].truncated(setting["max_depth"], setting["min_samples_split"])
            at = tree.leaves()
            p, (n, pos) = tree.value[at] > 0.5, (v[at] for v in held[f, c])
            counts[f] = (int(pos[p].sum()), int((n - pos)[p].sum()), int(pos[~p].sum()))
        return mean_f1(counts)
    return evaluate


def votes(d: np.ndarray, payload: np.ndarray, size: np.ndarray, most: int) -> dict[str, np.ndarray]:
    """Per kind of weights (rows x 0..most-1): whether the first 1..most entries of a row's list vote for class 1, as :func:`neighbours.vote`
    does with the sliced list.  ``d`` and ``payload`` hold the lists of ``size`` entries one after the other; an empty list votes for nothing."""
    row = np.repeat(np.arange(len(size)), size)
    col = np.arange(len(d)) - np.repeat(np.cumsum(size) - size, size)
    total = lambda v: np.cumsum(_laid(v, row, col, len(size), most), axis=1)  # noqa: E731  one after the other, as aggregate() adds
    same, ones = d == 0, np.ones(len(d))
    near = np.divide(1.0, d, out=np.zeros(len(d)), where=~same)
    some = total(same * ones) > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        uniform = total(payload) / total(ones) > 0.5
        distance = np.where(some, total(same * payload) / total(same * ones), total(near * payload) / total(near)) > 0.5
    return {"uniform": uniform, "distance": distance}


def _laid(v, row, col, rows: int, width: int) -> np.ndarray:
    out = np.zeros((rows, width))
    out[row, col] = v
    return out


def knn_evaluator(rows: DataFrame, folds: int, most: int = 50, **options):
    counts: dict[tuple, dict[int, tuple[int, int, int]]] = {}

    def hits(batches):
        """(qid, fold, hits): for a row with neighbours a byte per setting, 1 where its list votes for class 1."""
        for b in batches:
            best = b.column("best")
            size, near = best.value_lengths().to_numpy(), best.flatten()
            by = votes(near.field("d").to_numpy(), near.field("payload").to_numpy(zero_copy_only=False), size, most)
            packed = np.concatenate([by["uniform"], by["distance"]], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("fold"), pa.array([p.tobytes() if n else None for p, n in zip(packed, size)], pa.binary())],
                                             names=["qid", "fold", "hits"])

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            known = b.column("hits").is_valid().to_numpy(zero_copy_only=False)
            fold = b.column("fold").to_numpy()
            for f in np.unique(fold).tolist():
                own = np.flatnonzero(fold == f)
                total.setdefault(f, np.zeros((3, 2 * most), np.int64))
                own = own[known[own]]
                p = np.frombuffer(b"".join(b.column("hits").take(pa.array(own)).to_pylist()), np.uint8).reshape(len(own), 2 * most) == 1
                t = (b.column("y").to_numpy()[own] == 1)[:, None]
                total[f] += [(p & t).sum(0), (p & ~t).sum(0), (~p & t).sum(0)]
        at = np.tile(np.arange(2 * most), len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([*total], np.int64), 2 * most)), pa.array(at)]
                                         + [pa.array(np.concatenate([v[i] for v in total.values()]) if total else np.zeros(0, np.int64)) for i in range(3)],
                                         names=["fold", "at", "tp", "fp", "fn"])

    def count_all(metric):
        """All settings of a metric in one pass over the lists."""
        data = rows.select("id", "x", F.col("y").cast("double").alias("payload"), "fold")
        own = rows.select(F.col("id").cast("long").alias("qid"), "x", "y", F.col("fold").cast("long").alias("fold"))
        found = neighbours.nearest(own, data, most, metric, fold="fold", **options)
        voted = found.select("qid", "fold", "best").mapInArrow(hits, "qid long, fold long, hits binary")
        got = (voted.join(own.drop("x"), ["qid", "fold"]).select("y", "fold", "hits").mapInArrow(count, "fold long, at long, tp long, fp long, fn long")
               .groupBy("fold", "at").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).collect())      # a row per fold and setting
        for r in got:
            weights, n = ("uniform", "distance")[r.at // most], r.at % most + 1
            counts.setdefault((metric, weights, n), {})[r.fold] = (r.tp, r.fp, r.fn)
        counts[metric,] = {}

    def evaluate(setting):
        if (setting["metric"],) not in counts:
            count_all(setting["metric"])
        found = counts.get((setting["metric"], setting["weights"], min(setting["n_neighbors"], most)), {})
        return mean_f1(dict(sorted(found.items())))
    return evaluate


def svm_evaluator(rows: DataFrame, width: int, folds: int, max_iter: int = svm.MAX_ITER):
    maps: dict[str, svm.FourierMap] = {}

    def evaluate(setting):
        fourier = None
        if setting["kernel"] == svm.RBF:
            if setting["gamma"] not in maps:
                maps[setting["gamma"]] = svm.FourierMap.draw(width, svm.gamma_of(rows, width, setting["gamma"]))
            fourier = maps[setting["gamma"]]
        machines = svm.fit_machines(rows, width, list(range(folds)), setting["C"], fourier, max_iter)
        return mean_f1(fold_counts(rows, {f: m.decision for f, m in machines.items()}))
    return evaluate


def hyperparameters(train: DataFrame, model_type: str, features, id_col: str, label: str = "label", trials: int | None = None,
                    folds: int | None = None, seed: int = SEED, **options) -> list[tuple[dict, float]]:
    """M5: the trials of one model type in order, as (setting, mean F1)."""
    if model_type not in SPACES:
        raise ValueError(f"unknown model type {model_type}")
    machine = model_type == "SVM"
    trials, folds = trials or (SVM_TRIALS if machine else TRIALS), folds or (SVM_FOLDS if machine else FOLDS)
    rows, width = folded(train, features, id_col, label, folds), len(features)
    evaluate = {"KNN": lambda: knn_evaluator(rows, folds, **options), "NaiveBayes": lambda: naive_bayes_evaluator(rows, width, folds),
                "DecisionTree": lambda: tree_evaluator(rows, folds, **options), "SVM": lambda: svm_evaluator(rows, width, folds, **options)}[model_type]()
    return search(SPACES[model_type], evaluate, trials, seed)


def trial_table(spark, history: list[tuple[dict, float]]) -> DataFrame:
    """``trial, setting (JSON), mean_f1, best``: the first of the best trials is marked."""
    import json
    top = max(range(len(history)), key=lambda i: (history[i][1], -i))
    return spark.createDataFrame([(i + 1, json.dumps(s, sort_keys=True), v, i == top) for i, (s, v) in enumerate(history)],
                                 "trial int, setting string, mean_f1 double, best boolean")
