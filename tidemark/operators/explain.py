"""Explanations of a probability against one background row (X4, X5) and the chain
that checks them (X8).

Every explainer maps arrays of scaled rows to arrays of contributions, one Arrow batch
at a time: no row is exploded, windowed or shuffled.  The background is the
all-zero row, the training mean in scaled space.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.operators import score as S
from tidemark.operators.models import NaiveBayes
from tidemark.operators.trees import Tree, tree_shapley

SAMPLES = 100           # fixed value: coalitions per explanation
SEED = 42
#: Predictions made at once.
CHUNK = 400_000


def nb_predictor(nb: NaiveBayes) -> Callable[[np.ndarray], np.ndarray]:
    """Probability of class 1 for rows of scaled features."""
    mean, var = (np.array([[d[(c, f)] for f in nb.features] for c in (0, 1)]) for d in (nb.means, nb.vars))
    prior = np.log([nb.priors[0], nb.priors[1]])

    def predict(x: np.ndarray) -> np.ndarray:
        jll = [prior[c] - 0.5 * (np.log(2 * np.pi * var[c]) + (x - mean[c]) ** 2 / var[c]).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(jll[0] - jll[1], -700, 700)))
    return predict


def coalitions(width: int, samples: int = SAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(coalitions x width 0/1, weights): sizes from the outside in as long as all
    coalitions of a size and its complement fit, the rest of the samples drawn in
    complementary pairs with the kernel's weights.  All fit: exact."""
    from itertools import combinations
    from math import comb
    mass = lambda s: (width - 1) / (s * (width - s))
    rows, weights, left, sizes = [], [], samples, list(range(1, width // 2 + 1))
    while sizes:
        s = sizes[0]
        both = s != width - s
        count = comb(width, s) * (2 if both else 1)
        if count > left:
            break
        for c in combinations(range(width), s):
            row = np.zeros(width)
            row[list(c)] = 1
            for r in (row, 1 - row) if both else (row,):
                rows.append(r)
                weights.append(mass(s) / comb(width, s))
        left -= count
        sizes.pop(0)
    if sizes and left > 1:
        rng = np.random.default_rng(seed)
        p = np.array([mass(s) * (2 if s != width - s else 1) for s in sizes])
        seen: dict[bytes, int] = {}
        drawn = 0
        while len(seen) < left - 1 and drawn < 50 * left:
            drawn += 1
            row = np.zeros(width)
            row[rng.permutation(width)[:int(rng.choice(sizes, p=p / p.sum()))]] = 1
            for r in (row, 1 - row):
                seen[r.astype(np.int8).tobytes()] = seen.get(r.astype(np.int8).tobytes(), 0) + 1
        total = sum(seen.values())
        for k, n in seen.items():
            rows.append(np.frombuffer(k, np.int8).astype(float))
            weights.append(p.sum() * n / total)
    return np.array(rows).reshape(-1, width), np.array(weights)


def kernel_projector(z: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A, c): contributions = A (f(coalitions) - base) + c (p - base), the weighted
    least squares fit whose values sum to p - base."""
    width = z.shape[1]
    if width == 1 or not len(z):
        return np.zeros((width, len(z))), np.full(width, 1.0 / width)
    last = z[:, -1:]
    x = z[:, :-1] - last                                # the last value is what the others leave
    pinv = np.linalg.pinv(x * np.sqrt(weights)[:, None]) * np.sqrt(weights)[None, :]
    a = np.vstack([pinv, -pinv.sum(0)])
    c = -(pinv @ last[:, 0])
    return a, np.append(c, 1 - c.sum())


def kernel_shapley(x: np.ndarray, predict, z: np.ndarray, a: np.ndarray, c: np.ndarray, background: np.ndarray) -> tuple[np.ndarray, float]:
    """X4 of some rows: one coalition matrix and one projector for all of them."""
    base = float(predict(background[None])[0])
    out = np.zeros(x.shape)
    for i in range(0, len(x), max(1, CHUNK // max(1, z.size))):
        own = x[i:i + max(1, CHUNK // max(1, z.size))]
        mixed = np.where(z[None] > 0, own[:, None, :], background).reshape(-1, x.shape[1])
        f = predict(mixed).reshape(len(own), len(z)) if len(z) else np.zeros((len(own), 0))
        out[i:i + len(own)] = (f - base) @ a.T + np.outer(predict(own) - base, c)
    return out, base


def _arrays(scaled: DataFrame, features, outputs, keep) -> DataFrame:
    """``keep``, the scaled values ``_x`` and what ``outputs(x)`` gives per row: a dict of numbers or arrays of rows."""
    features, keep = list(features), list(keep)
    types = dict(scaled.dtypes)
    sample = outputs(np.zeros((1, len(features))))
    names = list(sample)

    def run(batches):
        for pdf in batches:
            x = np.nan_to_num(pdf[features].to_numpy(dtype=float))
            out = pdf[keep].copy()
            out["_x"] = list(x)
            for name, value in outputs(x).items():
                out[name] = list(value) if np.ndim(value) == 2 else value
            yield out[keep + ["_x"] + names]

    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + ["_x array<double>"]
                       + [f"`{k}` " + ("array<double>" if np.ndim(v) == 2 else "double") for k, v in sample.items()])
    return scaled.select(*[F.col(f"`{c}`") for c in [*keep, *features]]).mapInPandas(run, schema)


def _structs(features, values: str):
    names = F.array(*[F.lit(f) for f in features])
    return F.zip_with(F.arrays_zip(names.alias("feature"), F.col("_x").alias("value")), F.col(values), lambda p, c: F.struct(
        p["feature"].alias("feature"), p["value"].alias("value"), c.alias("contribution"))).cast(S.CONTRIB_TYPE)


def explained(scaled: DataFrame, features, explain, predict, keep=()) -> DataFrame:
    """``keep`` plus ``probability, base_value, contributions`` (a struct per
    feature), where ``explain(x)`` gives (contributions, base) and ``predict(x)``
    probabilities.  Null features count as zero; an empty frame gives no rows."""
    def outputs(x):
        values, base = explain(x)
        return {"probability": np.clip(predict(x), 0, 1), "base_value": base, "_c": values}
    found = _arrays(scaled, features, outputs, keep)
    return found.withColumn("contributions", _structs(features, "_c")).drop("_x", "_c")


def explain_kernel(scaled: DataFrame, predict, features, keep=(), samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """Weighted regression on ``samples`` coalitions; sums to p - base, exact when all coalitions fit."""
    return explained(scaled, features, kernel_explainer(predict, len(features), samples, seed), predict, keep)


def explain_tree(scaled: DataFrame, tree: Tree, features, keep=()) -> DataFrame:
    """Exact values along the tree's paths."""
    return explained(scaled, features, tree_explainer(tree, len(features)), tree.probability, keep)


def local_values(x: np.ndarray, predict) -> tuple[np.ndarray, float]:
    """X6 of some rows for any predictor: each feature alone on the background, rescaled to p - base."""
    width = x.shape[1]
    base = float(predict(np.zeros((1, width)))[0])
    raw = np.zeros(x.shape)
    for i in range(width):
        alone = np.zeros(x.shape)
        alone[:, i] = x[:, i]
        raw[:, i] = predict(alone) - base
    total = raw.sum(1)
    scale = np.where(np.abs(total) > S.RESCALE_EPS, (predict(x) - base) / np.where(total == 0, 1.0, total), 1.0)
    return raw * scale[:, None], base


def kernel_explainer(predict, width: int, samples: int = SAMPLES, seed: int = SEED):
    """X4 as a function of rows: the coalitions and the projector are computed here, once."""
    z, weights = coalitions(width, samples, seed)
    a, c = kernel_projector(z, weights)
    return lambda x: kernel_shapley(x, predict, z, a, c, np.zeros(width))


def tree_explainer(tree: Tree, width: int):
    """X5 as a function of rows."""
    return lambda x: tree_shapley(x, tree, np.zeros(width))


def chain(scaled: DataFrame, explain, predict, features, keep=()) -> DataFrame:
    """The model's own explanation where it shows a contribution above 1e-6 among the
    kept ones and base plus all contributions lies within 0.05 of p; else the
    local one (X6); where that is not finite either, the empty one (X9).

    ``keep, probability, source ('model', 'local', 'empty'), base_value, prediction_value, top_positive, top_negative``."""
    keep = list(keep)

    def outputs(x):
        values, base = explain(x)
        local, local_base = local_values(x, predict)
        return {"probability": np.clip(predict(x), 0, 1), "_cb": base, "_lb": local_base, "_c": values, "_l": local}

    found = _arrays(scaled, features, outputs, keep)
    for k in "cl":
        ordered = S.by_magnitude(_structs(features, f"_{k}"))
        found = found.withColumns({
            f"_{k}p": F.slice(F.filter(ordered, lambda s: s["contribution"] > 0), 1, S.TOP_CONTRIBUTORS),
            f"_{k}n": F.slice(F.filter(ordered, lambda s: s["contribution"] < 0), 1, S.TOP_CONTRIBUTORS),
            f"_{k}v": F.col(f"_{k}b") + F.aggregate(f"_{k}", F.lit(0.0), lambda a, v: a + v)})
    finite = lambda c: ~(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")))
    signal = F.exists(F.concat("_cp", "_cn"), lambda s: F.abs(s["contribution"]) > S.SIGNAL_EPS)
    valid = finite("_cv") & signal & (F.abs(F.col("_cv") - F.col("probability")) <= S.SUM_TOLERANCE)
    found = found.withColumn("source", F.when(valid, "model").when(finite("_lv"), "local").otherwise("empty"))
    empty = F.array().cast(S.CONTRIB_TYPE)
    pick = lambda model, local, none: F.when(F.col("source") == "model", model).when(F.col("source") == "local", local).otherwise(none)
    p = F.col("probability")
    return found.select(*keep, "probability", "source", pick(F.col("_cb"), F.col("_lb"), p).alias("base_value"),
                        pick(F.col("_cv"), p, p).alias("prediction_value"),
                        pick(F.col("_cp"), F.col("_lp"), empty).alias("top_positive"), pick(F.col("_cn"), F.col("_ln"), empty).alias("top_negative"))
