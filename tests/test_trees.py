"""Exact trees and explanations against brute force."""
from itertools import combinations
from math import comb, factorial

import numpy as np
import pytest

from pyspark.sql import functions as F
from tidemark.operators import explain as E
from tidemark.operators import trees as T


def plain_tree(x, y, criterion, max_depth, min_split, node=0, depth=0):
    """Every threshold of every feature, one by one."""
    n, pos = len(y), int(y.sum())
    out = {node: (-1, 0.0, n, pos)}
    if depth >= max_depth or n < min_split or pos in (0, n):
        return out
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in zip(values[:-1], values[1:]):
            left = x[:, f] <= low
            cost = float(T.best_split(np.array(float(left.sum())), np.array(float(y[left].sum())), n, pos, criterion))
            if best is None or cost < best[0]:
                best = (cost, f, low, high, left)
    if best is None:
        return out
    _, f, low, high, left = best
    t = (low + high) / 2
    out[node] = (f, low if t >= high else t, n, pos)
    out.update(plain_tree(x[left], y[left], criterion, max_depth, min_split, 2 * node + 1, depth + 1))
    out.update(plain_tree(x[~left], y[~left], criterion, max_depth, min_split, 2 * node + 2, depth + 1))
    return out


def same(a, b):
    assert (a.feature == b.feature).all() and np.allclose(a.threshold, b.threshold) and (a.n == b.n).all() and (a.pos == b.pos).all()
    assert (a.left == b.left).all() and (a.right == b.right).all()


def sample(seed=1, n=220):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    x[:, 3] = rng.integers(0, 2, n)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(n) < 0.15)).astype(int)
    return x, y


def frame(spark, x, y, tree=0):
    return spark.createDataFrame([(tree, int(t), v.tolist()) for v, t in zip(x, y)], "tree int, y int, x array<double>")


@pytest.mark.parametrize("local_rows", [10 ** 6, 30])
def test_trees_equal_brute_force(spark, local_rows):
    """Two trees at once, grown in one task each or level by level over running sums."""
    x, y = sample()
    x2, y2 = sample(2, 150)
    rows = frame(spark, x, y).unionByName(frame(spark, x2, y2, 1))
    got = T.grow(rows, {0: "gini", 1: "entropy"}, 6, 5, local_rows)
    same(got[0], T.Tree.of(plain_tree(x, y, "gini", 6, 5), "gini"))
    same(got[1], T.Tree.of(plain_tree(x2, y2, "entropy", 6, 5), "entropy"))


@pytest.mark.parametrize("depth,split", [(0, 2), (1, 2), (3, 9), (20, 20), (20, 2)])
def test_truncation_equals_growth_under_limits(depth, split):
    x, y = sample()
    full = T.Tree.of(T.grow_local(x, y, "gini", 25, 2), "gini")
    limited = T.Tree.of(T.grow_local(x, y, "gini", depth, split), "gini")
    cut = full.truncated(depth, split)
    assert np.allclose(cut.probability(x), limited.probability(x)) and np.allclose(cut.importances(4), limited.importances(4))


def test_trees_of_odd_rows(spark):
    schema = "tree int, y int, x array<double>"
    assert T.grow(spark.createDataFrame([], schema), {0: "gini"})[0].value.tolist() == [0.0]
    rows = [(0, 1, [None, 1.0]), (0, 0, [float("nan"), 1.0]), (0, None, [5.0, 5.0]), (0, 1, [0.0, 1.0]), (1, 1, [1.0, 2.0]), (2, 0, [3.0, 1.0]), (2, 1, [1.0, 1.0])]
    got = T.grow(spark.createDataFrame(rows, schema), {0: "gini", 1: "gini", 2: "entropy"})
    assert (got[0].n.tolist(), got[0].pos.tolist()) == ([3], [2])                    # nothing to split on
    assert got[1].value.tolist() == [1.0] and got[2].threshold[0] == 2.0
    flat = got[2].importances(2)
    assert flat.tolist() == [1.0, 0.0]


def exact_values(f, x, background):
    """Shapley values by all coalitions."""
    width, out = len(x), np.zeros(len(x))
    for i in range(width):
        rest = [j for j in range(width) if j != i]
        for k in range(width):
            for c in combinations(rest, k):
                without, with_ = background.copy(), background.copy()
                without[list(c)] = x[list(c)]
                with_[[*c, i]] = x[[*c, i]]
                out[i] += factorial(k) * factorial(width - k - 1) / factorial(width) * (f(with_[None])[0] - f(without[None])[0])
    return out


def test_tree_values_equal_all_coalitions():
    x, y = sample(3)
    tree = T.Tree.of(T.grow_local(x, y, "gini", 6, 2), "gini")
    for background in (np.zeros(4), x[7]):
        got, base = T.tree_shapley(x[:25], tree, background)
        assert base == tree.probability(background[None])[0]
        for row, values in zip(x[:25], got):
            assert np.allclose(values, exact_values(tree.probability, row, background), atol=1e-12)


def test_kernel_values_are_exact_when_all_coalitions_fit():
    rng = np.random.default_rng(4)
    w = rng.normal(size=5)
    predict = lambda x: 1 / (1 + np.exp(-(x @ w) - x[:, 0] * x[:, 1]))
    z, weights = E.coalitions(5, 100)
    assert len(z) == 2 ** 5 - 2 and len({tuple(r) for r in z}) == len(z)
    a, c = E.kernel_projector(z, weights)
    x = rng.normal(size=(20, 5))
    got, base = E.kernel_shapley(x, predict, z, a, c, np.zeros(5))
    for row, values in zip(x, got):
        assert np.allclose(values, exact_values(predict, row, np.zeros(5)), atol=1e-9)


def test_sampled_kernel_values_sum_up_and_come_near():
    rng = np.random.default_rng(5)
    w = rng.normal(size=12) / 3
    predict = lambda x: 1 / (1 + np.exp(-(x @ w)))
    z, weights = E.coalitions(12, 100)
    assert 90 <= len(z) <= 100 and all(0 < r.sum() < 12 for r in z) and np.isclose(weights.sum(), sum(11 / (s * (12 - s)) for s in range(1, 12)))
    again, _ = E.coalitions(12, 100)
    assert (again == z).all()
    a, c = E.kernel_projector(z, weights)
    x = rng.normal(size=(8, 12))
    got, base = E.kernel_shapley(x, predict, z, a, c, np.zeros(12))
    assert np.allclose(got.sum(1), predict(x) - base)
    for row, values in zip(x[:2], got):
        assert np.abs(values - exact_values(predict, row, np.zeros(12))).max() < 0.02
    one = E.kernel_projector(*E.coalitions(1))
    assert np.allclose(E.kernel_shapley(np.array([[2.0]]), lambda v: v[:, 0], E.coalitions(1)[0], *one, np.zeros(1))[0], 2.0)
    assert comb(12, 1) * 2 <= 100


def test_chain_falls_back_in_order(spark):
    df = spark.createDataFrame([(1, 1.0, 0.5), (2, 0.0, 0.0), (3, 2.0, None), (4, -1.0, 1.0)], "id int, a double, b double")
    predict = lambda x: 1 / (1 + np.exp(-(x[:, 0] + x[:, 1])))
    z, weights = E.coalitions(2)
    own = E.kernel_explainer(predict, 2)
    got = {r.id: r for r in E.chain(df, own, predict, ["a", "b"], keep=("id",)).collect()}
    assert [got[i].source for i in (1, 2, 3, 4)] == ["model", "local", "model", "model"]     # row 2: no contribution
    assert got[2].top_positive == [] and got[2].base_value == 0.5 and abs(got[4].probability - 0.5) < 1e-12
    off = E.chain(df, lambda x: (np.full(x.shape, 0.2), 0.9), predict, ["a", "b"], keep=("id",)).where("id = 1").first()
    assert off.source == "local" and abs(off.prediction_value - off.probability) < 1e-12 and {c.feature for c in off.top_positive} == {"a", "b"}
    broken = E.chain(df, lambda x: (np.full(x.shape, np.nan), 0.5), predict, ["a", "b"], keep=("id",)).where("id = 1").first()
    assert broken.source == "local"
    nothing = E.chain(df, lambda x: (np.full(x.shape, np.nan), 0.5), lambda x: np.where(x.any(1), np.nan, 0.5), ["a", "b"], keep=("id",)).where("id = 1").first()
    assert nothing.source == "empty" and nothing.top_positive == [] == nothing.top_negative
    assert E.explain_kernel(df.limit(0), predict, ["a", "b"]).count() == 0
    values = E.explain_kernel(df, predict, ["a", "b"], keep=("id",)).select("id", F.aggregate(
        "contributions", F.lit(0.0), lambda s, c: s + c["contribution"]).alias("s"), (F.col("probability") - F.col("base_value")).alias("d")).collect()
    assert all(abs(r.s - r.d) < 1e-9 for r in values)


def test_a_level_is_one_step_over_all_its_nodes(monkeypatch):
    rng = np.random.default_rng(6)
    x, y = np.concatenate([rng.normal(size=(2000, 2)), rng.integers(0, 2, (2000, 3))], 1), rng.integers(0, 2, 2000)
    calls, plain = [], T.best_split
    monkeypatch.setattr(T, "best_split", lambda *a: calls.append(1) or plain(*a))
    nodes = T.grow_local(x, y, "gini", 12, 2)
    assert len(nodes) > 300 and len(calls) <= 5 * 12                              # not one per node


@pytest.mark.parametrize("bins,sample", [(3, 1000), (40, 1000), (9, 60)])          # coarse, finer, fitted on few of the rows
def test_splits_inside_bins_are_found(spark, monkeypatch, bins, sample):
    """Rows that belong to several trees, values that the bins were not fitted on, ties between features and mirrored splits."""
    monkeypatch.setattr(T, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(T, "TASK_VALUES", 100)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(700, 2)), np.round(rng.normal(size=(700, 1)), 1), rng.integers(0, 2, (700, 2))], 1)
    x = np.concatenate([x, x[:, :1]], 1)                                           # the last column ties with the first
    y = ((x[:, 1] > 0.3) ^ (rng.random(700) < 0.3)).astype(int)
    rows = spark.createDataFrame([([t for t in range(3) if i % 3 != t], int(y[i]), x[i].tolist()) for i in range(700)], "tree array<int>, y int, x array<double>")
    got = T.grow(rows.repartition(5), {0: "gini", 1: "entropy", 2: "gini"}, 7, 2, 50, bins)
    for t, criterion in enumerate(("gini", "entropy", "gini")):
        own = np.arange(700) % 3 != t
        want = T.Tree.of(T.grow_local(x[own], y[own], criterion, 7, 2), criterion)
        for name in ("feature", "threshold", "left", "right", "n", "pos"):
            assert np.array_equal(getattr(got[t], name), getattr(want, name)), name
