"""Support vector machines and hyperparameter search."""
import numpy as np
import pytest

from pyspark.sql import functions as F
from tidemark.functions.sums import array_sums
from tidemark.operators import search as H
from tidemark.operators import svm as V


def frame(spark, x, y, folds=3):
    rows = [(i, int(t), i % folds, *v) for i, (v, t) in enumerate(zip(x.tolist(), y))]
    return spark.createDataFrame(rows, "id int, label int, fold int, " + ", ".join(f"f{i} double" for i in range(x.shape[1]))).repartition(4)


def rings(n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    return x, ((x ** 2).sum(1) > 1.4).astype(int)


def test_array_sums_over_partitions(spark):
    df = spark.range(1000).repartition(7)

    def add(batches):
        out = np.zeros((70, 3))
        for b in batches:
            for v in b.column(0).to_numpy():
                out[v % 70] += [1, v, v * v]
        return {"m": out, "v:1": out[:, 0]}
    got = array_sums(df, add)
    v = np.arange(1000)
    want = np.stack([[(v % 70 == k).sum(), v[v % 70 == k].sum(), (v[v % 70 == k] ** 2).sum()] for k in range(70)])
    assert np.allclose(got["m"], want) and np.allclose(got["v:1"], want[:, 0])
    assert np.allclose(array_sums(df.limit(0), add).get("m", 0), 0)


def test_kernel_values_within_stated_error():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 5))
    z = V.FourierMap.draw(5, 0.2, 4096)(x)
    want = np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - want).max() < 5 / np.sqrt(4096)


@pytest.mark.parametrize("kernel,least", [("linear", 0.0), ("rbf", 0.95)])
def test_machine_minimises_its_loss_and_rbf_learns_rings(spark, kernel, least):
    x, y = rings()
    df = frame(spark, x, y)
    rows = df.select(F.col("label").alias("y"), "fold", F.array("f0", "f1").alias("x"))
    fourier = V.FourierMap.draw(2, V.gamma_of(rows, 2, "scale"), 64) if kernel == "rbf" else None
    machines = V.fit_machines(rows, 2, [None, 0, 1, 2], 1.0, fourier)
    for k, m in machines.items():
        own = np.ones(len(x), bool) if k is None else np.arange(len(x)) % 3 != k
        z, s = (x if fourier is None else fourier(x))[own], 2.0 * y[own] - 1

        def loss(w, b):
            gap = 1 - s * (z @ w + b)
            return np.where(gap >= V.ROUND, gap, np.where(gap > -V.ROUND, (gap + V.ROUND) ** 2 / (4 * V.ROUND), 0)).sum() + 0.5 * w @ w
        best, rng = loss(m.weights, m.bias), np.random.default_rng(0)
        for _ in range(200):
            assert best <= loss(m.weights + 0.01 * rng.normal(size=len(m.weights)), m.bias + 0.01 * rng.normal()) + 2e-3 * best
    assert (machines[None].decision(x) == y).mean() >= least


def test_probabilities_come_from_unseen_margins(spark):
    x, y = rings(240)
    y = np.where(np.random.default_rng(3).random(240) < 0.2, 1 - y, y)
    machine = V.fit(frame(spark, x, y), ["f0", "f1"], "fold", kernel="rbf", folds=3, width=64)
    p = machine.probability(x)
    seen = machine.margin(x)
    assert 0 < machine.slope < V.platt(seen, np.ones(240), y.astype(float))[0]       # margins of rows it was fitted on promise too much
    assert abs(p.mean() - y.mean()) < 0.1
    got = V.with_svm(frame(spark, x, y), machine, ["f0", "f1"]).orderBy("id").collect()
    assert np.allclose([r.probability for r in got], p) and [r.pred for r in got] == machine.decision(x).tolist()


def test_machines_of_odd_rows(spark):
    schema = "id int, label int, fold int, f0 double"
    empty = V.fit(spark.createDataFrame([], schema), ["f0"], "fold", folds=2)
    assert empty.margin(np.ones((3, 1))).tolist() == [0.0] * 3
    one = V.fit(spark.createDataFrame([(1, 1, 0, 2.0), (2, 1, 1, None), (3, None, 0, 1.0)], schema), ["f0"], "fold", folds=2)
    assert one.decision(np.zeros((2, 1))).tolist() == [1, 1]
    with pytest.raises(ValueError):
        V.fit(spark.createDataFrame([], schema), ["f0"], "fold", kernel="poly")


def test_platt_recovers_a_logistic_curve():
    m = np.linspace(-3, 3, 400)
    n = np.full(400, 1000.0)
    slope, offset = V.platt(m, n, n / (1 + np.exp(-(1.7 * m - 0.4))))
    assert abs(slope - 1.7) < 0.01 and abs(offset + 0.4) < 0.01


def test_proposals_find_the_top_and_repeat():
    space = {"a": ("int", 1, 50), "b": ("log", 1e-3, 1e3), "c": ("choice", "x", "y", "z")}

    def value(s):
        return -abs(s["a"] - 37) / 50 - abs(np.log10(s["b"]) - 1) + (s["c"] == "y")
    history = H.search(space, value, 60)
    assert history == H.search(space, value, 60) and history != H.search(space, value, 60, seed=1)
    early, late = max(v for _, v in history[:H.STARTUP]), max(v for _, v in history)
    assert late > early and late > 0.6
    assert all(1 <= s["a"] <= 50 and 1e-3 <= s["b"] <= 1e3 for s, _ in history)
    assert H._value(("int", 1, 3), 0.999999) == 3 and H._value(("int", 1, 3), 0.0) == 1


def test_fold_models_match_plain_training(spark):
    """Naive Bayes from sums per fold, truncated trees and neighbour lists against models trained fold by fold."""
    from tidemark.operators import trees
    x, y = rings(200)
    x = np.round(x, 2)
    rows = H.folded(frame(spark, x, y).drop("fold"), ["f0", "f1"], "id", "label", 4)
    fold = np.zeros(200, int)
    for r in rows.collect():
        fold[r.id] = r.fold
    assert np.bincount(fold).max() - np.bincount(fold).min() <= 2

    def f1(predict):
        out = []
        for f in range(4):
            p, t = predict(x[fold != f], y[fold != f], x[fold == f]), y[fold == f]
            tp = (p & t).sum()
            out.append(2 * tp / (2 * tp + (p & (1 - t)).sum() + ((1 - p) & t).sum()) if tp else 0.0)
        return np.mean(out)

    def bayes(a, b, c):
        eps = 1e-8 * a.var(0).max()
        j = [np.log((b == k).mean()) - 0.5 * (np.log(2 * np.pi * (a[b == k].var(0) + eps)) + (c - a[b == k].mean(0)) ** 2 / (a[b == k].var(0) + eps)).sum(1) for k in (0, 1)]
        return (j[1] > j[0]).astype(int)

    def neighbours(a, b, c):
        d = np.round(np.abs(c[:, None] - a[None]).sum(2), 9)
        ids = np.flatnonzero(np.ones(len(a)))
        near = np.stack([np.lexsort((ids, v))[:7] for v in d])
        return (b[near].mean(1) > 0.5).astype(int)
    assert abs(H.naive_bayes_evaluator(rows, 2, 4)({"var_smoothing": 1e-8}) - f1(bayes)) < 1e-9
    tree = lambda a, b, c: (trees.Tree.of(trees.grow_local(a, b, "entropy", 4, 6), "entropy").probability(c) > 0.5).astype(int)
    assert abs(H.tree_evaluator(rows, 4)({"criterion": "entropy", "max_depth": 4, "min_samples_split": 6}) - f1(tree)) < 1e-9
    knn = H.knn_evaluator(rows, 4, 12, part_rows=20)
    assert abs(knn({"metric": "manhattan", "n_neighbors": 7, "weights": "uniform"}) - f1(neighbours)) < 1e-9


def test_search_of_a_model_type(spark):
    x, y = rings(150)
    history = H.hyperparameters(frame(spark, x, y).drop("fold"), "SVM", ["f0", "f1"], "id", trials=4, folds=2)
    best = H.trial_table(spark, history).where("best").collect()
    assert len(history) == 4 and len(best) == 1 and best[0].mean_f1 == max(v for _, v in history)
    with pytest.raises(ValueError):
        H.hyperparameters(frame(spark, x, y), "Forest", ["f0", "f1"], "id")


def test_tree_trials_read_the_rows_once(spark, monkeypatch):
    """Every setting's F1 equals that of the truncated trees run over the rows, without a pass a trial."""
    x, y = rings(240, 4)
    rows = H.folded(frame(spark, np.round(x, 1), y).drop("fold"), ["f0", "f1"], "id", "label", 3)
    evaluate = H.tree_evaluator(rows, 3, 8, local_rows=60)
    passes = []
    monkeypatch.setattr(H, "fold_counts", lambda *a: passes.append(a))
    settings = [{"criterion": c, "max_depth": d, "min_samples_split": m} for c in ("gini", "entropy") for d in (1, 3, 8) for m in (2, 15)]
    got = [evaluate(s) for s in settings]
    assert not passes
    data = [(r.y, r.fold, list(r.x)) for r in rows.collect()]
    a, b, fold = np.array([r[2] for r in data]), np.array([r[0] for r in data]), np.array([r[1] for r in data])
    from tidemark.operators import trees
    for s, value in zip(settings, got):
        counts = {}
        for f in range(3):
            own = fold == f
            tree = trees.Tree.of(trees.grow_local(a[~own], b[~own], s["criterion"], s["max_depth"], s["min_samples_split"]), s["criterion"])
            p, t = tree.probability(a[own]) > 0.5, b[own] == 1
            counts[f] = ((p & t).sum(), (p & ~t).sum(), (~p & t).sum())
        assert abs(value - H.mean_f1(counts)) < 1e-12


def test_neighbour_votes_of_all_settings_in_one_pass(spark, monkeypatch):
    """Counts of every k and kind of weights equal those of the vote over the sliced lists; trials read no rows."""
    from tidemark.operators import neighbours as N
    x, y = rings(120, 5)
    x = np.round(x, 1)
    x[:20] = x[0]
    df = frame(spark, x, y, 3)
    rows = df.select(F.col("id").cast("long").alias("id"), F.col("label").alias("y"), F.col("fold").cast("long").alias("fold"), F.array("f0", "f1").alias("x"))
    evaluate = H.knn_evaluator(rows, 3, 12)
    found = N.nearest(rows.withColumnRenamed("id", "qid"), rows.select("id", "x", "fold", F.col("y").cast("double").alias("payload")), 12, N.MANHATTAN,
                      fold="fold").join(rows.select(F.col("id").alias("qid"), "y"), "qid").localCheckpoint()
    wanted = {}
    for weights in ("uniform", "distance"):
        for n in (1, 2, 5, 12):
            got = N.vote(found.withColumn("best", F.slice("best", 1, n)), weights).collect()
            counts = {f: [sum(r.fold == f and (r.pred, r.y) == c for r in got) for c in ((1, 1), (1, 0), (0, 1))] for f in range(3)}
            wanted[weights, n] = H.mean_f1(counts)
    evaluate({"metric": N.MANHATTAN, "weights": "uniform", "n_neighbors": 3})
    monkeypatch.setattr(N, "nearest", None)
    monkeypatch.setattr(type(rows), "collect", None)
    got = {(w, n): evaluate({"metric": N.MANHATTAN, "weights": w, "n_neighbors": n}) for w, n in wanted}
    assert got == wanted and len(set(wanted.values())) > 4


def test_votes_of_short_and_empty_lists():
    got = H.votes(np.array([0.0, 2.0, 1.0, 3.0]), np.array([1.0, 0.0, 0.0, 1.0]), np.array([2, 0, 2]), 3)
    assert got["uniform"].tolist() == [[True, False, False], [False] * 3, [False] * 3]
    assert got["distance"].tolist() == [[True] * 3, [False] * 3, [False] * 3]
