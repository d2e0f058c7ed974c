"""Nearest neighbours and synthesised rows against brute force; odd rows."""
import numpy as np
import pytest

from pyspark.sql import functions as F
from tidemark.operators import neighbours as N


def frames(spark, q, x, label):
    data = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, label))], "id long, x array<double>, payload double")
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, x array<double>"), data


@pytest.mark.parametrize("metric,k,options", [
    ("euclidean", 5, {"part_rows": 20, "cell_rows": 15, "cell_queries": 30}),      # rounds, several blocks and query groups
    ("manhattan", 7, {"part_rows": 60}),
    ("euclidean", 200, {"part_rows": 40}),                                          # more than most partitions hold
])
def test_neighbours_match_brute_force(spark, metric, k, options):
    rng = np.random.default_rng(7)
    x, q = np.round(rng.normal(size=(400, 3)), 1), np.round(rng.normal(size=(50, 3)), 1)
    x[:130] = x[0]                                                                  # a third of the rows are one vector
    q[0] = x[0]
    label = rng.integers(0, 2, 400)
    got = {r.qid: r for r in N.nearest(*frames(spark, q, x, label), k, metric, **options).collect()}
    assert len(got) == 50
    for i, v in enumerate(q):
        d = np.round(N.pair_distances(np.repeat(v[None], 400, 0), x, metric), N.DIGITS)
        want = np.lexsort((np.arange(400), d))[:k]
        assert [(b.id, b.d, b.payload) for b in got[i].best] == [(j, d[j], label[j]) for j in want.tolist()]


def test_clusters_are_pruned(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(20, 4)) * 100, 60, axis=0) + rng.normal(size=(1200, 4))
    found = N.nearest(*frames(spark, x[::40], x, np.zeros(1200)), 5, part_rows=60)
    assert found.agg(F.avg("compared")).first()[0] < 300


def test_neighbours_of_odd_rows(spark):
    data = spark.createDataFrame([(1, [0.0, 0.0], 1.0), (2, None, 1.0), (3, [None, 1.0], 0.0), (4, [float("nan"), 1.0], 0.0), (5, [3.0, 4.0], None)],
                                 "id long, x array<double>, payload double")
    asked = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [float("inf"), 0.0])], "qid long, x array<double>")
    got = {r.qid: [(b.id, b.d, b.payload) for b in r.best] for r in N.nearest(asked, data, 5).collect()}
    assert got == {1: [(1, 0.0, 1.0), (5, 5.0, None)], 2: [], 3: []}
    assert [len(r.best) for r in N.nearest(asked, data.limit(0), 5).collect()] == [0, 0, 0]
    assert N.nearest(asked.limit(0), data, 5).count() == 0


def test_votes(spark):
    best = "array<struct<d:double,id:long,payload:double>>"
    rows = [(1, [(0.0, 1, 1.0), (0.0, 2, 0.0), (1.0, 3, 0.0)]), (2, [(1.0, 1, 1.0), (2.0, 2, 0.0)]), (3, [])]
    df = spark.createDataFrame(rows, f"qid long, best {best}")
    assert [(r.probability and round(r.probability, 6), r.pred) for r in N.vote(df).orderBy("qid").collect()] == [(0.333333, 0), (0.5, 0), (None, None)]
    assert [(r.probability and round(r.probability, 6), r.pred) for r in N.vote(df, "distance").orderBy("qid").collect()] == [
        (0.5, 0), (0.666667, 1), (None, None)]


def test_new_rows_reach_parity_and_lie_between_neighbours(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(60, 2)), 3)
    rows = [(i, int(i < 13), *v) for i, v in enumerate(x.tolist())]
    train = spark.createDataFrame(rows, "id long, label int, `a b` double, b double")
    new = N.smote(train, ["a b", "b"], "id").collect()
    assert len(new) == 47 - 13 and {r.label for r in new} == {1}
    per = {i: sum(r.id == i for r in new) for i in range(13)}
    assert set(per.values()) == {34 // 13, 34 // 13 + 1}
    for r in new:
        a, b = x[r.id], x[r.neighbour]
        near = sorted((round(float(np.linalg.norm(a - x[j])), 9), j) for j in range(13) if j != r.id)[:5]
        assert r.neighbour in [j for _, j in near] and 0 <= r.weight < 1
        assert np.allclose([r["a b"], r.b], a + r.weight * (b - a))
    counts = {r.label: r["count"] for r in N.balanced(train, ["a b", "b"], "id").groupBy("label").count().collect()}
    assert counts == {0: 47, 1: 47}
    one = N.smote(train.where("id = 0 OR id > 55"), ["a b", "b"], "id").collect()      # a class of one row is copied
    assert len(one) == 3 and all(r.neighbour is None and [r["a b"], r.b] == x[0].tolist() for r in one)
    assert N.smote(train.where("label = 0"), ["a b", "b"], "id").count() == 0
    assert N.smote(train.limit(0), ["a b", "b"], "id").count() == 0


@pytest.mark.parametrize("metric", [N.EUCLIDEAN, N.MANHATTAN])
def test_memory_per_batch_does_not_grow_with_the_pivots(metric):
    import tracemalloc
    rng = np.random.default_rng(5)
    x, count = rng.normal(size=(6_000, 3)), 6_000
    pivots = N.Pivots(rng.normal(size=(count, 3)), metric, np.zeros(count), np.ones(count), np.ones(count, np.int64))
    tracemalloc.start()
    part, far = pivots.home(x)
    pivots.order(x[:pivots.at_once])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * 8 * N.CHUNK                                               # 6,000 x 6,000 doubles are 288 MB each
    assert peak < 250e6 and np.array_equal(part[:9], N.distances(x[:9], pivots.centres, metric).argmin(1)) and (far >= 0).all()


def test_folds_meet_only_the_rows_of_others(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(240, 2)), 1)
    x[:60] = x[0]                                                                # copies in every fold
    fold = np.arange(240) % 3
    rows = spark.createDataFrame([(i, int(fold[i]), float(i % 2), x[i].tolist()) for i in range(240)], "id long, fold long, payload double, x array<double>")
    found = N.nearest(rows.withColumnRenamed("id", "qid"), rows, 7, N.MANHATTAN, part_rows=30, fold="fold")
    got = {r.qid: [b.id for b in r.best] for r in found.collect()}
    for i in range(240):
        other = np.flatnonzero(fold != fold[i])
        d = np.round(np.abs(x[other] - x[i]).sum(1), 9)
        assert got[i] == other[np.lexsort((other, d))[:7]].tolist()


def test_an_id_in_two_folds_is_asked_in_each(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, [0.0]), (1, 1, 1.0, [5.0]), (2, 0, 0.0, [1.0]), (3, 1, 1.0, [4.0])],
                                 "id long, fold long, payload double, x array<double>")
    found = N.nearest(rows.withColumnRenamed("id", "qid"), rows, 1, fold="fold").collect()
    assert sorted((r.qid, r.fold, r.x[0], [b.id for b in r.best]) for r in found) == [
        (1, 0, 0.0, [3]), (1, 1, 5.0, [2]), (2, 0, 1.0, [3]), (3, 1, 4.0, [2])]


@pytest.mark.parametrize("metric,most", [(N.EUCLIDEAN, 2_000), (N.MANHATTAN, 2_500)])
def test_columns_of_few_values_leave_few_vectors(spark, metric, most):
    """Like the fixture: flags, one-hot columns and two measures. Pivots alone met nearly all 12,000 vectors here."""
    rng = np.random.default_rng(8)
    n = 12_000
    x = np.concatenate([rng.integers(0, 2, (n, 5)) * 2.0, np.eye(5)[rng.integers(0, 5, n)] * 2.5, rng.normal(size=(n, 2))], 1)
    q = x[:40] + np.concatenate([np.zeros((40, 10)), 0.01 * rng.normal(size=(40, 2))], 1)
    got = {r.qid: r for r in N.nearest(*frames(spark, q, x, np.zeros(n)), 11, metric, part_rows=2_000).collect()}
    for i, v in enumerate(q):
        d = np.round(N.pair_distances(np.repeat(v[None], n, 0), x, metric), N.DIGITS)
        assert [b.id for b in got[i].best] == np.lexsort((np.arange(n), d))[:11].tolist()
    assert np.mean([r.compared for r in got.values()]) < most


def test_carried_distances_and_many_ties():
    """Leaves against brute force with ties at the kth distance, several rows a vector, and a bound carried from other blocks."""
    rng = np.random.default_rng(9)
    x = np.unique(rng.integers(0, 7, (900, 3)).astype(float), axis=0)
    size = rng.integers(0, 3, len(x))
    ids = rng.permutation(int(size.sum())).astype(np.int64)
    vector = np.repeat(np.arange(len(x)), size)
    ids = ids[np.lexsort((ids, vector))]
    q = rng.integers(0, 7, (60, 3)) + 0.25
    for metric in (N.EUCLIDEAN, N.MANHATTAN):
        d = np.round(np.stack([N.pair_distances(np.repeat(v[None], len(vector), 0), x[vector], metric) for v in q]), N.DIGITS)
        for kth in (np.full(60, np.inf), np.sort(d, 1)[:, 3]):
            found, met = N.Leaves(x, metric).nearest(q, kth, size, ids, np.zeros(len(ids)), 9)
            a, far, near = (np.concatenate(c) for c in zip(*[(f[0], f[1], f[2]) for f in found]))
            for i in range(60):
                order = np.lexsort((ids, d[i]))[:9]
                order = order[d[i][order] <= kth[i]]
                own = a == i
                assert near[own][:len(order)].tolist() == ids[order].tolist() and far[own][:len(order)].tolist() == d[i][order].tolist()
            assert (met <= len(x)).all()
