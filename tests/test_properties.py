"""Hand-computed goldens and properties on small literal frames."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.stats import exact_quantiles, kth_smallest, ordered_prefix, to_long, top_k_per_key
from tidemark.operators import eda, models, quality
from tidemark.roles import Roles


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=500), np.full(300, 2.5)])   # one hot value
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["p"]: r["q"] for r in exact_quantiles(to_long(df, ["x"]), probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-12)


def test_quantiles_single_and_constant(spark):
    df = spark.createDataFrame([(7.0,)], "x double")
    got = exact_quantiles(to_long(df, ["x"]), [0.25, 0.5]).collect()
    assert sorted(r["q"] for r in got) == [7.0, 7.0]


def test_ordered_prefix_positions(spark):
    df = spark.createDataFrame([(i % 3, float(i % 7), i) for i in range(200)], "k int, v double, id int")
    out = ordered_prefix(df, "v", ["id"], key="k", tie="id", ranges=4).collect()
    for k in range(3):
        rows = sorted([r for r in out if r["k"] == k], key=lambda r: (r["v"], r["id"]))
        assert [r["_pos"] for r in rows] == list(range(1, len(rows) + 1))
        assert rows[-1]["cum_id"] == sum(r["id"] for r in rows)


def test_kth_smallest(spark):
    df = spark.createDataFrame([(0, (i * 37) % 101, i) for i in range(101)], "k int, h long, id long")
    ks = spark.createDataFrame([(0, 10)], "k int, _k long")
    r = kth_smallest(df, "k", "h", "id", ks).collect()
    assert r[0]["_ch"] == 9


def test_top_k_per_key_hot_key(spark):
    rows = [(0, i) for i in range(1000)] + [(1, i) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, v int")
    out = top_k_per_key(df, "k", ["v"], 3, salts=8).collect()
    got = sorted((r["k"], r["v"], r["rank"]) for r in out)
    assert got == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3)]


def test_histogram_counts_sum_and_last_bin_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 10]], "x double")
    h = eda.histogram(df, ["x"], 5).orderBy("bin").collect()
    assert sum(r["frequency"] for r in h) == 5
    assert h[-1]["frequency"] == 1 and h[0]["frequency"] == 2
    assert h[-1]["bin_upper"] == 10.0


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    h = eda.histogram(df, ["x"], 5).orderBy("bin").collect()
    assert h[0]["bin_lower"] == 2.5 and h[-1]["bin_upper"] == 3.5
    assert sum(r["frequency"] for r in h) == 2


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    m = {(r["feature_x"], r["feature_y"]): r["correlation"] for r in eda.correlation_matrix(df, ["a", "b"]).collect()}
    assert m[("a", "b")] is None and m[("a", "a")] == pytest.approx(1.0)


def test_mode_tie_goes_to_smallest(spark):
    from tidemark.operators.prep import fit_modes
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert fit_modes(df, ["c"]).collect()[0]["mode"] == "a"


def test_auc_with_ties_is_half(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)], "label int, probability double")
    assert models.roc_auc(df).collect()[0]["roc_auc"] == pytest.approx(0.5)


def test_auc_perfect_and_monotone_invariant(spark):
    rows = [(1, 0.9), (1, 0.8), (0, 0.3), (0, 0.1), (1, 0.35)]
    df = spark.createDataFrame(rows, "label int, probability double")
    a = models.roc_auc(df).collect()[0]["roc_auc"]
    df2 = df.withColumn("probability", F.col("probability") ** 3)
    assert a == pytest.approx(models.roc_auc(df2).collect()[0]["roc_auc"])
    assert 0 <= a <= 1


def test_confusion_matrix_has_four_cells(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "label int, pred int")
    m = models.confusion_matrix(df).collect()
    assert len(m) == 4 and sum(r["count"] for r in m) == 2


def test_metrics_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, pred int")
    r = models.classification_metrics(df).collect()[0]
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_iqr_outliers_empty_column(spark):
    roles = Roles(id="id", binary=(), multi=(), numeric=("x",), flag=(), label="y")
    df = spark.createDataFrame([(1, None, True), (2, None, False)], "id int, x double, y boolean")
    r = quality.iqr_outliers(df, roles).collect()[0]
    assert r["outlier_count"] == 0 and r["outlier_percentage"] == 0.0


def test_shapley_samples_sum_to_p_minus_base(spark):
    """X4 on the fixture model: per row the values add up to p(x) - p(baseline)."""
    from tests.conftest import SF_SMALL
    from tidemark.operators import explain as E
    from tidemark.operators import score as X
    from tidemark.plans.model_queries import naive_bayes, scaled_split
    m, z = scaled_split(spark, SF_SMALL)
    nb = naive_bayes(spark, SF_SMALL)
    test = z.where(F.col("is_test")).limit(20)
    s = E.explain_kernel(test, E.nb_predictor(nb), nb.features, keep=("customer_id",)).select(
        "customer_id", F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["contribution"]).alias("s"))
    e = X.local_contributions(test, nb, keep=("customer_id",)).select("customer_id", "probability", "base_value")
    for r in s.join(e, "customer_id").collect():
        assert r["s"] == pytest.approx(r["probability"] - r["base_value"], abs=1e-9)


def test_local_contributions_sum_and_top_k(spark):
    from tests.conftest import SF_SMALL
    from tidemark.operators import score as X
    from tidemark.plans.model_queries import naive_bayes, scaled_split
    m, z = scaled_split(spark, SF_SMALL)
    nb = naive_bayes(spark, SF_SMALL)
    e = X.local_contributions(z.limit(30), nb, keep=("customer_id",))
    for r in e.collect():
        tot = sum(c["contribution"] for c in r["contributions"])
        raw_nonzero = any(abs(c["contribution"]) > 1e-12 for c in r["contributions"])
        if raw_nonzero:
            assert tot == pytest.approx(r["probability"] - r["base_value"], abs=1e-9)
    t = X.top_contributors(e, keep=("customer_id",)).collect()
    for r in t:
        assert len(r["top_positive"]) <= 5 and all(c["contribution"] > 0 for c in r["top_positive"])
        assert all(c["contribution"] < 0 for c in r["top_negative"])


def test_split_quota_and_scaler(spark):
    from tests.conftest import SF_SMALL
    from tidemark.plans.prep_queries import fitted
    m, enc = fitted(spark, SF_SMALL)
    rows = enc.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect()
    for r in rows:
        assert r["t"] == int(r["n"] * 0.2 + 0.5)
    from tidemark.operators import prep
    z = prep.transform(enc.where(~F.col("is_test")), m)
    st = z.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(m.feature_columns)]).first()
    assert all(abs(st[f"m{i}"]) < 1e-9 for i in range(len(m.feature_columns)))


@pytest.mark.parametrize("accuracy", [40, 200, 20_000])
def test_exact_quantiles_by_narrow_brackets(spark, accuracy):
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.normal(size=2000), np.full(900, 0.25), rng.exponential(50, 1100), [1e12, -1e12]])
    df = spark.createDataFrame([(float(v), float(i % 13)) for i, v in enumerate(vals)], "x double, y double")
    probs = [0.0, 0.01, 0.33, 0.5, 0.75, 0.99, 1.0]
    got = {(r["column"], r["p"]): r["q"] for r in exact_quantiles(to_long(df, ["x", "y"]), probs, accuracy=accuracy).collect()}
    for p in probs:
        assert got[("x", p)] == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-9)
        assert got[("y", p)] == pytest.approx(float(np.percentile(np.arange(len(vals)) % 13.0, p * 100)), abs=1e-9)


def test_ordered_prefix_keeps_null_keys_and_a_key_over_all_ranges(spark):
    rows = [(None, i, i % 5) for i in range(40)] + [("b", i, None) for i in range(3)] + [("a", i, 1) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v int, w int")
    out = ordered_prefix(df, "v", ["w"], key="k", ranges=7).collect()
    assert sorted((r.k or "", r._pos) for r in out) == sorted([("", i + 1) for i in range(40)] + [("b", i + 1) for i in range(3)]
                                                              + [("a", i + 1) for i in range(300)])
    assert {r.v: r.cum_w for r in out if r.k is None} == {i: sum(j % 5 for j in range(i + 1)) for i in range(40)}
    two = ordered_prefix(df, "v", [], key=["k", "w"], ranges=5).where("k IS NULL AND w = 2").collect()
    assert sorted((r.v, r._pos) for r in two) == [(2 + 5 * i, i + 1) for i in range(8)]
    assert ordered_prefix(df.limit(0), "v", ["w"], key="k").count() == 0


@pytest.mark.parametrize("k", [1, 7, 250, 999, 1000])
def test_kth_smallest_with_ties_and_null_key(spark, k):
    rows = [(None, (i * 7919) % 91, i) for i in range(1000)] + [("x", i, i) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, h long, id long")
    ks = spark.createDataFrame([(None, k), ("x", 0)], "k string, _k long")
    got = kth_smallest(df, "k", "h", "id", ks).collect()
    assert [(r["k"], r._ch, r._cid) for r in got] == [(None, *sorted((h, i) for c, h, i in rows if c is None)[k - 1])]


def test_keyset_pages_walk_the_whole_table(spark):
    df = spark.createDataFrame([(i, i * 2) for i in range(1, 26)], "id int, v int")
    seen, cursor = [], 0
    while cursor is not None:
        page = eda.paginate_keyset(df, "id", cursor, 10).collect()
        seen += [r["id"] for r in page]
        cursor = page[-1]["next_cursor"] if page else None
    assert seen == list(range(1, 26))


def test_oracle_rounds_are_sign_normalised():
    from tidemark.plans.catalog import positive_zero_rounds
    out = positive_zero_rounds("SELECT round(x, 6) AS a, 'round(' AS b, ground(y) FROM t")
    assert out == "SELECT (round(x, 6) + 0.0) AS a, 'round(' AS b, ground(y) FROM t"
    import duckdb
    assert str(duckdb.sql(positive_zero_rounds("SELECT round(-1e-9, 6) AS z")).fetchall()[0][0]) == "0.0"


def test_bad_cells_are_flagged_not_fatal(spark):
    from tidemark.operators import validate as V
    rows = [(2, "9" * 25, "nan", "1"), (3, "12345678901", "inf", "x"), (4, "12", "1_0.5", "0"), (5, " ", " ", "")]
    raw = spark.createDataFrame(rows, "row_no long, tenure string, TotalCharges string, SeniorCitizen string")
    got = V.validation_errors(raw, {}, id_col=None).collect() if hasattr(V, "validation_errors") else None
    if got is not None:
        assert {r.row_no for r in got if r["column"] == "tenure"} == {2, 3}
    typed = {r.row_no: r for r in V.typed_projection(raw).collect()}
    assert [typed[i].tenure for i in (2, 3, 4, 5)] == [None, None, 12, None]
    assert typed[2].total_charges is None and typed[4].total_charges == 10.5
    missing = {(r.row_no, r["column"]) for r in V.missing_cells(raw, ["tenure", "SeniorCitizen"]).collect()}
    assert missing == {(5, "SeniorCitizen")}


def test_neighbour_information_equals_a_direct_count(spark):
    import math
    import random
    from tidemark.operators import features as FE
    rng = random.Random(4)
    rows = [(i, None if i == 7 else i % 3 == 0, float(rng.randrange(40)) if i % 3 else float(rng.randrange(20, 60)), rng.choice(["a", "b", None]))
            for i in range(90)] + [(90, None, 1.0, "a")]
    df = spark.createDataFrame(rows, "id long, y boolean, x double, c string")
    got = {r.feature: r.mutual_information for r in FE.neighbour_information(df, "y", "id", ["c"], ["x"]).collect()}

    def psi(n):
        return -0.5772156649015329 + sum(1 / j for j in range(1, n))

    for feature in ("x", "c"):
        pts = [(r.y, r.v) for r in FE.scaled_values(df, "y", "id", ["c"], ["x"]).where(f"feature = '{feature}'").collect()]
        k_all, n_y, m_all = [], [], []
        for i, (y, v) in enumerate(pts):
            same = sorted(abs(v - w) for j, (z, w) in enumerate(pts) if z == y and j != i)
            r = same[min(3, len(same)) - 1]
            k_all.append(min(3, len(same)))
            n_y.append(len(same) + 1)
            m_all.append(sum(abs(v - w) < max(r, 1) for _, w in pts))
        mean = lambda xs: sum(map(psi, xs)) / len(xs)
        assert math.isclose(got[feature], max(0.0, psi(len(pts)) + mean(k_all) - mean(n_y) - mean(m_all)), abs_tol=1e-6)
