"""Support vector machines (M4) and hyperparameter search (M5)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import models as M
from tidemark.operators import search as H
from tidemark.operators import svm as V
from tidemark.plans.catalog import register
from tidemark.plans.model_queries import scaled_split
from tidemark.plans.prep_sql import FEATURES, R, prep_ctes, q


def _svm_metrics(spark, sf_dir, kernel):
    m, z = scaled_split(spark, sf_dir)
    train = z.where(~F.col("is_test"))
    fold = M.stratified_folds(train.select(R.id, "label"), R.id, "label").select(R.id, "fold")
    machine = V.fit(train.join(fold, R.id), m.feature_columns, "fold", kernel=kernel)
    return M.classification_metrics(V.with_svm(z.where("is_test"), machine, m.feature_columns))


@register("m4_linear_svm")
def m4(spark, sf_dir):
    """Test metrics of the default machine; probabilities from out-of-fold margins."""
    return _svm_metrics(spark, sf_dir, V.LINEAR)


@register("m4_rbf_svm")
def m4_rbf(spark, sf_dir):
    """The same with a Gaussian kernel."""
    return _svm_metrics(spark, sf_dir, V.RBF)


def _trials(spark, sf_dir, model_type):
    m, z = scaled_split(spark, sf_dir)
    return H.trial_table(spark, H.hyperparameters(z.where(~F.col("is_test")), model_type, m.feature_columns, R.id))


@register("m5_hyperparameter_search")
def m5(spark, sf_dir):
    """Decision tree: 50 trials over 5 folds, one row per trial."""
    return _trials(spark, sf_dir, "DecisionTree")


@register("m5_search_naive_bayes")
def m5_nb(spark, sf_dir):
    return _trials(spark, sf_dir, "NaiveBayes")


@register("m5_search_knn")
def m5_knn(spark, sf_dir):
    return _trials(spark, sf_dir, "KNN")


@register("m5_search_svm")
def m5_svm(spark, sf_dir):
    """12 trials over 3 folds."""
    return _trials(spark, sf_dir, "SVM")


def _fold_f1_sql() -> str:
    stats = ", ".join([f"avg({q(f)}) AS m{i}" for i, f in enumerate(FEATURES)] + [f"var_pop({q(f)}) AS v{i}" for i, f in enumerate(FEATURES)])
    eps = "1e-9 * greatest(" + ", ".join(f"var_pop({q(f)})" for f in FEATURES) + ")"

    def jll(c):
        return f"ln(c{c}.n / (c0.n + c1.n))" + "".join(
            f" - 0.5 * ln(2 * pi() * (c{c}.v{i} + e.eps)) - power(t.{q(f)} - c{c}.m{i}, 2) / (2 * (c{c}.v{i} + e.eps))" for i, f in enumerate(FEATURES))
    return f"""WITH {prep_ctes()},
_tf AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY
    CAST('0x' || substr(md5(CAST({R.id} AS VARCHAR) || ':42'), 1, 15) AS BIGINT), {R.id}) - 1) % 5 AS fold FROM _z WHERE NOT is_test),
_k(k) AS (VALUES (0), (1), (2), (3), (4)),
_fn AS (SELECT k, label, count(*) AS n, {stats} FROM _tf JOIN _k ON fold <> k GROUP BY ALL),
_fe AS (SELECT k, {eps} AS eps FROM _tf JOIN _k ON fold <> k GROUP BY k),
_fj AS (SELECT t.fold, t.label, {jll(1)} > {jll(0)} AS hit FROM _tf t JOIN _fe e ON e.k = t.fold
        JOIN _fn c0 ON c0.k = t.fold AND c0.label = 0 JOIN _fn c1 ON c1.k = t.fold AND c1.label = 1)
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n_rows, round(CASE WHEN count_if(hit AND label = 1) = 0 THEN 0.0
       ELSE 2.0 * count_if(hit AND label = 1) / (2 * count_if(hit AND label = 1) + count_if(hit AND label = 0) + count_if(NOT hit AND label = 1)) END, 6) AS f1
FROM _fj GROUP BY fold"""


@register("m6_fold_f1", _fold_f1_sql(), ("churn_base",))
def m6_f1(spark, sf_dir):
    """F1 of naive Bayes on each fold of the training rows, trained on the others."""
    m, z = scaled_split(spark, sf_dir)
    rows = H.folded(z.where(~F.col("is_test")), m.feature_columns, R.id, "label", 5)
    found = H.naive_bayes_folds(rows, len(m.feature_columns), 5)({"var_smoothing": M.VAR_SMOOTHING})
    sizes = rows.groupBy("fold").agg(F.count("y").alias("n_rows"))
    f1 = spark.createDataFrame([(f, H.mean_f1({f: c})) for f, c in found.items()], "fold int, f1 double")
    return sizes.join(F.broadcast(f1), "fold").select(F.col("fold").cast("int").alias("fold"), "n_rows", F.round("f1", 6).alias("f1"))
