"""Naive Bayes training and evaluation queries, all with oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.stats import r
from tidemark.operators import models as M
from tidemark.operators import prep
from tidemark.plans.catalog import register
from tidemark.plans.prep_queries import fitted
from tidemark.plans.prep_sql import FEATURES, R, prep_ctes, q

_NB: dict = {}


def scaled_split(spark, sf_dir):
    m, enc = fitted(spark, sf_dir)
    return m, prep.transform(enc, m, keep=(R.id, "label", "is_test"))


def naive_bayes(spark, sf_dir):
    key = (id(spark), sf_dir)
    if key not in _NB:
        m, z = scaled_split(spark, sf_dir)
        _NB[key] = M.fit_naive_bayes(z.where(~F.col("is_test")), m.feature_columns)
    return _NB[key]


def test_predictions(spark, sf_dir):
    m, z = scaled_split(spark, sf_dir)
    nb = naive_bayes(spark, sf_dir)
    return z.where(F.col("is_test")).select(R.id, "label", nb.probability().alias("probability"),
                                            nb.decision().alias("pred"))


def _nb_ctes() -> str:
    fs = FEATURES
    stats = ", ".join([f"avg({q(f)}) AS m{i}" for i, f in enumerate(fs)]
                      + [f"var_pop({q(f)}) AS v{i}" for i, f in enumerate(fs)])
    eps = "1e-9 * greatest(" + ", ".join(f"var_pop({q(f)})" for f in fs) + ")"

    def jll(c):
        terms = [f"ln(c{c}.n / (c0.n + c1.n))"]
        for i, f in enumerate(fs):
            v = f"(c{c}.v{i} + e.eps)"
            terms.append(f"- 0.5 * ln(2 * pi() * {v}) - power(t.{q(f)} - c{c}.m{i}, 2) / (2 * {v})")
        return " ".join(terms)
    return f"""{prep_ctes()},
_nbs AS (SELECT label, count(*) AS n, {stats} FROM _z WHERE NOT is_test GROUP BY label),
_eps AS (SELECT {eps} AS eps FROM _z WHERE NOT is_test),
_jll AS MATERIALIZED (SELECT t.{R.id}, t.label, {jll(0)} AS j0, {jll(1)} AS j1
         FROM _z t, (SELECT * FROM _nbs WHERE label = 0) c0, (SELECT * FROM _nbs WHERE label = 1) c1, _eps e
         WHERE t.is_test),
_pred AS MATERIALIZED (SELECT {R.id}, label,
            CASE WHEN j0 - j1 > 0 THEN exp(-(j0 - j1)) / (1 + exp(-(j0 - j1))) ELSE 1 / (1 + exp(j0 - j1)) END AS probability,
            CASE WHEN j1 > j0 THEN 1 ELSE 0 END AS pred FROM _jll)"""


NB_CTES = _nb_ctes()


@register("m2_naive_bayes_params", f"""WITH {NB_CTES}
""" + " UNION ALL ".join(
    f"SELECT label AS class, '{f}' AS feature, round(m{i}, 6) AS mean, round(v{i} + (SELECT eps FROM _eps), 6) AS variance, "
    f"round(n / (SELECT sum(n) FROM _nbs), 6) AS prior FROM _nbs" for i, f in enumerate(FEATURES)), ("churn_base",))
def m2(spark, sf_dir):
    nb = naive_bayes(spark, sf_dir)
    rows = [(c, f, nb.means[(c, f)], nb.vars[(c, f)], nb.priors[c]) for c in nb.classes for f in nb.features]
    # parameters are tiny; shown as a table
    df = spark.createDataFrame(rows, "class int, feature string, mean double, variance double, prior double")
    return df.select("class", "feature", r("mean").alias("mean"), r("variance").alias("variance"),
                     r("prior").alias("prior"))


@register("m2_test_predictions", f"""WITH {NB_CTES}
SELECT {R.id}, label, round(probability, 6) AS probability, pred FROM _pred""", ("churn_base",))
def m2p(spark, sf_dir):
    p = test_predictions(spark, sf_dir)
    return p.select(R.id, "label", r("probability").alias("probability"), "pred")


_METRICS = """SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
  round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0 END, 6) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1
FROM (SELECT count_if(label = 1 AND pred = 1) AS tp, count_if(label = 0 AND pred = 1) AS fp,
             count_if(label = 1 AND pred = 0) AS fn, count_if(label = 0 AND pred = 0) AS tn FROM _pred)"""


@register("m7_classification_metrics", f"WITH {NB_CTES}\n{_METRICS}", ("churn_base",))
def m7(spark, sf_dir):
    c = M.classification_metrics(test_predictions(spark, sf_dir))
    return c.select(*[F.col(x).cast("long").alias(x) for x in ("tp", "fp", "fn", "tn")],
                    *[r(x).alias(x) for x in ("accuracy", "precision", "recall", "f1")])


@register("m8_m18_confusion_matrix", f"""WITH {NB_CTES},
_cells AS (SELECT a.actual, p.predicted FROM (VALUES (0), (1)) a(actual), (VALUES (0), (1)) p(predicted)),
_cnt AS (SELECT label AS actual, pred AS predicted, count(*) AS count FROM _pred GROUP BY ALL)
SELECT CAST(actual AS INTEGER) AS actual, CAST(predicted AS INTEGER) AS predicted,
       CASE actual WHEN 0 THEN 'No Churn' ELSE 'Churn' END AS actual_name,
       CASE predicted WHEN 0 THEN 'No Churn' ELSE 'Churn' END AS predicted_name,
       coalesce(count, 0) AS count, round(coalesce(count, 0) * 100.0 / (SELECT count(*) FROM _pred), 6) AS share_percent
FROM _cells LEFT JOIN _cnt USING (actual, predicted)""", ("churn_base",))
def m8(spark, sf_dir):
    c = M.confusion_matrix(test_predictions(spark, sf_dir))
    return c.withColumn("share_percent", r("share_percent"))


@register("m9_roc_auc", f"""WITH {NB_CTES},
_scs AS (SELECT probability AS score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM _pred GROUP BY 1),
_c AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM _scs)
SELECT round(sum(pos * (cum_neg - neg + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS roc_auc,
       CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM _c""", ("churn_base",))
def m9(spark, sf_dir):
    a = M.roc_auc(test_predictions(spark, sf_dir))
    return a.select(r("roc_auc").alias("roc_auc"), "positives", "negatives")


@register("m10_roc_curve", f"""WITH {NB_CTES},
_scs AS (SELECT probability AS score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM _pred GROUP BY 1),
_c AS (SELECT row_number() OVER (ORDER BY score DESC) AS i, score,
              sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps,
              sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps FROM _scs),
_k AS (SELECT *, lag(tps) OVER (ORDER BY i) AS tp_p, lead(tps) OVER (ORDER BY i) AS tp_n,
              lag(fps) OVER (ORDER BY i) AS fp_p, lead(fps) OVER (ORDER BY i) AS fp_n FROM _c)
SELECT CAST(0 AS BIGINT) AS i, 'inf'::DOUBLE AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT i, round(score, 6), round(fps / (SELECT sum(neg) FROM _scs), 6), round(tps / (SELECT sum(pos) FROM _scs), 6) FROM _k
WHERE i = 1 OR i = (SELECT max(i) FROM _k) OR fp_n - 2 * fps + fp_p <> 0 OR tp_n - 2 * tps + tp_p <> 0""",
          ("churn_base",))
def m10(spark, sf_dir):
    c = M.roc_curve(test_predictions(spark, sf_dir))
    return c.select(F.col("i").cast("long").alias("i"), r("threshold").alias("threshold"),
                    r("fpr").alias("fpr"), r("tpr").alias("tpr"))


SWEEP = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


@register("m14_threshold_sweep", f"""WITH {NB_CTES},
_t AS (SELECT CAST(unnest({SWEEP!r}) AS DOUBLE) AS threshold),
_c AS (SELECT threshold, count_if(label = 1 AND probability >= threshold) AS tp,
              count_if(label = 0 AND probability >= threshold) AS fp,
              count_if(label = 1 AND probability < threshold) AS fn,
              count_if(label = 0 AND probability < threshold) AS tn FROM _t, _pred GROUP BY threshold)
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM _c""",
          ("churn_base",))
def m14(spark, sf_dir):
    s = M.threshold_sweep(test_predictions(spark, sf_dir), SWEEP)
    return s.select("threshold", "tp", "fp", "fn", "tn", *[r(x).alias(x) for x in ("precision", "recall", "f1")])


@register("m6_stratified_folds", f"""
SELECT {R.id}, label, CAST((row_number() OVER (PARTITION BY label ORDER BY
    CAST('0x' || substr(md5(CAST({R.id} AS VARCHAR) || ':42'), 1, 15) AS BIGINT), {R.id}) - 1) % 5 AS INTEGER) AS fold
FROM (SELECT {R.id}, CASE WHEN churn THEN 1 ELSE 0 END AS label FROM churn_base)""", ("churn_base",))
def m6(spark, sf_dir):
    from tidemark.sources.fixtures import churn_base
    b = churn_base(spark, sf_dir).select(R.id, F.col("churn").cast("int").alias("label"))
    return M.stratified_folds(b, R.id, "label")
