"""Exact trees (M3, M11) and the explanation chain."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.stats import r
from tidemark.operators import explain as E
from tidemark.operators import models as M
from tidemark.operators import trees as T
from tidemark.plans.catalog import register
from tidemark.plans.model_queries import NB_CTES, naive_bayes, scaled_split
from tidemark.plans.prep_sql import FEATURES, R, prep_ctes, q
from tidemark.plans.score_queries import SCORE_CTES, _sig, _term, scaled_scoring_rows


# ---- trees

def trained_tree(spark, sf_dir, **options):
    m, z = scaled_split(spark, sf_dir)
    return m, T.fit_tree(z.where(~F.col("is_test")), m.feature_columns, **options)


@register("m3_decision_tree")
def m3(spark, sf_dir):
    """Test metrics of the default tree (depth 10, minimum split 2, gini)."""
    m, tree = trained_tree(spark, sf_dir)
    _, z = scaled_split(spark, sf_dir)
    return M.classification_metrics(T.with_tree(z.where("is_test"), tree, m.feature_columns))


def _root_sql(criterion: str) -> str:
    def imp(p, n):
        share = f"({p} / {n})"
        if criterion == T.GINI:
            return f"2 * {share} * (1 - {share})"
        return (f"(CASE WHEN {p} > 0 THEN -{share} * log2({share}) ELSE 0 END + "
                f"CASE WHEN {p} < {n} THEN -(1 - {share}) * log2(1 - {share}) ELSE 0 END)")
    long = " UNION ALL ".join(f"SELECT {i} AS f, '{f}' AS feature, {q(f)} AS v, label FROM _z WHERE NOT is_test" for i, f in enumerate(FEATURES))
    return f"""WITH {prep_ctes()},
_tl AS ({long}),
_tv AS (SELECT f, feature, v, count(*) AS n, CAST(sum(label) AS DOUBLE) AS p FROM _tl GROUP BY ALL),
_tr AS (SELECT f, feature, v, lead(v) OVER w AS nv, CAST(sum(n) OVER w AS DOUBLE) AS n, sum(p) OVER w AS p,
               CAST(sum(n) OVER (PARTITION BY f) AS DOUBLE) AS an, sum(p) OVER (PARTITION BY f) AS ap
        FROM _tv WINDOW w AS (PARTITION BY f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
_tc AS (SELECT *, round(n * {imp('p', 'n')} + (an - n) * {imp('(ap - p)', '(an - n)')}, 9) AS cost FROM _tr
        QUALIFY row_number() OVER (PARTITION BY f ORDER BY v DESC) > 1)
SELECT '{criterion}' AS criterion, feature, round((v + nv) / 2, 6) AS threshold, CAST(n AS BIGINT) AS left_rows, CAST(p AS BIGINT) AS left_positive,
       CAST(an - n AS BIGINT) AS right_rows, CAST(ap - p AS BIGINT) AS right_positive FROM _tc ORDER BY cost, f, v LIMIT 1"""


def _root(spark, sf_dir, criterion):
    m, tree = trained_tree(spark, sf_dir, max_depth=1, criterion=criterion)
    left, right = int(tree.left[0]), int(tree.right[0])
    row = (criterion, m.feature_columns[int(tree.feature[0])], float(tree.threshold[0]), int(tree.n[left]), int(tree.pos[left]), int(tree.n[right]),
           int(tree.pos[right]))
    df = spark.createDataFrame([row], "criterion string, feature string, threshold double, left_rows long, left_positive long, right_rows long, "
                                      "right_positive long")
    return df.withColumn("threshold", r("threshold"))


@register("m3_root_split_gini", _root_sql(T.GINI), ("churn_base",))
def m3_gini(spark, sf_dir):
    """The split of a tree of depth one: the best of all thresholds of all features."""
    return _root(spark, sf_dir, T.GINI)


@register("m3_root_split_entropy", _root_sql(T.ENTROPY), ("churn_base",))
def m3_entropy(spark, sf_dir):
    return _root(spark, sf_dir, T.ENTROPY)


@register("m11_tree_importance")
def m11(spark, sf_dir):
    """The fifteen largest importances of the default tree."""
    m, tree = trained_tree(spark, sf_dir)
    found = sorted(zip(tree.importances(len(m.feature_columns)).tolist(), m.feature_columns), key=lambda t: (-t[0], t[1]))[:15]
    return spark.createDataFrame([(i + 1, f, v) for i, (v, f) in enumerate(found)], "rank int, feature string, importance double")


# ---- explanations

def _kernel_ctes() -> str:
    z, weights = E.coalitions(len(FEATURES))
    a, c = E.kernel_projector(z, weights)
    delta = ", ".join(f"({_term(0, i, f't.{q(f)}')} - {_term(0, i, '0.0')}) - ({_term(1, i, f't.{q(f)}')} - {_term(1, i, '0.0')})"
                      for i, f in enumerate(FEATURES))
    members = ", ".join(f"({k}, [{', '.join(str(int(v)) + '.0' for v in row)}])" for k, row in enumerate(z))
    weights_ = ", ".join(f"({k}, {i + 1}, {a[i, k]!r})" for k in range(len(z)) for i in range(len(FEATURES))).replace("np.float64(", "(")
    own = ", ".join(f"({i + 1}, '{f}', {float(c[i])!r})" for i, f in enumerate(FEATURES))
    return f"""{SCORE_CTES},
_co(k, z) AS (VALUES {members}),
_aw(k, i, a) AS (VALUES {weights_}),
_cw(i, feature, c) AS (VALUES {own}),
_dl AS MATERIALIZED (SELECT t.row_no, t.p, t.pb, t.b0 - t.b1 AS d0, [{delta}] AS dl FROM _sb t,
        (SELECT * FROM _nbs WHERE label = 0) c0, (SELECT * FROM _nbs WHERE label = 1) c1, _eps e),
_fs AS MATERIALIZED (SELECT row_no, k, {_sig('d0 + list_dot_product(z, dl)')} - pb AS g FROM _dl, _co),
_ks AS (SELECT row_no, i, sum(a * g) AS s FROM _fs JOIN _aw USING (k) GROUP BY ALL),
_kern AS MATERIALIZED (SELECT row_no, i, feature, p AS probability, pb AS base_value, s + c * (p - pb) AS contribution
         FROM _ks JOIN _cw USING (i) JOIN _dl USING (row_no))"""


KERNEL_CTES = _kernel_ctes()


def kernel_explanations(spark, sf_dir):
    nb = naive_bayes(spark, sf_dir)
    return E.explain_kernel(scaled_scoring_rows(spark, sf_dir), E.nb_predictor(nb), nb.features, keep=("row_no",))


@register("x4_shapley_sampling", f"""WITH {KERNEL_CTES}
SELECT row_no, feature, round(contribution, 6) AS shapley FROM _kern""", ("churn_base", "churn_raw"))
def x4(spark, sf_dir):
    """The weighted regression over 100 coalitions, every row of the scoring batch."""
    e = kernel_explanations(spark, sf_dir)
    return e.select("row_no", F.explode("contributions").alias("c")).select("row_no", "c.feature", r("c.contribution").alias("shapley"))


@register("x4_sums_to_probability", f"""WITH {SCORE_CTES}
SELECT row_no, round(pb, 6) AS base_value, round(p - pb, 6) AS contribution_sum FROM _sb""", ("churn_base", "churn_raw"))
def x4_sums(spark, sf_dir):
    """The contributions of a row sum to its probability less the base."""
    e = kernel_explanations(spark, sf_dir)
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["contribution"])
    return e.select("row_no", r("base_value").alias("base_value"), r(total).alias("contribution_sum"))


@register("x5_tree_shapley")
def x5(spark, sf_dir):
    """Exact values of the decision tree for every row of the scoring batch."""
    m, tree = trained_tree(spark, sf_dir)
    e = E.explain_tree(scaled_scoring_rows(spark, sf_dir), tree, m.feature_columns, keep=("row_no",))
    return e.select("row_no", F.explode("contributions").alias("c")).select("row_no", "c.feature", r("c.contribution").alias("shapley"))


@register("x8_x9_explanation_check", f"""WITH {KERNEL_CTES},
_kr AS (SELECT *, CASE WHEN contribution > 0 THEN 'p' WHEN contribution < 0 THEN 'n' END AS side,
               row_number() OVER (PARTITION BY row_no, contribution > 0, contribution < 0 ORDER BY abs(round(contribution, 9)) DESC, feature) AS rank FROM _kern),
_kv AS (SELECT row_no, max(probability) AS p, max(base_value) AS b, sum(contribution) AS s,
               count_if(side IS NOT NULL AND rank <= 5 AND abs(contribution) > 1e-6) AS signals,
               count_if(side = 'p' AND rank <= 5) AS np, count_if(side = 'n' AND rank <= 5) AS nn FROM _kr GROUP BY row_no),
_lr AS (SELECT row_no, count_if(contribution > 0) AS np, count_if(contribution < 0) AS nn FROM _contrib GROUP BY row_no)
SELECT row_no, CASE WHEN ok THEN 'model' ELSE 'local' END AS source, round(b, 6) AS base_value,
       round(CASE WHEN ok THEN b + s ELSE p END, 6) AS prediction_value,
       CAST(CASE WHEN ok THEN k.np ELSE least(l.np, 5) END AS INTEGER) AS n_positive,
       CAST(CASE WHEN ok THEN k.nn ELSE least(l.nn, 5) END AS INTEGER) AS n_negative
FROM (SELECT *, signals > 0 AND abs(b + s - p) <= 0.05 AS ok FROM _kv) k JOIN _lr l USING (row_no)""", ("churn_base", "churn_raw"))
def x8(spark, sf_dir):
    """Model explanation where valid, else the local one, else none."""
    nb = naive_bayes(spark, sf_dir)
    predict = E.nb_predictor(nb)
    t = E.chain(scaled_scoring_rows(spark, sf_dir), E.kernel_explainer(predict, len(nb.features)), predict, nb.features, keep=("row_no",))
    return t.select("row_no", "source", r("base_value").alias("base_value"), r("prediction_value").alias("prediction_value"),
                    F.size("top_positive").alias("n_positive"), F.size("top_negative").alias("n_negative"))


@register("x8_tree_chain")
def x8_tree(spark, sf_dir):
    """The same chain for the decision tree, whose own explanation is X5."""
    m, tree = trained_tree(spark, sf_dir)
    t = E.chain(scaled_scoring_rows(spark, sf_dir), E.tree_explainer(tree, len(m.feature_columns)), tree.probability, m.feature_columns, keep=("row_no",))
    return t.select("row_no", "source", r("base_value").alias("base_value"), r("prediction_value").alias("prediction_value"),
                    F.size("top_positive").alias("n_positive"), F.size("top_negative").alias("n_negative"))
