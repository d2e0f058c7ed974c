"""M1 nearest neighbours, P9 balanced training rows, and naive Bayes on them."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.stats import r
from tidemark.operators import models as M
from tidemark.operators import neighbours as N
from tidemark.operators import prep
from tidemark.plans.catalog import register
from tidemark.plans.model_queries import scaled_split
from tidemark.plans.prep_sql import FEATURES, R, prep_ctes, q

_HASH = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"


def _far(a: str, b: str, metric: str) -> str:
    if metric == N.MANHATTAN:
        return "round(" + " + ".join(f"abs({a}.{q(f)} - {b}.{q(f)})" for f in FEATURES) + ", 9)"
    return "round(sqrt(" + " + ".join(f"power({a}.{q(f)} - {b}.{q(f)}, 2)" for f in FEATURES) + "), 9)"


def _knn_sql(k: int, weights: str, metric: str) -> str:
    p = "avg(label)" if weights == "uniform" else \
        "CASE WHEN min(d) = 0 THEN avg(label) FILTER (d = 0) ELSE sum(label / d) / sum(1 / d) END"
    return f"""WITH {prep_ctes()},
_far AS (SELECT t.{R.id}, n.label, n.{R.id} AS nid, {_far('t', 'n', metric)} AS d FROM _z t JOIN _z n ON t.is_test AND NOT n.is_test),
_near AS (SELECT * FROM _far QUALIFY row_number() OVER (PARTITION BY {R.id} ORDER BY d, nid) <= {k}),
_vote AS (SELECT {R.id}, {p} AS probability FROM _near GROUP BY {R.id})
SELECT {R.id}, round(probability, 6) AS probability, CASE WHEN round(probability, 9) > 0.5 THEN 1 ELSE 0 END AS pred FROM _vote"""


def _knn(spark, sf_dir, k, weights, metric):
    m, z = scaled_split(spark, sf_dir)
    return N.knn_predict(z.where(~F.col("is_test")), z.where("is_test"), m.feature_columns, R.id, k=k, weights=weights, metric=metric)


@register("m1_knn", _knn_sql(5, "uniform", N.EUCLIDEAN), ("churn_base",))
def m1(spark, sf_dir):
    """Default model: five neighbours, equal votes, euclidean."""
    return _knn(spark, sf_dir, 5, "uniform", N.EUCLIDEAN).select(R.id, r("probability").alias("probability"), "pred")


@register("m1_knn_distance_weights", _knn_sql(11, "distance", N.MANHATTAN), ("churn_base",))
def m1_weighted(spark, sf_dir):
    """A tuned model: eleven neighbours, inverse-distance votes, manhattan."""
    found = _knn(spark, sf_dir, 11, "distance", N.MANHATTAN)
    return found.select(R.id, r("probability").alias("probability"), (F.round("probability", 9) > 0.5).cast("int").alias("pred"))


def _smote_ctes() -> str:
    mixed = ", ".join(f"x.{q(f)} + c.weight * (coalesce(y.{q(f)}, x.{q(f)}) - x.{q(f)}) AS {q(f)}" for f in FEATURES)
    return f"""{prep_ctes()},
_cls AS (SELECT label, count(*) AS n FROM _z WHERE NOT is_test GROUP BY label),
_few AS (SELECT label, n, (SELECT max(n) FROM _cls) - n AS missing FROM _cls ORDER BY n, label LIMIT 1),
_min AS MATERIALIZED (SELECT z.* FROM _z z, _few f WHERE NOT is_test AND z.label = f.label),
_dst AS (SELECT a.{R.id} AS pid, b.{R.id} AS nid, {_far('a', 'b', N.EUCLIDEAN)} AS d FROM _min a JOIN _min b ON a.{R.id} <> b.{R.id}),
_nb AS (SELECT pid, nid, row_number() OVER (PARTITION BY pid ORDER BY d, nid) AS k FROM _dst QUALIFY k <= 5),
_pos AS (SELECT {R.id} AS pid, row_number() OVER (ORDER BY {_HASH.format(f"{R.id} || ':42'")}, {R.id}) AS pos FROM _min),
_quo AS (SELECT pid, f.n AS n, f.missing // f.n + CASE WHEN pos <= f.missing % f.n THEN 1 ELSE 0 END AS quota FROM _pos, _few f),
_cpy AS (SELECT pid, n, CAST(unnest(range(1, quota + 1)) AS INTEGER) AS copy FROM _quo),
_pck AS (SELECT pid, copy, {_HASH.format("pid || ':' || copy || ':42:n'")} % greatest(least(5, n - 1), 1) + 1 AS k,
                {_HASH.format("pid || ':' || copy || ':42:u'")} / power(16.0, 15) AS weight FROM _cpy),
_cho AS (SELECT pid, copy, weight, nid FROM _pck LEFT JOIN _nb USING (pid, k)),
_new AS MATERIALIZED (SELECT c.pid AS {R.id}, c.copy, c.nid AS neighbour, c.weight, x.label, {mixed}
         FROM _cho c JOIN _min x ON x.{R.id} = c.pid LEFT JOIN _min y ON y.{R.id} = c.nid)"""


def balanced_train(spark, sf_dir):
    m, z = scaled_split(spark, sf_dir)
    return m, N.balanced(z.where(~F.col("is_test")), m.feature_columns, R.id)


@register("p9_smote", f"WITH {_smote_ctes()}\n" + " UNION ALL ".join(
    f"SELECT {R.id}, copy, neighbour, round(weight, 6) AS weight, label, '{f}' AS feature, round({q(f)}, 6) AS value FROM _new"
    for f in FEATURES), ("churn_base",))
def p9(spark, sf_dir):
    """The new rows that bring the training classes to parity, one row per feature."""
    m, z = scaled_split(spark, sf_dir)
    new = N.smote(z.where(~F.col("is_test")), m.feature_columns, R.id)
    ids = [R.id, "copy", "neighbour", r("weight").alias("weight"), "label"]
    names = F.array(*[F.lit(f) for f in m.feature_columns])
    values = F.array(*[F.col(f"`{f}`") for f in m.feature_columns])
    return new.select(*ids, F.explode(F.arrays_zip(names.alias("feature"), values.alias("value"))).alias("v")).select(
        R.id, "copy", "neighbour", "weight", "label", "v.feature", r("v.value").alias("value"))


@register("p9_class_counts", f"""WITH {_smote_ctes()}
SELECT label, count(*) FILTER (copy = 0) AS given, count(*) FILTER (copy > 0) AS synthesised, count(*) AS total
FROM (SELECT label, 0 AS copy FROM _z WHERE NOT is_test UNION ALL SELECT label, copy FROM _new) GROUP BY label""", ("churn_base",))
def p9_counts(spark, sf_dir):
    """Rows per class before and after: the totals are equal."""
    _, rows = balanced_train(spark, sf_dir)
    return rows.groupBy("label").agg(F.count_if(F.col("copy") == 0).alias("given"), F.count_if(F.col("copy") > 0).alias("synthesised"),
                                     F.count(F.lit(1)).alias("total"))


def _balanced_nb_sql() -> str:
    stats = ", ".join([f"avg({q(f)}) AS m{i}" for i, f in enumerate(FEATURES)] + [f"var_pop({q(f)}) AS v{i}" for i, f in enumerate(FEATURES)])
    eps = "1e-9 * greatest(" + ", ".join(f"var_pop({q(f)})" for f in FEATURES) + ")"
    columns = ", ".join(q(f) for f in FEATURES)

    def jll(c):
        return f"ln(c{c}.n / (c0.n + c1.n))" + "".join(
            f" - 0.5 * ln(2 * pi() * (c{c}.v{i} + e.eps)) - power(t.{q(f)} - c{c}.m{i}, 2) / (2 * (c{c}.v{i} + e.eps))"
            for i, f in enumerate(FEATURES))
    return f"""WITH {_smote_ctes()},
_bal AS MATERIALIZED (SELECT label, {columns} FROM _z WHERE NOT is_test UNION ALL SELECT label, {columns} FROM _new),
_nbs AS (SELECT label, count(*) AS n, {stats} FROM _bal GROUP BY label),
_eps AS (SELECT {eps} AS eps FROM _bal),
_jll AS (SELECT t.{R.id}, t.label, {jll(0)} AS j0, {jll(1)} AS j1 FROM _z t, (SELECT * FROM _nbs WHERE label = 0) c0,
         (SELECT * FROM _nbs WHERE label = 1) c1, _eps e WHERE t.is_test)
SELECT {R.id}, label, round(1 / (1 + exp(least(j0 - j1, 700))), 6) AS probability, CASE WHEN j1 > j0 THEN 1 ELSE 0 END AS pred FROM _jll"""


@register("m2_balanced_predictions", _balanced_nb_sql(), ("churn_base",))
def m2_balanced(spark, sf_dir):
    """Naive Bayes trained on the balanced rows, on the untouched test rows."""
    m, rows = balanced_train(spark, sf_dir)
    nb = M.fit_naive_bayes(rows, m.feature_columns)
    _, z = scaled_split(spark, sf_dir)
    return z.where("is_test").select(R.id, "label", r(nb.probability()).alias("probability"), nb.decision().alias("pred"))
