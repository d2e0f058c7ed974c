"""Feature-ranking queries on the churn fixture."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.stats import r
from tidemark.operators import features as FE
from tidemark.plans.catalog import register
from tidemark.session import stored
from tidemark.roles import FIXTURE as R
from tidemark.sources.fixtures import churn_base

CATS = list(R.binary) + list(R.multi) + list(R.flag)
NUMS = list(R.numeric)
BINS = FE.MI_BINS
THRESHOLD = 0.001
NAMES = ["contract", "tenure", "total_charges"]


def _disc_sql() -> str:
    parts = [f"SELECT y, '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), '-1') AS x FROM _f" for c in CATS]
    for c in NUMS:
        parts.append(
            f"SELECT y, '{c}' AS feature, CAST(CAST(least(floor(({c} - (SELECT min({c}) FROM _f)) * {BINS} / "
            f"CASE WHEN (SELECT max({c}) FROM _f) = (SELECT min({c}) FROM _f) THEN 1.0 "
            f"ELSE (SELECT max({c}) FROM _f) - (SELECT min({c}) FROM _f) END), {BINS - 1}) AS INTEGER) AS VARCHAR) AS x FROM _f")
    fill = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM churn_base WHERE churn IS NOT NULL)) AS {c}"
                     for c in NUMS)
    return f"""_f AS MATERIALIZED (SELECT CAST(churn AS INTEGER) AS y, {', '.join(CATS)}, {fill} FROM churn_base WHERE churn IS NOT NULL),
_dz AS MATERIALIZED ({' UNION ALL '.join(parts)}),
_cnt AS (SELECT feature, x, y, count(*) AS n FROM _dz GROUP BY ALL),
_mi AS MATERIALIZED (SELECT feature, sum(n / tot * ln(n * tot / (nx * ny))) AS mutual_information FROM (
   SELECT *, sum(n) OVER (PARTITION BY feature) AS tot, sum(n) OVER (PARTITION BY feature, x) AS nx,
          sum(n) OVER (PARTITION BY feature, y) AS ny FROM _cnt) GROUP BY feature)"""


def mi(spark, sf_dir):
    return FE.mutual_information(stored(churn_base(spark, sf_dir)), "churn", CATS, NUMS)


@register("f1a_mutual_information", f"WITH {_disc_sql()}\nSELECT feature, round(mutual_information, 6) AS mutual_information FROM _mi",
          ("churn_base",))
def f1(spark, sf_dir):
    return mi(spark, sf_dir).select("feature", r("mutual_information").alias("mutual_information"))


def _psi(x: str) -> str:
    z = f"({x} + 6.0)"
    series = (f"ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} * {z}) + 1 / (120 * {z} * {z} * {z} * {z}) "
              f"- 1 / (252 * {z} * {z} * {z} * {z} * {z} * {z})")
    return f"({series} - (1.0 / {x} + " + " + ".join(f"1.0 / ({x} + {j})" for j in range(1, 6)) + "))"


def _knn_sql() -> str:
    med = {c: f"(SELECT quantile_cont({c}, 0.5) FROM churn_base WHERE churn IS NOT NULL)" for c in NUMS}
    parts = [f"SELECT customer_id AS id, CAST(churn AS INTEGER) AS y, '{c}' AS feature, coalesce(CAST({c} AS DOUBLE), {med[c]}) AS x "
             f"FROM churn_base WHERE churn IS NOT NULL" for c in NUMS]
    parts += [f"SELECT customer_id AS id, CAST(churn AS INTEGER) AS y, '{c}' AS feature, CASE WHEN {c} IS NULL THEN -1.0 ELSE "
              f"dense_rank() OVER (ORDER BY CAST({c} AS VARCHAR) NULLS LAST) - 1.0 END AS x FROM churn_base WHERE churn IS NOT NULL" for c in CATS]
    gaps = ", ".join(f"v - lag(v, {i}) OVER w, lead(v, {i}) OVER w - v" for i in range(1, FE.NEIGHBOURS + 1))
    k = FE.NEIGHBOURS
    return f"""_x AS ({' UNION ALL '.join(parts)}),
_v0 AS (SELECT feature, y, id, CAST(round(x * 100) AS BIGINT) * 1073741824
          + (CAST('0x' || substr(md5(feature || ':' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) >> 2) AS v FROM _x),
_v AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY feature, y) AS n_y FROM _v0) WHERE n_y > 1),
_g AS (SELECT *, list_sort(list_filter([{gaps}], lambda z: z IS NOT NULL)) AS g FROM _v WINDOW w AS (PARTITION BY feature, y ORDER BY v, id)),
_r AS (SELECT feature, v, n_y, least({k}, len(g)) AS k, greatest(g[least({k}, len(g))], 1) - 1 AS r FROM _g),
_m AS (SELECT *, count(*) OVER (PARTITION BY feature ORDER BY v RANGE BETWEEN r PRECEDING AND r FOLLOWING) AS m FROM _r),
_mi AS MATERIALIZED (SELECT feature, greatest(0.0, {_psi('count(*)')} + avg({_psi('k')}) - avg({_psi('n_y')}) - avg({_psi('m')})) AS mutual_information
        FROM _m GROUP BY feature)"""


def knn_mi(spark, sf_dir):
    return FE.neighbour_information(stored(churn_base(spark, sf_dir)), "churn", R.id, CATS, NUMS)


@register("f1b_neighbour_information", f"WITH {_knn_sql()}\nSELECT feature, round(mutual_information, 6) AS mutual_information FROM _mi",
          ("churn_base",))
def f1b(spark, sf_dir):
    return knn_mi(spark, sf_dir).select("feature", r("mutual_information").alias("mutual_information"))


@register("f2_category_codes", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", v AS value, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code "
    f"FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM churn_base WHERE {c} IS NOT NULL)" for c in CATS),
          ("churn_base",))
def f2(spark, sf_dir):
    return FE.category_codes(churn_base(spark, sf_dir), CATS)


@register("f3_select_by_threshold", f"""WITH {_knn_sql()}
SELECT feature, round(mutual_information, 6) AS mutual_information, CAST(NULL AS VARCHAR) AS message FROM _mi
WHERE mutual_information >= {THRESHOLD}
UNION ALL
SELECT NULL, NULL, 'No features found with importance >= {THRESHOLD}. Maximum importance score: ' || printf('%.4f', max(mutual_information))
FROM _mi HAVING count_if(mutual_information >= {THRESHOLD}) = 0""", ("churn_base",))
def f3(spark, sf_dir):
    s = FE.select_by_threshold(knn_mi(spark, sf_dir), THRESHOLD, on_empty="report")
    return s.select("feature", r("mutual_information").alias("mutual_information"), "message")


@register("f4_select_by_names", f"WITH {_knn_sql()}\nSELECT feature, round(mutual_information, 6) AS mutual_information FROM _mi "
          f"WHERE feature IN ({', '.join(repr(n) for n in NAMES)})", ("churn_base",))
def f4(spark, sf_dir):
    return FE.select_by_names(knn_mi(spark, sf_dir), NAMES).select(
        "feature", r("mutual_information").alias("mutual_information"))


@register("f5_interaction", """
SELECT customer_id, round(coalesce(tenure, 0) * coalesce(monthly_charges, 0), 6) AS tenure_x_monthly FROM churn_base""",
          ("churn_base",))
def f5(spark, sf_dir):
    b = churn_base(spark, sf_dir)
    return b.select("customer_id", r(FE.interaction("tenure", "monthly_charges")).alias("tenure_x_monthly"))


@register("f6_interaction_stats", """
WITH _v AS (SELECT CAST(coalesce(tenure, 0) * coalesce(monthly_charges, 0) AS DOUBLE) AS v FROM churn_base)
SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
       round(quantile_cont(v, 0.5), 6) AS median FROM _v""", ("churn_base",))
def f6(spark, sf_dir):
    s = FE.interaction_stats(churn_base(spark, sf_dir), "tenure", "monthly_charges")
    return s.select(*[r(c).alias(c) for c in ("mean", "std", "min", "max", "median")])


@register("f7_selection_totals", f"WITH {_knn_sql()}\nSELECT count(*) AS selected_count, round(sum(mutual_information), 6) AS total_importance "
          f"FROM _mi WHERE mutual_information >= {THRESHOLD}", ("churn_base",))
def f7(spark, sf_dir):
    t = FE.selection_totals(FE.select_by_threshold(knn_mi(spark, sf_dir), THRESHOLD, on_empty="report"))
    return t.select("selected_count", r("total_importance").alias("total_importance"))
