"""EDA and dashboard queries over the churn fixture."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.stats import r
from tidemark.operators import eda
from tidemark.plans.catalog import register
from tidemark.plans.sqlgen import long_sql, not_null
from tidemark.roles import FIXTURE
from tidemark.sources.fixtures import churn_base

CORR_COLS = ["tenure", "monthly_charges", "total_charges", "senior_citizen"]
NUM = list(FIXTURE.numeric)
BINS = 10


def _corr_sql() -> str:
    parts = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            parts.append(f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, "
                         f"round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) AS correlation, "
                         f"count(*) AS record_count FROM _d")
    return (f"WITH _d AS (SELECT * FROM churn_base WHERE {not_null(CORR_COLS)})\n"
            + " UNION ALL ".join(parts))


@register("e1_correlation_matrix", _corr_sql(), ("churn_base",))
def e1(spark, sf_dir):
    m = eda.correlation_matrix(churn_base(spark, sf_dir), CORR_COLS)
    return m.select("feature_x", "feature_y", r("correlation").alias("correlation"), "record_count")


_HIST_SQL = f"""
WITH _d AS (SELECT * FROM churn_base WHERE {not_null(NUM)}),
_l AS (SELECT * FROM {long_sql('_d', NUM, key='feature')}),
_rng AS (SELECT feature,
           CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
           CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi
         FROM _l GROUP BY feature),
_cnt AS (SELECT _l.feature, CAST(least(floor((value - lo) * {BINS} / (hi - lo)), {BINS - 1}) AS INTEGER) AS bin,
           count(*) AS frequency FROM _l JOIN _rng USING (feature) GROUP BY ALL),
_grid AS (SELECT feature, lo, hi, CAST(b.range AS INTEGER) AS bin FROM _rng, range(0, {BINS}) b)
SELECT feature, bin, round(lo + bin * ((hi - lo) / {BINS}), 6) AS bin_lower,
       round(CASE WHEN bin = {BINS - 1} THEN hi ELSE lo + (bin + 1) * ((hi - lo) / {BINS}) END, 6) AS bin_upper,
       coalesce(frequency, 0) AS frequency
FROM _grid LEFT JOIN _cnt USING (feature, bin)"""


@register("e2_histogram", _HIST_SQL, ("churn_base",))
def e2(spark, sf_dir):
    h = eda.histogram(churn_base(spark, sf_dir), NUM, BINS)
    return h.select("feature", "bin", r("bin_lower").alias("bin_lower"),
                    r("bin_upper").alias("bin_upper"), "frequency")


_DIST_SQL = f"""
WITH _d AS (SELECT * FROM churn_base WHERE {not_null(NUM)}),
_l AS (SELECT * FROM {long_sql('_d', NUM, key='feature')})
SELECT feature, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean,
       round(quantile_cont(value, 0.5), 6) AS median FROM _l GROUP BY feature"""


@register("e3_distribution_stats", _DIST_SQL, ("churn_base",))
def e3(spark, sf_dir):
    d = eda.distribution_stats(churn_base(spark, sf_dir), NUM)
    return d.select("feature", *[r(c).alias(c) for c in ("min", "max", "mean", "median")])


def _churn_by_sql(col: str) -> str:
    return f"""SELECT {col} AS segment, count(*) AS total_customers,
  CAST(count_if(churn) AS BIGINT) AS churned_customers, round(count_if(churn) / count(*), 6) AS churn_rate
FROM churn_base WHERE {col} IS NOT NULL AND churn IS NOT NULL GROUP BY {col}"""


def _churn_by(spark, sf_dir, col):
    g = eda.churn_by(churn_base(spark, sf_dir), col)
    return g.select("segment", "total_customers", "churned_customers", r("churn_rate").alias("churn_rate"))


@register("e4_churn_by_contract", _churn_by_sql("contract"), ("churn_base",))
def e4(spark, sf_dir):
    return _churn_by(spark, sf_dir, "contract")


@register("e5_churn_by_internet", _churn_by_sql("internet_service"), ("churn_base",))
def e5(spark, sf_dir):
    return _churn_by(spark, sf_dir, "internet_service")


@register("e6_churn_summary", """
SELECT count(*) AS total_customers, CAST(count_if(churn) AS BIGINT) AS churned_customers,
       CAST(count(*) - count_if(churn) AS BIGINT) AS retained_customers,
       round(count_if(churn) / count(*), 6) AS churn_rate
FROM churn_base WHERE contract IS NOT NULL AND churn IS NOT NULL""", ("churn_base",))
def e6(spark, sf_dir):
    s = eda.churn_summary(churn_base(spark, sf_dir), "contract")
    return s.select("total_customers", "churned_customers", "retained_customers",
                    r("churn_rate").alias("churn_rate"))


@register("e7_scatter", """
SELECT customer_id, round(monthly_charges, 6) AS monthly_charges, round(total_charges, 6) AS total_charges, churn
FROM churn_base WHERE monthly_charges IS NOT NULL AND total_charges IS NOT NULL AND churn IS NOT NULL""",
          ("churn_base",))
def e7(spark, sf_dir):
    s = eda.scatter(churn_base(spark, sf_dir), "monthly_charges", "total_charges", "churn", "customer_id")
    return s.select("customer_id", r("monthly_charges").alias("monthly_charges"),
                    r("total_charges").alias("total_charges"), "churn")


@register("e8_scatter_split", """
SELECT customer_id, round(monthly_charges, 6) AS monthly_charges, round(total_charges, 6) AS total_charges, churn,
       CASE WHEN churn THEN 'churned' ELSE 'retained' END AS series
FROM churn_base WHERE monthly_charges IS NOT NULL AND total_charges IS NOT NULL AND churn IS NOT NULL""",
          ("churn_base",))
def e8(spark, sf_dir):
    s = eda.scatter_split(churn_base(spark, sf_dir), "monthly_charges", "total_charges", "churn", "customer_id")
    return s.select("customer_id", r("monthly_charges").alias("monthly_charges"),
                    r("total_charges").alias("total_charges"), "churn", "series")


@register("e9_pca_projection")
def e9(spark, sf_dir):
    p = eda.pca_projection(churn_base(spark, sf_dir), CORR_COLS, 3, keep=("customer_id", "churn"))
    return p.select("customer_id", "churn", *[r(c).alias(c) for c in ("pc1", "pc2", "pc3")])


PCA2 = ["tenure", "total_charges"]


@register("e10_explained_variance", f"""
WITH _d AS (SELECT * FROM churn_base WHERE {not_null(PCA2)}),
_r AS (SELECT abs(covar_pop({PCA2[0]}, {PCA2[1]}) / (stddev_pop({PCA2[0]}) * stddev_pop({PCA2[1]}))) AS a FROM _d)
SELECT 1 AS component, round((1 + a) / 2, 6) AS explained_variance_ratio FROM _r
UNION ALL SELECT 2, round((1 - a) / 2, 6) FROM _r
UNION ALL SELECT 3, 0.0""", ("churn_base",))
def e10(spark, sf_dir):
    ev = eda.explained_variance(churn_base(spark, sf_dir), PCA2, 3)
    return ev.select("component", r("explained_variance_ratio").alias("explained_variance_ratio"))


STAT_COLS = NUM + ["senior_citizen"]


@register("e11_numeric_stats", f"""
WITH _l AS (SELECT * FROM {long_sql('churn_base', STAT_COLS)})
SELECT "column", count(*) AS count, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
       round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
       round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3
FROM _l GROUP BY "column" """, ("churn_base",))
def e11(spark, sf_dir):
    return eda.numeric_stats(churn_base(spark, sf_dir), STAT_COLS, digits=6)


CAT = list(FIXTURE.categorical)


@register("e12_categorical_counts", f"""
WITH _l AS (SELECT * FROM {long_sql('churn_base', CAT, cast='VARCHAR')}),
_vc AS (SELECT "column", value, count(*) AS count FROM _l GROUP BY ALL)
SELECT "column", value, count, CAST(sum(count) OVER (PARTITION BY "column") AS BIGINT) AS non_null_count,
       count(*) OVER (PARTITION BY "column") AS distinct_count FROM _vc""", ("churn_base",))
def e12(spark, sf_dir):
    return eda.categorical_counts(churn_base(spark, sf_dir), CAT)


PAGE, PAGE_SIZE = 3, 100


@register("e13_paginate_records", f"""
WITH _t AS (SELECT count(*) AS n FROM churn_base)
SELECT customer_id, tenure, round(total_charges, 6) AS total_charges, churn, contract,
       (SELECT n FROM _t) AS total_records, {PAGE} AS page, {PAGE_SIZE} AS page_size,
       CAST(ceil((SELECT n FROM _t) / {PAGE_SIZE}) AS BIGINT) AS total_pages,
       {PAGE} < ceil((SELECT n FROM _t) / {PAGE_SIZE}) AS has_next, {str(PAGE > 1).lower()} AS has_previous
FROM churn_base ORDER BY customer_id LIMIT {PAGE_SIZE} OFFSET {(PAGE - 1) * PAGE_SIZE}""", ("churn_base",))
def e13(spark, sf_dir):
    base = churn_base(spark, sf_dir).select("customer_id", "tenure", r("total_charges").alias("total_charges"),
                                            "churn", "contract")
    p = eda.paginate(base, ["customer_id"], PAGE, PAGE_SIZE)
    return p.withColumn("page", F.col("page").cast("int")).withColumn("page_size", F.col("page_size").cast("int"))


@register("e14_correlation_band", f"""
SELECT feature_x, feature_y, correlation,
  CASE WHEN correlation > 0.7 THEN 'strong positive' WHEN correlation > 0.3 THEN 'moderate positive'
       WHEN correlation > -0.3 THEN 'weak' WHEN correlation > -0.7 THEN 'moderate negative'
       ELSE 'strong negative' END AS band
FROM ({_corr_sql()})""", ("churn_base",))
def e14(spark, sf_dir):
    m = e1(spark, sf_dir)
    return m.select("feature_x", "feature_y", "correlation", eda.correlation_band(F.col("correlation")).alias("band"))


@register("e15_bin_labels", f"""
SELECT feature, bin, frequency,
  CAST(CAST(round(bin_lower, 0) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(round(bin_upper, 0) AS BIGINT) AS VARCHAR) AS label
FROM ({_HIST_SQL})""", ("churn_base",))
def e15(spark, sf_dir):
    h = e2(spark, sf_dir)
    return h.select("feature", "bin", "frequency", eda.bin_label(F.col("bin_lower"), F.col("bin_upper")).alias("label"))


CURSOR = 700


@register("e13_keyset_page", f"""
WITH _p AS (SELECT customer_id, tenure, round(total_charges, 6) AS total_charges, churn, contract
            FROM churn_base WHERE customer_id > {CURSOR} ORDER BY customer_id LIMIT {PAGE_SIZE + 1}),
_k AS (SELECT * FROM _p ORDER BY customer_id LIMIT {PAGE_SIZE})
SELECT _k.*, CASE WHEN (SELECT count(*) FROM _p) > {PAGE_SIZE} THEN (SELECT max(customer_id) FROM _k) END AS next_cursor
FROM _k""", ("churn_base",))
def e13k(spark, sf_dir):
    base = churn_base(spark, sf_dir).select("customer_id", "tenure", r("total_charges").alias("total_charges"),
                                            "churn", "contract")
    return eda.paginate_keyset(base, "customer_id", CURSOR, PAGE_SIZE)
