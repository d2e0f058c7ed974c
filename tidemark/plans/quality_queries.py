"""Data-quality queries over the dirty churn fixture (and its raw form)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quality as q
from tidemark.plans.catalog import register
from tidemark.session import stored
from tidemark.plans.sqlgen import long_sql
from tidemark.roles import FIXTURE
from tidemark.sources.fixtures import churn_dirty, churn_raw

QC = list(FIXTURE.quality_columns)
NUM = list(FIXTURE.numeric)
CATD = [c for c in FIXTURE.categorical if c in FIXTURE.domains]


def _missing_sql(src="churn_dirty"):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS missing_count FROM {src}" for c in QC)


def _outlier_cte():
    return f"""_ol AS (SELECT * FROM {long_sql('churn_dirty', NUM)}),
_qb AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM _ol GROUP BY ALL),
_out AS (SELECT n."column", CAST(count_if(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outlier_count
         FROM (SELECT unnest({NUM!r}) AS "column") n LEFT JOIN _ol USING ("column") LEFT JOIN _qb USING ("column")
         GROUP BY n."column")"""


def _invalid_sql():
    parts = []
    for c in CATD:
        dom = ", ".join("'" + v + "'" for v in FIXTURE.domains[c])
        bad = f"{c} IS NOT NULL AND {c} NOT IN ({dom})"
        parts.append(f"SELECT '{c}' AS \"column\", CAST(count_if({bad}) AS BIGINT) AS invalid_count, "
                     f"coalesce(string_agg(DISTINCT CASE WHEN {bad} THEN {c} END, '|' ORDER BY CASE WHEN {bad} THEN {c} END), '') AS invalid_values FROM churn_dirty")
    return " UNION ALL ".join(parts)


@register("q1_missing_counts", _missing_sql(), ("churn_dirty",))
def q1(spark, sf_dir):
    return q.missing_counts(churn_dirty(spark, sf_dir), FIXTURE)


@register("q2_iqr_outliers", f"""WITH {_outlier_cte()}
SELECT "column", outlier_count, round(coalesce(outlier_count * 100.0 / (SELECT count(*) FROM churn_dirty), 0), 2) AS outlier_percentage
FROM _out""", ("churn_dirty",))
def q2(spark, sf_dir):
    return q.iqr_outliers(churn_dirty(spark, sf_dir), FIXTURE)


@register("q3_invalid_categorical", _invalid_sql(), ("churn_dirty",))
def q3(spark, sf_dir):
    return q.invalid_categorical(churn_dirty(spark, sf_dir), FIXTURE)


@register("q3_invalid_values", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS rows FROM churn_dirty WHERE {c} IS NOT NULL AND {c} NOT IN ("
    + ", ".join("'" + x + "'" for x in FIXTURE.domains[c]) + f") GROUP BY {c}" for c in FIXTURE.categorical if c in FIXTURE.domains), ("churn_dirty",))
def q3_values(spark, sf_dir):
    return q.invalid_values(churn_dirty(spark, sf_dir), FIXTURE)


@register("q4_convertibility", f"""
SELECT row_no, "TotalCharges" AS value FROM churn_raw
WHERE "TotalCharges" IS NOT NULL AND trim("TotalCharges") <> ''
  AND NOT regexp_matches(lower("TotalCharges"), '{q.NUMERIC_TEXT}')""", ("churn_raw",))
def q4(spark, sf_dir):
    return q.convertibility(churn_raw(spark, sf_dir))


@register("q5_negative_values", """
SELECT 'monthly_charges' AS "column", customer_id FROM churn_dirty WHERE monthly_charges < 0
UNION ALL SELECT 'tenure', customer_id FROM churn_dirty WHERE tenure < 0""", ("churn_dirty",))
def q5(spark, sf_dir):
    return q.negative_values(churn_dirty(spark, sf_dir), "customer_id")


_SCORE_CTE = f"""_n AS (SELECT count(*) AS n FROM churn_dirty),
_m AS (SELECT sum(missing_count) AS m FROM ({_missing_sql()})),
{_outlier_cte()},
_i AS (SELECT sum(invalid_count) AS i FROM ({_invalid_sql()})),
_s AS (SELECT n, (n * {len(QC)} - m) * 100.0 / (n * {len(QC)}) AS c,
              (n * {len(NUM) + len(CATD)} - (SELECT sum(outlier_count) FROM _out) - i) * 100.0 / (n * {len(NUM) + len(CATD)}) AS v
       FROM _n, _m, _i)"""


@register("q8_quality_score", f"""WITH {_SCORE_CTE}
SELECT n AS total_records, round(c, 2) AS completeness_score, round(v, 2) AS validity_score,
       round(c * 0.5 + v * 0.5, 2) AS quality_score FROM _s""", ("churn_dirty",))
def q8(spark, sf_dir):
    return q.quality_score(stored(churn_dirty(spark, sf_dir)), FIXTURE)      # derived from joins: once


@register("q9_issue_totals", f"""WITH {_SCORE_CTE},
_b AS (SELECT CASE WHEN round(c * 0.5 + v * 0.5, 2) > 80 THEN 'good'
                   WHEN round(c * 0.5 + v * 0.5, 2) >= 70 THEN 'fair' ELSE 'poor' END AS band FROM _s)
SELECT 'Missing Values' AS category, CAST(m AS BIGINT) AS count, band FROM _m, _b
UNION ALL SELECT 'Outliers', CAST((SELECT sum(outlier_count) FROM _out) AS BIGINT), band FROM _b
UNION ALL SELECT 'Invalid Categorical', CAST(i AS BIGINT), band FROM _i, _b""", ("churn_dirty",))
def q9(spark, sf_dir):
    return q.issue_totals(stored(churn_dirty(spark, sf_dir)), FIXTURE)


@register("q10_issue_ranking", f"""
SELECT "column", missing_count, round(missing_count * 100.0 / (SELECT count(*) FROM churn_dirty), 2) AS missing_percentage
FROM ({_missing_sql()}) WHERE missing_count > 0""", ("churn_dirty",))
def q10(spark, sf_dir):
    return q.issue_ranking(churn_dirty(spark, sf_dir), FIXTURE)
