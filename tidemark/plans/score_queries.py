"""Batch scoring, explanations, dashboard and report queries."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions.stats import r
from tidemark.operators import dashboard as D
from tidemark.operators import prep
from tidemark.operators import score as X
from tidemark.operators import models as M
from tidemark.operators import validate as v
from tidemark.plans.catalog import register
from tidemark.plans.ingest_queries import SCORE_COLS, _typed_sql
from tidemark.plans.model_queries import NB_CTES, naive_bayes, test_predictions
from tidemark.plans.prep_queries import fitted, typed_scoring_rows
from tidemark.plans.prep_sql import FEATURES, R, apply_ctes, q
from tidemark.roles import CSV_TO_TYPED
from tidemark.sources.fixtures import churn_base

SCORE_TYPED = [CSV_TO_TYPED[c] for c in SCORE_COLS]


def scaled_scoring_rows(spark, sf_dir):
    m, _ = fitted(spark, sf_dir)
    typed = typed_scoring_rows(spark, sf_dir)
    return prep.apply_to_new_rows(typed, m, keep=("row_no", "contract"))


def predictions(spark, sf_dir):
    nb = naive_bayes(spark, sf_dir)
    return X.batch_score(scaled_scoring_rows(spark, sf_dir), nb, keep=("row_no", "contract"))


def explanations(spark, sf_dir):
    nb = naive_bayes(spark, sf_dir)
    return X.local_contributions(scaled_scoring_rows(spark, sf_dir), nb, keep=("row_no",))


# ---- SQL side ---------------------------------------------------------------

def _term(c, i, x):
    v = f"(c{c}.v{i} + e.eps)"
    return f"(- 0.5 * ln(2 * pi() * {v}) - power({x} - c{c}.m{i}, 2) / (2 * {v}))"


def _sig(dexpr):
    return f"CASE WHEN ({dexpr}) > 0 THEN exp(-({dexpr})) / (1 + exp(-({dexpr}))) ELSE 1 / (1 + exp({dexpr})) END"


def _score_ctes() -> str:
    base = {c: " + ".join([f"ln(c{c}.n / (c0.n + c1.n))"] + [_term(c, i, "0.0") for i in range(len(FEATURES))])
            for c in (0, 1)}
    full = {c: " + ".join([f"ln(c{c}.n / (c0.n + c1.n))"] + [_term(c, i, f"t.{q(f)}") for i, f in enumerate(FEATURES)])
            for c in (0, 1)}
    raws = []
    for i, f in enumerate(FEATURES):
        j0 = f"(b0 - {_term(0, i, '0.0')} + {_term(0, i, f't.{q(f)}')})"
        j1 = f"(b1 - {_term(1, i, '0.0')} + {_term(1, i, f't.{q(f)}')})"
        raws.append(f"{_sig(f'{j0} - {j1}')} - pb AS r{i}")
    frm = "(SELECT * FROM _nbs WHERE label = 0) c0, (SELECT * FROM _nbs WHERE label = 1) c1, _eps e"
    return f"""{NB_CTES}, _typed AS ({_typed_sql()}), {apply_ctes()},
_sj AS MATERIALIZED (SELECT t.row_no, t.* EXCLUDE (row_no), {full[0]} AS j0, {full[1]} AS j1, {base[0]} AS b0, {base[1]} AS b1
        FROM _az t, {frm}),
_spred AS MATERIALIZED (SELECT row_no, least(greatest({_sig('j0 - j1')}, 0.0), 1.0) AS probability FROM _sj),
_sb AS MATERIALIZED (SELECT *, {_sig('b0 - b1')} AS pb, {_sig('j0 - j1')} AS p FROM _sj),
_raw AS MATERIALIZED (SELECT t.row_no, t.p, t.pb, {', '.join(raws)} FROM _sb t, {frm}),
_tot AS MATERIALIZED (SELECT *, {' + '.join(f'r{i}' for i in range(len(FEATURES)))} AS rt FROM _raw),
_contrib AS MATERIALIZED ({' UNION ALL '.join(
        f"SELECT t.row_no, t.p AS probability, t.pb AS base_value, '{f}' AS feature, z.{q(f)} AS value, "
        f"r{i} * CASE WHEN abs(rt) > 1e-9 THEN (p - pb) / rt ELSE 1.0 END AS contribution "
        f"FROM _tot t JOIN _az z USING (row_no)" for i, f in enumerate(FEATURES))})"""


SCORE_CTES = _score_ctes()


@register("x1_x3_batch_score", f"""WITH {SCORE_CTES}
SELECT row_no, round(probability, 6) AS probability, probability >= 0.5 AS prediction FROM _spred""",
          ("churn_base", "churn_raw"))
def x1(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return p.select("row_no", r("probability").alias("probability"), "prediction")


@register("s9_model_artifact", f"""WITH {SCORE_CTES}
SELECT row_no, round(probability, 6) AS probability, probability >= 0.5 AS prediction FROM _spred""",
          ("churn_base", "churn_raw"))
def s9(spark, sf_dir):
    """Preprocessing and model saved, read back from the files, and the batch scored
    with what was read: the same probabilities as X1."""
    from tidemark.operators import artifact as A
    from tidemark.streaming.streams import scratch
    m, _ = fitted(spark, sf_dir)
    path = scratch(spark, "s9-artefact")
    A.save(spark, path, m, naive_bayes(spark, sf_dir))
    loaded, nb = A.load(spark, path)
    z = prep.apply_to_new_rows(typed_scoring_rows(spark, sf_dir), loaded, keep=("row_no",))
    return X.batch_score(z, nb, keep=("row_no",)).select("row_no", r("probability").alias("probability"), "prediction")


@register("x6_local_contributions", f"""WITH {SCORE_CTES}
SELECT row_no, round(base_value, 6) AS base_value, feature, round(value, 6) AS value,
       round(contribution, 6) AS contribution FROM _contrib""", ("churn_base", "churn_raw"))
def x6(spark, sf_dir):
    e = explanations(spark, sf_dir)
    return e.select("row_no", "base_value", F.explode("contributions").alias("c")).select(
        "row_no", r("base_value").alias("base_value"), F.col("c.feature").alias("feature"),
        r("c.value").alias("value"), r("c.contribution").alias("contribution"))


_TOPK = """_rk AS (SELECT row_no, feature, contribution,
    CASE WHEN contribution > 0 THEN 'positive' WHEN contribution < 0 THEN 'negative' END AS direction,
    row_number() OVER (PARTITION BY row_no, contribution > 0, contribution < 0 ORDER BY abs(round(contribution, 9)) DESC, feature) AS rank
  FROM _contrib)"""


@register("x7_top_contributors", f"""WITH {SCORE_CTES}, {_TOPK}
SELECT row_no, direction, CAST(rank AS INTEGER) AS rank, feature, round(contribution, 6) AS contribution
FROM _rk WHERE direction IS NOT NULL AND rank <= 5""", ("churn_base", "churn_raw"))
def x7(spark, sf_dir):
    t = X.top_contributors(explanations(spark, sf_dir), keep=("row_no",))
    pos = t.select("row_no", F.lit("positive").alias("direction"), F.posexplode("top_positive").alias("i", "c"))
    neg = t.select("row_no", F.lit("negative").alias("direction"), F.posexplode("top_negative").alias("i", "c"))
    return pos.unionByName(neg).select("row_no", "direction", (F.col("i") + 1).cast("int").alias("rank"),
                                       F.col("c.feature").alias("feature"), r("c.contribution").alias("contribution"))


@register("x10_waterfall", f"""WITH {SCORE_CTES},
_wo AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY abs(round(contribution, 9)) DESC, feature) AS step FROM _contrib),
_w AS (SELECT row_no, step, feature AS label,
              base_value + coalesce(sum(contribution) OVER (PARTITION BY row_no ORDER BY step
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, contribution FROM _wo)
SELECT row_no, CAST(step AS INTEGER) AS step, label, round(start, 6) AS start, round(start + contribution, 6) AS "end" FROM _w
UNION ALL SELECT DISTINCT row_no, 0, 'Base value', 0.0, round(base_value, 6) FROM _contrib
UNION ALL SELECT DISTINCT row_no, {len(FEATURES) + 1}, 'Prediction', 0.0, round(probability, 6) FROM _contrib""",
          ("churn_base", "churn_raw"))
def x10(spark, sf_dir):
    w = X.waterfall(explanations(spark, sf_dir), "row_no")
    return w.select("row_no", F.col("step").cast("int").alias("step"), "label",
                    r("start").alias("start"), r("end").alias("end"))


@register("x11_batch_accounting", f"""
WITH _m AS ({' UNION ALL '.join(f"SELECT row_no FROM churn_raw WHERE coalesce(\"{c}\", '') = ''" for c in SCORE_COLS)})
SELECT (SELECT count(*) FROM churn_raw) AS total_rows, (SELECT count(*) FROM churn_raw) AS scored_rows,
       (SELECT count(DISTINCT row_no) FROM _m) AS failed_rows, (SELECT count(*) FROM _m) AS failure_records,
       (SELECT count(*) FROM churn_raw) - (SELECT count(*) FROM _m) AS successful_count""",
          ("churn_raw",))
def x11(spark, sf_dir):
    from tidemark.sources.fixtures import churn_raw
    raw = churn_raw(spark, sf_dir)
    miss = v.missing_cells(raw, SCORE_COLS)
    # a row with a missing cell is reported as failed and still scored; the
    # reference's "successful" count subtracts failure records, not rows
    n_fail = miss.select(F.count(F.lit(1))).scalar()
    return raw.select(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.col("total_rows").alias("scored_rows"),
        miss.select(F.count_distinct("row_no")).scalar().alias("failed_rows"),
        n_fail.alias("failure_records"), (F.col("total_rows") - n_fail).alias("successful_count"))


PAGE_SIZE = 100


def export_sql(c: str) -> str:
    """DuckDB text of an exported field: charges with 2 decimals."""
    return f"printf('%.2f', t.{c})" if c in ("monthly_charges", "total_charges") else f"CAST(t.{c} AS VARCHAR)"


@register("x12_batch_page", f"""WITH {SCORE_CTES},
_b AS (SELECT s.row_no, s.probability, coalesce(t.contract, '') AS batch_id FROM _spred s JOIN _typed t USING (row_no)),
_r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY row_no) AS rank,
              count(*) OVER (PARTITION BY batch_id) AS batch_total FROM _b)
SELECT batch_id, row_no, round(probability, 6) AS probability, rank, (rank - 1) // {PAGE_SIZE} + 1 AS page, batch_total
FROM _r""", ("churn_base", "churn_raw"))
def x12(spark, sf_dir):
    """Every page of every batch (a batch = one contract segment upload), by
    creation order, with the batch total."""
    p = predictions(spark, sf_dir).withColumn("batch_id", F.coalesce("contract", F.lit("")))
    return X.batch_pages(p.select("batch_id", "row_no", r("probability").alias("probability")), PAGE_SIZE)


# owners: one row in 41 belongs to nobody; several rows share a time
_OWNED = """_owned AS (SELECT s.row_no AS prediction_id, s.probability, nullif(t.contract, '') AS batch_id,
                   CASE WHEN s.row_no % 41 < 40 THEN s.row_no % 41 END AS owner_id, s.row_no // 500 AS hour
            FROM _spred s JOIN _typed t USING (row_no))"""


def _owned_sql(keys: str) -> str:
    return f"""WITH {SCORE_CTES}, {_OWNED}
SELECT owner_id, batch_id, prediction_id, round(probability, 6) AS probability,
       row_number() OVER w AS rank, (row_number() OVER w - 1) // {PAGE_SIZE} + 1 AS page, count(*) OVER (PARTITION BY {keys}) AS total,
       (count(*) OVER (PARTITION BY {keys}) - 1) // {PAGE_SIZE} + 1 AS total_pages
FROM _owned WINDOW w AS (PARTITION BY {keys} ORDER BY hour, prediction_id)"""


def owned_predictions(spark, sf_dir):
    p = predictions(spark, sf_dir)
    n = F.col("row_no")
    return p.select(n.alias("prediction_id"), r("probability").alias("probability"), F.when(F.col("contract") != "", F.col("contract")).alias("batch_id"),
                    F.when(n % 41 < 40, n % 41).alias("owner_id"), F.timestamp_seconds(F.floor(n / 500) * 3600).alias("created_at"))


@register("x12_owner_batches", _owned_sql("owner_id, batch_id"), ("churn_base", "churn_raw"))
def x12_batches(spark, sf_dir):
    """Every owner's pages of every batch."""
    return X.owned_pages(owned_predictions(spark, sf_dir), PAGE_SIZE).drop("created_at")


@register("x12_owner_history", _owned_sql("owner_id"), ("churn_base", "churn_raw"))
def x12_history(spark, sf_dir):
    """Every owner's whole history, whatever the batch."""
    return X.owned_pages(owned_predictions(spark, sf_dir), PAGE_SIZE, by_batch=False).drop("created_at")


@register("x13_export_rows", f"""WITH {SCORE_CTES}
SELECT CAST(t.row_no AS VARCHAR) AS row_no, {', '.join(f"coalesce({export_sql(c)}, '') AS {c}" for c in SCORE_TYPED)},
  printf('%.2f', s.probability) AS "Churn_Probability",
  CASE WHEN s.probability >= 0.5 THEN 'Yes' ELSE 'No' END AS "Churn_Prediction"
FROM _typed t JOIN _spred s USING (row_no)""", ("churn_base", "churn_raw"))
def x13(spark, sf_dir):
    typed = typed_scoring_rows(spark, sf_dir)
    cols = SCORE_TYPED
    p = predictions(spark, sf_dir).select("row_no", "probability", "prediction")
    j = typed.select("row_no", *cols).join(p, "row_no")
    out = X.export_rows(j, cols)
    return out


@register("x14_risk_band", f"""WITH {SCORE_CTES}
SELECT row_no, round(probability, 6) AS probability,
  CASE WHEN probability < 0.3 THEN 'Low Risk' WHEN probability < 0.7 THEN 'Medium Risk' ELSE 'High Risk' END AS band,
  CASE WHEN probability < 0.3 THEN '{X.RISK_TEXT['Low Risk']}' WHEN probability < 0.7 THEN '{X.RISK_TEXT['Medium Risk']}'
       ELSE '{X.RISK_TEXT['High Risk']}' END AS advice FROM _spred""", ("churn_base", "churn_raw"))
def x14(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return p.select("row_no", r("probability").alias("probability"), X.risk_band(F.col("probability")).alias("band"),
                    X.risk_advice(F.col("probability")).alias("advice"))


@register("x15_same_input_reuse", f"""WITH {SCORE_CTES},
_g AS (SELECT row_no, min(row_no) OVER (PARTITION BY {', '.join(SCORE_TYPED)}) AS first_row FROM _typed)
SELECT row_no, first_row, round(probability, 6) AS probability, row_no <> first_row AS reused
FROM _g JOIN _spred USING (row_no)""", ("churn_base", "churn_raw"))
def x15(spark, sf_dir):
    m, _ = fitted(spark, sf_dir)
    nb = naive_bayes(spark, sf_dir)
    typed = typed_scoring_rows(spark, sf_dir)
    s = X.score_once(typed, m, nb, "row_no", SCORE_TYPED)
    return s.select("row_no", "first_row", r("probability").alias("probability"), "reused")


# ---- dashboard and report ---------------------------------------------------

@register("d1_kpis", f"""WITH {SCORE_CTES}
SELECT count(*) AS total_customers, CAST(count_if(churn) AS BIGINT) AS churned_count,
       CAST(count(*) - count_if(churn) AS BIGINT) AS retained_count,
       round(count_if(churn) * 100.0 / count(*), 2) AS churn_rate,
       CAST((SELECT count_if(probability > 0.7) FROM _spred) AS BIGINT) AS at_risk_count FROM churn_base""",
          ("churn_base", "churn_raw"))
def d1(spark, sf_dir):
    return D.kpis(churn_base(spark, sf_dir), predictions(spark, sf_dir))


@register("d2_churn_distribution", """
SELECT 'churned' AS status, CAST(count_if(churn) AS BIGINT) AS count, round(count_if(churn) * 100.0 / count(*), 6) AS share_percent FROM churn_base
UNION ALL SELECT 'retained', CAST(count(*) - count_if(churn) AS BIGINT), round((count(*) - count_if(churn)) * 100.0 / count(*), 6) FROM churn_base""",
          ("churn_base",))
def d2(spark, sf_dir):
    return D.churn_distribution(churn_base(spark, sf_dir)).withColumn("share_percent", r("share_percent"))


@register("d3_monthly_trend", """
WITH _e AS (SELECT max(created_at) AS e FROM churn_base)
SELECT strftime(date_trunc('month', created_at), '%Y-%m') AS month, CAST(count_if(churn) AS BIGINT) AS churn_count,
       count(*) AS total_count, round(count_if(churn) * 100.0 / count(*), 2) AS churn_rate
FROM churn_base, _e WHERE created_at >= e - INTERVAL 360 DAY AND created_at <= e GROUP BY 1""", ("churn_base",))
def d3(spark, sf_dir):
    return D.monthly_trend(churn_base(spark, sf_dir), "created_at", months=12)


@register("d4_at_risk", f"""WITH {SCORE_CTES}
SELECT coalesce(t.contract, '') AS owner, CAST(count_if(probability > 0.7) AS BIGINT) AS at_risk_count
FROM _spred s JOIN _typed t USING (row_no) GROUP BY 1""", ("churn_base", "churn_raw"))
def d4(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("owner", F.coalesce("contract", F.lit("")))
    return D.at_risk(p, owner="owner")


@register("d5_rate_band", """
SELECT round(count_if(churn) * 100.0 / count(*), 2) AS churn_rate,
  CASE WHEN round(count_if(churn) * 100.0 / count(*), 2) < 20 THEN 'Low Risk'
       WHEN round(count_if(churn) * 100.0 / count(*), 2) < 30 THEN 'Medium Risk' ELSE 'High Risk' END AS badge
FROM churn_base""", ("churn_base",))
def d5(spark, sf_dir):
    k = churn_base(spark, sf_dir).agg(F.round(F.count_if("churn") * 100.0 / F.count(F.lit(1)), 2).alias("churn_rate"))
    return k.select("churn_rate", D.rate_band(F.col("churn_rate")).alias("badge"))


@register("r1_report_summary", f"""WITH {NB_CTES},
_cc AS (SELECT count_if(label = 1 AND pred = 1) AS tp, count_if(label = 0 AND pred = 1) AS fp,
               count_if(label = 1 AND pred = 0) AS fn, count_if(label = 0 AND pred = 0) AS tn FROM _pred),
_mt AS (SELECT CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0 END AS accuracy,
               CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
               CASE WHEN tp + fp > 0 AND tp + fn > 0 AND tp > 0
                    THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) ELSE 0 END AS f1
        FROM _cc),
_scs AS (SELECT probability AS score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM _pred GROUP BY 1),
_cn AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM _scs),
_auc AS (SELECT sum(pos * (cum_neg - neg + 0.5 * neg)) / (sum(pos) * sum(neg)) AS roc_auc FROM _cn)
SELECT 'Total Customers' AS metric, format('{{:,}}', count(*)) AS value FROM churn_base
UNION ALL SELECT 'Churn Rate', printf('%.2f', CAST(round(CAST(count_if(churn) * 100.0 / count(*) AS DECIMAL(38,10)), 2) AS DOUBLE)) || '%' FROM churn_base
UNION ALL SELECT 'Accuracy', printf('%.4f', CAST(round(CAST(accuracy AS DECIMAL(38,10)), 4) AS DOUBLE)) FROM _mt
UNION ALL SELECT 'Precision', printf('%.4f', CAST(round(CAST(precision AS DECIMAL(38,10)), 4) AS DOUBLE)) FROM _mt
UNION ALL SELECT 'Recall', printf('%.4f', CAST(round(CAST(recall AS DECIMAL(38,10)), 4) AS DOUBLE)) FROM _mt
UNION ALL SELECT 'F1-Score', printf('%.4f', CAST(round(CAST(f1 AS DECIMAL(38,10)), 4) AS DOUBLE)) FROM _mt
UNION ALL SELECT 'ROC-AUC', printf('%.4f', CAST(round(CAST(roc_auc AS DECIMAL(38,10)), 4) AS DOUBLE)) FROM _auc""",
          ("churn_base",))
def r1(spark, sf_dir):
    p = test_predictions(spark, sf_dir)
    return D.report_summary(churn_base(spark, sf_dir), M.classification_metrics(p), M.roc_auc(p))
