"""Batch scoring and explanations (X1..X15).

Scoring is one projection: fitted preprocessing literals + the model as a
column expression.  Explanations stay per row as arrays (one struct per
feature), so ranking the top contributors or building a waterfall needs
array functions, not a shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import ordered_prefix
from tidemark.operators import prep
from tidemark.operators.models import NaiveBayes, qc
from tidemark.roles import TOP_CONTRIBUTORS

SIGNAL_EPS = 1e-6        # fixed values: explanation validity check
SUM_TOLERANCE = 0.05
RESCALE_EPS = 1e-9

# Risk bands and advice shown with a prediction.
RISK_LOW, RISK_HIGH = 0.30, 0.70
RISK_TEXT = {
    "Low Risk": "Low churn risk. Continue standard engagement and monitor for changes.",
    "Medium Risk": "Medium churn risk. Consider proactive engagement — personalized offers or check-in calls.",
    "High Risk": "High churn risk. Immediate retention action recommended — dedicated account management or special offers.",
}


def batch_score(scaled: DataFrame, nb: NaiveBayes, keep=(), threshold: float = 0.5) -> DataFrame:
    """X1..X3: probability of churn, clipped to [0, 1], and churn when
    p >= threshold (inclusive)."""
    p = F.least(F.greatest(nb.probability(), F.lit(0.0)), F.lit(1.0))
    return scaled.select(*keep, *[qc(f) for f in nb.features], p.alias("probability")).withColumn(
        "prediction", F.col("probability") >= F.lit(threshold))


CONTRIB_TYPE = "array<struct<feature:string,value:double,contribution:double>>"


def local_contributions(scaled: DataFrame, nb: NaiveBayes, keep=()) -> DataFrame:
    """For each feature i, p(baseline with only x_i set) - p(baseline);
    baseline is the all-zero row in scaled space (the training mean).
    Rescaled so they sum to p - base when |raw sum| > 1e-9.

    Evaluated with NumPy over Arrow batches (``mapInPandas``): the d
    perturbed scores per row are closed form for naive Bayes, and a column
    expression of them grows as d^2 after Catalyst inlines it.  The fitted
    parameters (4*d numbers) travel in the closure.  Output adds
    ``probability``, ``base_value`` and ``contributions``."""
    import numpy as np
    fs = list(nb.features)
    keep = list(keep)
    m0 = np.array([nb.means[(0, f)] for f in fs])
    m1 = np.array([nb.means[(1, f)] for f in fs])
    v0 = np.array([nb.vars[(0, f)] for f in fs])
    v1 = np.array([nb.vars[(1, f)] for f in fs])
    lp0, lp1 = np.log(nb.priors[0]), np.log(nb.priors[1])

    def terms(x, m, v):
        return -0.5 * np.log(2 * np.pi * v) - (x - m) ** 2 / (2 * v)

    def sig(d):                                  # P(class 1) from d = jll0 - jll1
        return np.where(d > 0, np.exp(-np.abs(d)) / (1 + np.exp(-np.abs(d))), 1 / (1 + np.exp(-np.abs(d))))

    t00, t10 = terms(0.0, m0, v0), terms(0.0, m1, v1)
    bd = (lp0 + t00.sum()) - (lp1 + t10.sum())
    pb = float(sig(np.array(bd)))

    def run(batches):
        import pandas as pd
        for pdf in batches:
            x = pdf[fs].to_numpy(dtype=float)
            t0, t1 = terms(x, m0, v0), terms(x, m1, v1)
            p = sig((lp0 + t0.sum(axis=1)) - (lp1 + t1.sum(axis=1)))
            raw = sig(bd - (t00 - t0) + (t10 - t1)) - pb
            tot = raw.sum(axis=1)
            scale = np.where(np.abs(tot) > RESCALE_EPS, (p - pb) / np.where(tot == 0, 1.0, tot), 1.0)
            c = raw * scale[:, None]
            out = pdf[keep].copy()
            out["probability"] = p
            out["base_value"] = pb
            out["_x"], out["_c"] = list(x), list(c)           # a vector per row
            yield out
    types = dict(scaled.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep]
                       + ["probability double", "base_value double", "_x array<double>", "_c array<double>"])
    found = scaled.select(*keep, *[qc(f) for f in fs]).mapInPandas(run, schema)
    names = F.array(*[F.lit(f) for f in fs])
    parts = F.zip_with(F.arrays_zip(names.alias("feature"), F.col("_x").alias("value")), F.col("_c"), lambda p, c: F.struct(
        p["feature"].alias("feature"), p["value"].alias("value"), c.alias("contribution")))
    return found.withColumn("contributions", parts.cast(CONTRIB_TYPE)).drop("_x", "_c")


def _mag(s) -> Column:
    """Sort magnitude: |contribution| at 9 decimals, so float noise between
    engines cannot reorder near-equal contributions (ties go by name)."""
    return F.abs(F.round(s["contribution"], 9))


def by_magnitude(arr: Column) -> Column:
    """Contributions sorted by |contribution| descending, then feature name:
    natural ordering of a (-|c|, feature) key, no comparator lambda."""
    keyed = F.transform(arr, lambda s: F.struct((-_mag(s)).alias("k"), s["feature"].alias("f"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda t: t["s"])


def top_contributors(expl: DataFrame, keep=(), k: int = TOP_CONTRIBUTORS) -> DataFrame:
    """Contributions sorted by absolute value; top ``k`` positive and
    top ``k`` negative; zero goes to neither.  Array functions per row."""
    srt = by_magnitude(F.col("contributions"))
    pos = F.slice(F.filter(srt, lambda s: s["contribution"] > 0), 1, k)
    neg = F.slice(F.filter(srt, lambda s: s["contribution"] < 0), 1, k)
    return expl.select(*keep, "probability", "base_value", pos.alias("top_positive"), neg.alias("top_negative"))


def waterfall(expl: DataFrame, id_col: str) -> DataFrame:
    """Base bar, contributions by |value| descending with running
    totals, final bar.  Running totals are folded inside the row's array: no shuffle."""
    d = expl.select(id_col, "base_value", "probability", by_magnitude(F.col("contributions")).alias("_s"))
    bar = "struct<label:string,start:double,end:double>"
    none = F.array().cast(f"array<{bar}>")

    def step(acc, c):
        end = acc["at"] + c["contribution"]
        return F.struct(end.alias("at"), F.concat(acc["bars"], F.array(F.struct(c["feature"].alias("label"), acc["at"].alias("start"), end.alias("end")))).alias("bars"))

    folded = F.aggregate("_s", F.struct(F.col("base_value").alias("at"), none.alias("bars")), step, lambda a: a["bars"])
    ends = [F.array(F.struct(F.lit(t).alias("label"), F.lit(0.0).alias("start"), F.col(c).alias("end")))
            for t, c in (("Base value", "base_value"), ("Prediction", "probability"))]
    bars = F.concat(ends[0], folded, ends[1])
    return d.select(id_col, F.posexplode(bars).alias("step", "b")).select(id_col, "step", "b.label", "b.start", "b.end")


def risk_band(p: Column) -> Column:
    """Below 30 %, below 70 %, else."""
    return F.when(p < RISK_LOW, "Low Risk").when(p < RISK_HIGH, "Medium Risk").otherwise("High Risk")


def risk_advice(p: Column) -> Column:
    return (F.when(p < RISK_LOW, RISK_TEXT["Low Risk"]).when(p < RISK_HIGH, RISK_TEXT["Medium Risk"])
            .otherwise(RISK_TEXT["High Risk"]))


def input_hash(cols) -> Column:
    """SHA-256 of the sorted-key JSON of the input fields."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])), 256)


def score_once(typed: DataFrame, m: prep.PrepModel, nb: NaiveBayes, id_col: str, input_cols) -> DataFrame:
    """Identical inputs are scored once and joined back.

    One grouping gives each input's first row, one join takes the result back;
    an input with many rows meets its one scored row, so AQE can split it."""
    h = typed.withColumn("_h", input_hash(input_cols))
    uniq = h.groupBy("_h").agg(F.min(id_col).alias("_first"), *[F.first(c).alias(c) for c in input_cols])
    z = prep.apply_to_new_rows(uniq, m, keep=("_h", "_first"))
    s = batch_score(z, nb, keep=("_h", "_first")).select("_h", "_first", "probability")
    return (h.select(id_col, "_h").join(s, "_h")
            .select(id_col, F.col("_h").alias("input_hash"), F.col("_first").alias("first_row"), "probability",
                    (F.col(id_col) != F.col("_first")).alias("reused")))


def batch_pages(predictions: DataFrame, page_size: int, page: int | None = None) -> DataFrame:
    """Predictions of each batch in creation order with ``rank``, ``page``
    and ``batch_total``; all pages, or one.  Predictions without a batch (single
    ones) are listed together."""
    totals = predictions.groupBy(F.col("batch_id").alias("_batch")).agg(F.count(F.lit(1)).alias("batch_total"))
    ranked = ordered_prefix(predictions, "row_no", [], key="batch_id").withColumnRenamed("_pos", "rank")
    out = ranked.withColumn("page", F.floor((F.col("rank") - 1) / page_size) + 1).join(
        totals, F.col("batch_id").eqNullSafe(F.col("_batch"))).drop("_batch")
    return out if page is None else out.where(F.col("page") == page)


MAX_PAGE_SIZE = 100      # fixed value: most predictions on a page


def owned_pages(predictions: DataFrame, page_size: int, by_batch: bool = True, page: int | None = None) -> DataFrame:
    """Every owner's own predictions by ``created_at`` (ties by ``prediction_id``) with ``rank``,
    ``page``, ``total`` and ``total_pages``; per batch, or without the batch as the owner's history.
    Null owners and batches are lists of their own.  Filter on the owner and batch for one caller's view."""
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError("Page size must be between 1 and 100")
    if page is not None and page < 1:
        raise ValueError("Page number must be >= 1")
    keys = ["owner_id", "batch_id"] if by_batch else ["owner_id"]
    totals = predictions.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("total"))
    d = predictions.withColumn("_t", F.unix_micros(F.col("created_at").cast("timestamp")))
    ranked = ordered_prefix(d, "_t", [], key=keys, tie="prediction_id").drop("_t").withColumnRenamed("_pos", "rank")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = (ranked.withColumn("page", F.floor((F.col("rank") - 1) / page_size) + 1)
           .join(totals, same).drop(*[f"_{k}" for k in keys]).withColumn("total_pages", F.ceil(F.col("total") / page_size)))
    return out if page is None else out.where(F.col("page") == page)


def export_rows(scored: DataFrame, input_cols, order=None) -> DataFrame:
    """X13 + S6: input fields (standard order, then the probability, then
    the rest sorted), charges and probability with 2 decimals, booleans as
    Yes/No, nulls as empty strings."""
    std = [c for c in (order or input_cols) if c in input_cols]
    rest = sorted(c for c in scored.columns if c not in std and c not in ("probability", "prediction"))
    types = dict(scored.dtypes)

    def fmt(c):
        col = F.col(c)
        if types[c] == "boolean":
            e = F.when(col, "Yes").when(~col, "No")
        elif types[c] in ("double", "float"):
            e = F.format_string("%.2f", col)
        else:
            e = col.cast("string")
        return F.coalesce(F.when(col.isNotNull(), e), F.lit("")).alias(c)
    cols = [fmt(c) for c in std] + [F.coalesce(F.format_string("%.2f", F.col("probability")), F.lit("")).alias("Churn_Probability"),
                                    F.when(F.col("prediction"), "Yes").otherwise("No").alias("Churn_Prediction")]
    cols += [fmt(c) for c in rest]
    return scored.select(*cols)
