"""Dashboard and report aggregates (D1..D5, R1)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.roles import AT_RISK_PROBABILITY


def kpis(customers: DataFrame, predictions: DataFrame, label: str = "churn",
         prob: str = "probability") -> DataFrame:
    """Customers, churned, retained (null labels count as retained),
    churn rate in percent (2 decimals) and at-risk predictions (p > 0.70,
    counting predictions, not customers); zeros when empty."""
    at_risk = predictions.select(F.count_if(F.col(prob) > AT_RISK_PROBABILITY)).scalar()
    c = customers.agg(F.count(F.lit(1)).alias("total_customers"),
                      F.count_if(F.col(label)).alias("churned_count"))
    return c.select("total_customers", "churned_count",
                    (F.col("total_customers") - F.col("churned_count")).alias("retained_count"),
                    F.coalesce(F.round(F.try_divide(F.col("churned_count") * 100.0, F.col("total_customers")), 2),
                               F.lit(0.0)).alias("churn_rate"),
                    at_risk.alias("at_risk_count"))


def churn_distribution(customers: DataFrame, label: str = "churn") -> DataFrame:
    """Churned and retained with their share of the total."""
    c = customers.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label)).alias("churned"))
    rows = F.explode(F.array(F.struct(F.lit("churned").alias("status"), F.col("churned").alias("count")),
                             F.struct(F.lit("retained").alias("status"), (F.col("n") - F.col("churned")).alias("count"))))
    return c.select("n", rows.alias("x")).select(
        "x.status", "x.count", F.try_divide(F.col("x.count") * 100.0, F.col("n")).alias("share_percent"))


def monthly_trend(customers: DataFrame, time_col: str, label: str = "churn", months: int = 12,
                  as_of: Column | None = None) -> DataFrame:
    """D3: months*30 days back from ``as_of`` (default: the newest record),
    grouped by calendar month of the record time; total, churned, rate."""
    end = as_of if as_of is not None else customers.select(F.max(time_col)).scalar()
    start = end - F.expr(f"INTERVAL {months * 30} DAYS")
    t = F.col(time_col)
    d = customers.where((t >= start) & (t <= end))
    g = d.groupBy(F.date_trunc("month", t).alias("_m")).agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(F.col(label)).alias("churn_count"))
    return g.select(F.date_format("_m", "yyyy-MM").alias("month"), "churn_count", "total_count",
                    F.round(F.col("churn_count") * 100.0 / F.col("total_count"), 2).alias("churn_rate"))


def at_risk(predictions: DataFrame, prob: str = "probability", owner: str | None = None) -> DataFrame:
    """Predictions above 0.70 (strict), per owner when given."""
    hit = F.count_if(F.col(prob) > AT_RISK_PROBABILITY).alias("at_risk_count")
    if owner:
        return predictions.groupBy(owner).agg(hit)
    return predictions.agg(hit)


def rate_band(rate: Column) -> Column:
    """Churn-rate badge, below 20, below 30, else."""
    return F.when(rate < 20, "Low Risk").when(rate < 30, "Medium Risk").otherwise("High Risk")


def report_summary(customers: DataFrame, metrics: DataFrame, auc: DataFrame, label: str = "churn") -> DataFrame:
    """The report's summary and metric rows as (metric, value) text:
    total customers with thousands separators, churn rate with 2 decimals
    and a percent sign, model metrics with 4 decimals."""
    from tidemark.functions.stats import round_half_up
    c = customers.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label)).alias("k"))
    rate = F.coalesce(F.try_divide(F.col("k") * 100.0, F.col("n")), F.lit(0.0))
    ds = c.select(F.explode(F.array(
        F.struct(F.lit("Total Customers").alias("metric"), F.format_number(F.col("n"), 0).alias("value")),
        F.struct(F.lit("Churn Rate").alias("metric"),
                 F.concat(F.format_string("%.2f", round_half_up(rate, 2)), F.lit("%")).alias("value")))).alias("x")
    ).select("x.*")
    m = metrics.select("accuracy", "precision", "recall", "f1", auc.select("roc_auc").scalar().alias("roc_auc"))
    ms = m.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.format_string("%.4f", round_half_up(F.col(col), 4)).alias("value"))
        for name, col in (("Accuracy", "accuracy"), ("Precision", "precision"), ("Recall", "recall"),
                          ("F1-Score", "f1"), ("ROC-AUC", "roc_auc"))])).alias("x")).select("x.*")
    return ds.unionByName(ms)
