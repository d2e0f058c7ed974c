"""Data-quality aggregates (Q1..Q10) over a typed customer table.

Q1, Q3 and the row count come from one aggregate pass; Q2 needs the exact
quartiles first (``exact_quantiles``) and then one counting pass.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import quantile_row, to_long
from tidemark.roles import Roles

# Fixed value: Python float() accepts these spellings (case-insensitive).
NUMERIC_TEXT = r"^\s*[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?([eE][+-]?\d+(_\d+)*)?|\.\d+(_\d+)*([eE][+-]?\d+(_\d+)*)?|inf|infinity|nan)\s*$"


def is_numeric_text(c):
    """True when Python's ``float(c)`` would succeed."""
    return F.lower(c).rlike(NUMERIC_TEXT)


def missing_counts(df: DataFrame, roles: Roles) -> DataFrame:
    """Q1: (column, missing_count) for every quality column; one pass."""
    cols = list(roles.quality_columns)
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "missing_count")


def iqr_bounds(df: DataFrame, cols) -> DataFrame:
    """(column, q1, q3, lower, upper) with linear-interpolated quartiles."""
    q = quantile_row(to_long(df, cols), [0.25, 0.75], ["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    return q.select("column", "q1", "q3", (F.col("q1") - 1.5 * iqr).alias("lower"),
                    (F.col("q3") + 1.5 * iqr).alias("upper"))


def iqr_outliers(df: DataFrame, roles: Roles) -> DataFrame:
    """Q2: values strictly outside [q1-1.5iqr, q3+1.5iqr]; percent of all
    records, 2 decimals; a column with no values gives 0."""
    cols = list(roles.numeric)
    b = iqr_bounds(df, cols)
    long = to_long(df, cols)
    # one row per numeric column: bounded broadcast
    flagged = long.join(F.broadcast(b), "column", "left").groupBy("column").agg(
        F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).alias("outlier_count"))
    total = df.select(F.count(F.lit(1))).scalar()
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return (names.join(flagged, "column", "left")
            .select("column", F.coalesce("outlier_count", F.lit(0)).cast("long").alias("outlier_count"))
            .withColumn("outlier_percentage",
                        F.round(F.coalesce(F.try_divide(F.col("outlier_count") * 100.0, total), F.lit(0.0)), 2)))


def invalid_categorical(df: DataFrame, roles: Roles) -> DataFrame:
    """Q3: per categorical column the count of present values outside the
    domain and the sorted distinct offenders ('|'-joined).  Values are not
    trimmed here (they were stored untrimmed)."""
    cols = [c for c in roles.categorical if c in roles.domains]
    aggs = []
    for c in cols:
        bad = F.col(c).isNotNull() & ~F.col(c).isin(list(roles.domains[c]))
        aggs.append(F.count_if(bad).alias(f"n_{c}"))
        aggs.append(F.array_join(F.sort_array(F.collect_set(F.when(bad, F.col(c)))), "|").alias(f"v_{c}"))
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("invalid_count"),
                                        F.col(f"v_{c}").alias("invalid_values")) for c in cols]))
    return one.select(rows.alias("x")).select("x.*")


def invalid_values(df: DataFrame, roles: Roles) -> DataFrame:
    """Q3 as rows: ``(column, value, rows)`` per value outside its column's domain, however many there are."""
    cols = [c for c in roles.categorical if c in roles.domains]
    bad = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(list(roles.domains[c])), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c in cols]
    return (df.select(F.explode(F.array_compact(F.array(*bad))).alias("b")).groupBy("b.column", "b.value").agg(F.count(F.lit(1)).alias("rows")))


def convertibility(raw: DataFrame, col: str = "TotalCharges", row_col: str = "row_no") -> DataFrame:
    """Q4: raw-string rows whose value is neither blank nor a number."""
    v = F.col(col)
    return raw.where(v.isNotNull() & (F.trim(v) != "") & ~is_numeric_text(v)).select(
        row_col, v.alias("value"))


def negative_values(df: DataFrame, id_col: str, cols=("monthly_charges", "tenure")) -> DataFrame:
    """Q5: one row per (column, id) with a negative value."""
    parts = [df.where(F.col(c) < 0).select(F.lit(c).alias("column"), F.col(id_col).alias(id_col))
             for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quality_score(df: DataFrame, roles: Roles) -> DataFrame:
    """Q6..Q8: completeness, validity and their mean, 2 decimals.

    The input is read once for row, missing and invalid counts and again by
    the quartile and outlier passes, each time only the columns needed."""
    qc = list(roles.quality_columns)
    cats = [c for c in roles.categorical if c in roles.domains]
    d = df.select(*dict.fromkeys(qc + list(roles.numeric)))
    missing = sum((F.count_if(F.col(c).isNull()) for c in qc), F.lit(0))
    invalid = sum((F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(list(roles.domains[c]))) for c in cats),
                  F.lit(0))
    one = d.agg(F.count(F.lit(1)).alias("n"), missing.alias("missing"), invalid.alias("invalid"))
    outl = iqr_outliers(d, roles).agg(F.sum("outlier_count")).scalar()
    nq, nv = len(qc), len(roles.numeric) + len(cats)
    n = F.col("n")
    completeness = (n * nq - F.col("missing")) * 100.0 / (n * nq)
    validity = (n * nv - outl - F.col("invalid")) * 100.0 / (n * nv)
    return one.select(
        n.alias("total_records"),
        F.round(completeness, 2).alias("completeness_score"),
        F.round(validity, 2).alias("validity_score"),
        F.round(completeness * 0.5 + validity * 0.5, 2).alias("quality_score"))


def score_band(score) -> F.Column:
    """Q9 band: above 80, at least 70, else."""
    return F.when(score > 80, "good").when(score >= 70, "fair").otherwise("poor")


def issue_totals(df: DataFrame, roles: Roles) -> DataFrame:
    """Q9: total per issue kind plus the band of the quality score."""
    miss = missing_counts(df, roles).agg(F.sum("missing_count").alias("n")).select(F.lit("Missing Values").alias("category"), "n")
    outl = iqr_outliers(df, roles).agg(F.sum("outlier_count").alias("n")).select(F.lit("Outliers").alias("category"), "n")
    inv = invalid_categorical(df, roles).agg(F.sum("invalid_count").alias("n")).select(F.lit("Invalid Categorical").alias("category"), "n")
    qs = quality_score(df, roles).select("quality_score").scalar()
    return (miss.unionByName(outl).unionByName(inv)
            .select("category", F.col("n").cast("long").alias("count"), score_band(qs).alias("band")))


def issue_ranking(df: DataFrame, roles: Roles) -> DataFrame:
    """Q10: columns with missing values, count descending, percent of rows."""
    total = df.select(F.count(F.lit(1))).scalar()
    m = missing_counts(df, roles).where(F.col("missing_count") > 0)
    return m.select("column", "missing_count",
                    F.round(F.col("missing_count") * 100.0 / total, 2).alias("missing_percentage"))
