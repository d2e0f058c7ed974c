"""Exploratory statistics (E1..E15).  All are aggregates with a bounded
result; none pulls rows to the driver."""
from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import exact_quantiles, quantile_row, to_long

HIST_MIN_BINS, HIST_MAX_BINS = 5, 50   # fixed value: allowed bin counts


def complete_rows(df: DataFrame, cols) -> DataFrame:
    """Listwise deletion, as pandas ``dropna`` over the given columns."""
    return df.dropna(how="any", subset=list(cols))


def correlation_matrix(df: DataFrame, cols) -> DataFrame:
    """Pearson matrix in long form (feature_x, feature_y, correlation,
    record_count) on rows complete in all ``cols``.  Constant columns give
    null (pandas gives NaN) instead of a division error."""
    d = complete_rows(df.select(*cols), cols)
    pairs = list(combinations_with_replacement(cols, 2))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, (a, b) in enumerate(pairs):
        aggs.append(F.try_divide(F.covar_pop(a, b),
                                 F.stddev_pop(a) * F.stddev_pop(b)).alias(f"_r{i}"))
    one = d.agg(*aggs)
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows.append(F.struct(F.lit(a).alias("feature_x"), F.lit(b).alias("feature_y"),
                             F.col(f"_r{i}").alias("correlation")))
        if a != b:
            rows.append(F.struct(F.lit(b).alias("feature_x"), F.lit(a).alias("feature_y"),
                                 F.col(f"_r{i}").alias("correlation")))
    return (one.select(F.col("_n").alias("record_count"), F.explode(F.array(*rows)).alias("x"))
            .where(F.col("record_count") > 0)
            .select("x.*", "record_count"))


def histogram(df: DataFrame, cols, bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max] per column, last bin closed, empty
    bins kept; rows are the complete cases over ``cols``."""
    if not HIST_MIN_BINS <= bins <= HIST_MAX_BINS:
        raise ValueError(f"bins must be in {HIST_MIN_BINS}..{HIST_MAX_BINS}")
    long = to_long(complete_rows(df.select(*cols), cols), cols, "feature")
    rng = long.groupBy("feature").agg(F.min("value").alias("_mn"), F.max("value").alias("_mx"))
    # numpy widens an empty range by 0.5 on each side
    lo = F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn"))
    hi = F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx"))
    edges = rng.select("feature", lo.alias("_lo"), hi.alias("_hi"))
    idx = F.least(F.floor((F.col("value") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))),
                  F.lit(bins - 1)).cast("int")
    # one row per column: bounded broadcast
    counts = (long.join(F.broadcast(edges), "feature").select("feature", idx.alias("bin"))
              .groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("frequency")))
    width = (F.col("_hi") - F.col("_lo")) / bins
    grid = edges.select("feature", "_lo", "_hi",
                        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(counts, ["feature", "bin"], "left")
            .select("feature", "bin",
                    (F.col("_lo") + F.col("bin") * width).alias("bin_lower"),
                    F.when(F.col("bin") == bins - 1, F.col("_hi"))
                    .otherwise(F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_upper"),
                    F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency")))


def distribution_stats(df: DataFrame, cols) -> DataFrame:
    """Min, max, mean, median per column on the complete cases."""
    long = to_long(complete_rows(df.select(*cols), cols), cols, "feature")
    basic = long.groupBy("feature").agg(F.min("value").alias("min"), F.max("value").alias("max"),
                                        F.avg("value").alias("mean"))
    med = quantile_row(long, [0.5], ["median"], key="feature")
    return basic.join(med, "feature")


def churn_by(df: DataFrame, group_col: str, label: str = "churn") -> DataFrame:
    """Churn rate, total and churned per group; rows where both the
    group and the label are present; one shuffle with map-side combine."""
    d = df.where(F.col(group_col).isNotNull() & F.col(label).isNotNull())
    return (d.groupBy(F.col(group_col).alias("segment"))
            .agg(F.count(F.lit(1)).alias("total_customers"),
                 F.count_if(F.col(label)).alias("churned_customers"))
            .withColumn("churn_rate", F.col("churned_customers") / F.col("total_customers")))


def churn_summary(df: DataFrame, group_col: str, label: str = "churn") -> DataFrame:
    """Totals over the grouped result (same rows as E4), one pass."""
    d = df.where(F.col(group_col).isNotNull() & F.col(label).isNotNull())
    return d.agg(F.count(F.lit(1)).alias("total_customers"),
                 F.count_if(F.col(label)).alias("churned_customers")).select(
        "total_customers", "churned_customers",
        (F.col("total_customers") - F.col("churned_customers")).alias("retained_customers"),
        F.try_divide(F.col("churned_customers"), F.col("total_customers")).alias("churn_rate"))


def scatter(df: DataFrame, x: str, y: str, label: str, id_col: str) -> DataFrame:
    """Every complete (x, y, label) point."""
    return complete_rows(df.select(id_col, x, y, label), [x, y, label])


def scatter_split(df: DataFrame, x: str, y: str, label: str, id_col: str) -> DataFrame:
    """The same points with a series name per label value."""
    return scatter(df, x, y, label, id_col).withColumn(
        "series", F.when(F.col(label), F.lit("churned")).otherwise(F.lit("retained")))


def standardize(df: DataFrame, cols, keep=()) -> DataFrame:
    """z-score with population std (zero std gives scale 1)."""
    # scalar subqueries over one aggregate; Catalyst merges them into one job
    outs = []
    for c in cols:
        m = df.select(F.avg(c)).scalar()
        sd = df.select(F.stddev_pop(c)).scalar()
        s = F.when(sd == 0, F.lit(1.0)).otherwise(sd)
        outs.append(((F.col(c) - m) / s).alias(c))
    return df.select(*keep, *outs)


def pca_projection(df: DataFrame, cols, k: int, keep=()) -> DataFrame:
    """Z-score then PCA to ``k`` components (MLlib); components past the
    rank are padded with 0; the sign is fixed so the largest loading is
    positive.  Needs at least two complete rows."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    d = complete_rows(df.select(*keep, *cols), cols)
    z = standardize(d, cols, keep)
    vec = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(z)
    kk = min(k, len(cols))
    model = PCA(k=kk, inputCol="_v", outputCol="_pc").fit(vec)
    pcm = model.pc.toArray()                       # d x k loadings, small
    signs = [1.0 if pcm[abs(pcm[:, j]).argmax(), j] >= 0 else -1.0 for j in range(kk)]
    t = model.transform(vec).withColumn("_a", vector_to_array("_pc"))
    outs = [(F.col("_a")[j] * signs[j]).alias(f"pc{j + 1}") if j < kk else F.lit(0.0).alias(f"pc{j + 1}")
            for j in range(k)]
    return t.select(*keep, *outs)


def explained_variance(df: DataFrame, cols, k: int) -> DataFrame:
    """Explained variance ratio per component, zero padded to ``k``."""
    from pyspark.ml.feature import PCA, VectorAssembler
    d = complete_rows(df.select(*cols), cols)
    z = standardize(d, cols)
    vec = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(z)
    kk = min(k, len(cols))
    ev = list(PCA(k=kk, inputCol="_v", outputCol="_pc").fit(vec).explainedVariance.toArray())
    ev += [0.0] * (k - len(ev))
    spark = df.sparkSession
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(ev)],
                                 "component int, explained_variance_ratio double")


def numeric_stats(df: DataFrame, cols, digits: int = 2) -> DataFrame:
    """Count, mean, median, population std, min, max, q1, q3 per column
    over that column's non-null rows, rounded to ``digits`` (2 in the
    reference).  Interpolated quartiles of cent values often end in an exact
    half cent, where engines round ties differently; cross-engine checks
    therefore compare at 6 digits."""
    long = to_long(df, cols)
    basic = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    qs = quantile_row(long, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    j = basic.join(qs, "column")
    return j.select("column", "count", *[F.round(c, digits).alias(c) for c in
                                         ("mean", "median", "std", "min", "max", "q1", "q3")])


def categorical_counts(df: DataFrame, cols) -> DataFrame:
    """Per (column, value): count, plus the column's non-null and
    distinct counts.  One unpivot and one grouped count."""
    long = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([], list(cols), "column", "value").where(F.col("value").isNotNull()))
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("column")   # at most distinct(value) rows per column
    return vc.select("column", "value", "count",
                     F.sum("count").over(w).alias("non_null_count"),
                     F.count(F.lit(1)).over(w).alias("distinct_count"))


def paginate(df: DataFrame, order_cols, page: int, size: int) -> DataFrame:
    """One page in a stable id order, with totals and navigation flags.
    Page size is capped at 1000 as in the reference."""
    size = max(1, min(int(size), 1000))
    page = max(1, int(page))
    total = df.select(F.count(F.lit(1))).scalar()
    body = df.orderBy(*order_cols).offset((page - 1) * size).limit(size)
    pages = F.ceil(total / F.lit(size))
    return body.select("*", total.alias("total_records"), F.lit(page).alias("page"),
                       F.lit(size).alias("page_size"), pages.cast("long").alias("total_pages"),
                       (F.lit(page) < pages).alias("has_next"),
                       F.lit(page > 1).alias("has_previous"))


def correlation_band(c: Column) -> Column:
    """Five bands, strictly above 0.7, 0.3, -0.3, -0.7."""
    return (F.when(c > 0.7, "strong positive").when(c > 0.3, "moderate positive")
            .when(c > -0.3, "weak").when(c > -0.7, "moderate negative")
            .otherwise("strong negative"))


def bin_label(lo: Column, hi: Column) -> Column:
    """E15: "lo-hi" label with whole numbers (half away from zero)."""
    def whole(x):
        return F.round(x, 0).cast("long").cast("string")
    return F.concat_ws("-", whole(lo), whole(hi))


def paginate_keyset(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """E13 for deep pages: rows with ``key`` greater than the cursor, in key
    order.  The cursor is a filter Catalyst pushes into the scan and each
    task keeps at most ``size`` rows, whereas an OFFSET makes every task
    keep offset + size rows.  Adds ``next_cursor`` (null on the last page)."""
    size = max(1, min(int(size), 1000))
    page = df.where(F.col(key) > F.lit(after)).orderBy(key).limit(size + 1)
    w = Window.orderBy(key)          # at most size + 1 rows after the limit
    ranked = page.withColumn("_i", F.row_number().over(w))
    more = ranked.select(F.max("_i")).scalar() > F.lit(size)
    kept = ranked.where(F.col("_i") <= size)
    last = kept.select(F.max(key)).scalar()
    return kept.drop("_i").withColumn("next_cursor", F.when(more, last))
