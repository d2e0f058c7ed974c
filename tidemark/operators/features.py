"""Feature ranking and construction (F1..F7).

Mutual information (plug-in estimator) needs only the contingency counts
(feature, value, label) -> n, which a grouped count with map-side combine
produces; everything after that is on a table of a few hundred rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import quantile_row, to_long, ordered_prefix
from tidemark.session import stored

MI_BINS = 10


def category_codes(df: DataFrame, cols) -> DataFrame:
    """alphabetical code per (column, value); nulls get -1 when applied."""
    long = (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([], list(cols), "column", "value").where(F.col("value").isNotNull()).distinct())
    return long.withColumn("code", (F.dense_rank().over(Window.partitionBy("column").orderBy("value")) - 1)
                           .cast("int"))


def discretised(df: DataFrame, label: str, cats, nums, bins: int = MI_BINS) -> DataFrame:
    """Long (feature, x, label) rows: categorical values as they are (null
    as '-1'), numerics median-filled and cut into equal-width bins."""
    d = df.where(F.col(label).isNotNull()).select(label, *cats, *nums)
    med = quantile_row(to_long(d, nums), [0.5], ["median"])
    # one row per numeric column: bounded, joined as a scalar per column
    fills = {c: F.coalesce(F.col(c).cast("double"),
                           med.where(F.col("column") == c).select("median").scalar()) for c in nums}
    d = d.withColumns(fills)
    parts = []
    for c in cats:
        parts.append(F.struct(F.lit(c).alias("feature"),
                              F.coalesce(F.col(c).cast("string"), F.lit("-1")).alias("x")))
    for c in nums:
        lo = d.select(F.min(c)).scalar()
        hi = d.select(F.max(c)).scalar()
        width = F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
        b = F.least(F.floor((F.col(c) - lo) * bins / width), F.lit(bins - 1)).cast("int")
        parts.append(F.struct(F.lit(c).alias("feature"), b.cast("string").alias("x")))
    return d.select(F.col(label).cast("int").alias("y"), F.explode(F.array(*parts)).alias("s")).select(
        "s.feature", "s.x", "y")


def mutual_information(df: DataFrame, label: str, cats, nums, bins: int = MI_BINS) -> DataFrame:
    """Plug-in MI (nats) of each feature with the label, from the
    contingency counts.  (feature, mutual_information)."""
    cnt = discretised(df, label, cats, nums, bins).groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    wf = Window.partitionBy("feature")          # <= values x labels rows per feature
    c = (cnt.withColumn("tot", F.sum("n").over(wf))
         .withColumn("nx", F.sum("n").over(Window.partitionBy("feature", "x")))
         .withColumn("ny", F.sum("n").over(Window.partitionBy("feature", "y"))))
    term = (F.col("n") / F.col("tot")) * F.log(F.col("n") * F.col("tot") / (F.col("nx") * F.col("ny")))
    return c.groupBy("feature").agg(F.sum(term).alias("mutual_information"))


NEIGHBOURS = 3          # fixed value: neighbours of the estimator
HALO_ROWS = 4096        # positions per slice when neighbours are looked up


def digamma(n: Column) -> Column:
    """Digamma of a positive number: asymptotic series after six recurrence steps."""
    x = n.cast("double")
    z = x + 6
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * z * z * z * z) - 1 / (252 * z * z * z * z * z * z)
    return series - sum((1 / (x + j) for j in range(1, 6)), 1 / x)


def scaled_values(df: DataFrame, label: str, id_col: str, cats, nums) -> DataFrame:
    """Long (feature, y, id, v): category codes (null -1) and median-filled
    numbers as exact integers, hundredths above 30 bits of hash noise that
    breaks ties as the estimator's own noise does."""
    d = df.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"), *cats, *nums)
    med = quantile_row(to_long(d, nums), [0.5], ["median"])
    fills = {c: F.coalesce(F.col(c).cast("double"), med.where(F.col("column") == c).select("median").scalar()) for c in nums}
    numbers = d.select("id", "y", *[e.alias(c) for c, e in fills.items()]).unpivot(["id", "y"], list(nums), "feature", "x")
    texts = d.select("id", "y", *[F.col(c).cast("string").alias(c) for c in cats]).unpivot(["id", "y"], list(cats), "feature", "x")
    codes = category_codes(df.where(F.col(label).isNotNull()), cats).withColumnRenamed("column", "feature").withColumnRenamed("value", "x")
    coded = texts.join(codes, ["feature", "x"], "left").select("id", "y", "feature", F.coalesce("code", F.lit(-1)).cast("double").alias("x"))
    noise = F.conv(F.substring(F.md5(F.concat_ws(":", "feature", F.col("id").cast("string"))), 1, 8), 16, 10).cast("long")
    return numbers.unionByName(coded).select(
        "feature", "y", "id", (F.round(F.col("x") * 100).cast("long") * F.lit(1 << 30) + F.shiftright(noise, 2)).alias("v"))


def neighbour_information(df: DataFrame, label: str, id_col: str, cats, nums, k: int = NEIGHBOURS) -> DataFrame:
    """Nearest-neighbour estimate of each feature's mutual information
    (nats) with the label: (feature, mutual_information).

    One column at a time, by sorting: the kth neighbour of the same class is
    among the k rows on either side, and the rows of any class within that
    distance are a difference of two running counts.  No pairs.  Classes with
    one row take no part."""
    d = scaled_values(df, label, id_col, cats, nums)
    size = d.groupBy("feature", "y").agg(F.count(F.lit(1)).alias("n_y"))       # features x classes rows
    d = d.join(F.broadcast(size), ["feature", "y"]).where("n_y > 1")
    placed = ordered_prefix(d, "v", [], key=["feature", "y"], tie="id")
    at, home = F.col("_pos") % HALO_ROWS, F.floor(F.col("_pos") / HALO_ROWS)
    halo = F.array_compact(F.array(home, F.when(at < k, home - 1), F.when(at >= HALO_ROWS - k, home + 1)))
    w = Window.partitionBy("feature", "y", "_slice").orderBy("_pos")
    gaps = [F.col("v") - F.lag("v", i).over(w) for i in range(1, k + 1)] + [F.lead("v", i).over(w) - F.col("v") for i in range(1, k + 1)]
    near = (placed.withColumn("_home", home).withColumn("_slice", F.explode(halo))
            .withColumn("_gaps", F.array_sort(F.array_compact(F.array(*gaps)))).where("_slice = _home")
            .withColumn("k", F.least(F.lit(k), F.size("_gaps")))
            .select("feature", "id", "v", "n_y", "k", F.greatest(F.element_at("_gaps", F.col("k")), F.lit(1)).alias("r")))
    near = stored(near)
    # ends are exclusive: the upper end sorts before equal values, the lower one after them
    marks = near.select("feature", "id", F.explode(F.array(
        F.struct(F.col("v").alias("t"), F.lit(1).alias("kind"), F.lit(1).alias("one")),
        F.struct((F.col("v") + F.col("r")).alias("t"), F.lit(0).alias("kind"), F.lit(0).alias("one")),
        F.struct((F.col("v") - F.col("r")).alias("t"), F.lit(2).alias("kind"), F.lit(0).alias("one")))).alias("m")).select("feature", "id", "m.*")
    counted = ordered_prefix(marks, "t", ["one"], key="feature", tie="kind").where("kind <> 1")
    within = counted.groupBy("feature", "id").agg(F.sum(F.when(F.col("kind") == 0, F.col("cum_one")).otherwise(-F.col("cum_one"))).alias("m"))
    mean = lambda df_, c: df_.groupBy("feature", c).agg(F.count(F.lit(1)).alias("n")).groupBy("feature").agg(
        (F.sum(F.col("n") * digamma(F.col(c))) / F.sum("n")).alias(f"psi_{c}"), F.sum("n").alias(f"rows_{c}"))
    out = mean(near, "k").join(mean(near, "n_y"), "feature").join(mean(within, "m"), "feature")
    return out.select("feature", F.greatest(F.lit(0.0), digamma(F.col("rows_k")) + F.col("psi_k") - F.col("psi_n_y") - F.col("psi_m"))
                      .alias("mutual_information"))


def select_by_threshold(mi: DataFrame, threshold: float, on_empty: str = "raise") -> DataFrame:
    """features scoring at least ``threshold`` (0..1).  An empty
    selection is an error naming the best score (``on_empty='raise'``), or
    with ``on_empty='report'`` that message comes back as one row, so no
    driver-side check is needed.  Adds a ``message`` column."""
    if not 0 <= threshold <= 1:
        raise ValueError("importanceThreshold must be between 0.0 and 1.0")
    hit = F.col("mutual_information") >= threshold
    sel = mi.where(hit).withColumn("message", F.lit(None).cast("string"))
    msg = F.concat(F.lit(f"No features found with importance >= {threshold}. Maximum importance score: "),
                   F.format_string("%.4f", F.max("mutual_information")))
    empty = (mi.agg(F.count_if(hit).alias("_n"), msg.alias("message")).where(F.col("_n") == 0)
             .select(F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("mutual_information"),
                     "message"))
    if on_empty == "raise":
        row = empty.first()
        if row is not None:
            raise ValueError(row["message"])
        return sel
    return sel.unionByName(empty)


def select_by_names(mi: DataFrame, names) -> DataFrame:
    """inner lookup; unknown names are an error."""
    req = mi.sparkSession.createDataFrame([(n,) for n in names], "feature string")
    unknown = [r["feature"] for r in req.join(mi, "feature", "left_anti").collect()]
    if unknown:
        raise ValueError(f"Unknown features: {', '.join(sorted(unknown))}")
    return mi.join(req, "feature", "left_semi")


def interaction(a, b):
    """product with nulls as 0."""
    return F.coalesce(F.col(a), F.lit(0)) * F.coalesce(F.col(b), F.lit(0))


def interaction_stats(df: DataFrame, a: str, b: str) -> DataFrame:
    """mean, population std, min, max, median of the product."""
    d = df.select(interaction(a, b).cast("double").alias("v"))
    basic = d.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"),
                  F.max("v").alias("max"))
    med = quantile_row(to_long(d, ["v"]), [0.5], ["median"]).select("median")
    return basic.select("*", med.select(F.first("median")).scalar().alias("median"))


def selection_totals(sel: DataFrame) -> DataFrame:
    """number of selected features and their summed importance."""
    sel = sel.where(F.col("feature").isNotNull())
    return sel.agg(F.count(F.lit(1)).alias("selected_count"),
                   F.sum("mutual_information").alias("total_importance"))
