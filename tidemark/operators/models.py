"""Classifiers and evaluation (M1..M19).

Gaussian naive Bayes is fitted with one grouped aggregate and applied as a
pure column expression, so scoring is a projection inside whole-stage
codegen.  Evaluation (confusion counts, AUC, ROC) works on grouped score
counts; the ordered running sums use the range-partitioned prefix of
``functions.stats`` instead of a single-task global window.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import ordered_prefix

VAR_SMOOTHING = 1e-9


def qc(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class NaiveBayes:
    features: list
    classes: list          # [0, 1]
    priors: dict           # class -> prior
    means: dict            # (class, feature) -> mean
    vars: dict             # (class, feature) -> variance incl. smoothing

    def joint_log_likelihood(self, c) -> Column:
        e = F.lit(math.log(self.priors[c]))
        for f in self.features:
            v = self.vars[(c, f)]
            e = e - F.lit(0.5 * math.log(2 * math.pi * v)) - (qc(f) - F.lit(self.means[(c, f)])) ** 2 / F.lit(2 * v)
        return e

    def probability(self) -> Column:
        """P(class 1), numerically stable two-class softmax."""
        d = self.joint_log_likelihood(0) - self.joint_log_likelihood(1)
        # exp overflows to +inf for large d, giving exactly 0.0: no branch,
        # so the long likelihood expression appears once in the plan
        return 1 / (1 + F.exp(d))

    def decision(self) -> Column:
        """Own class decision (argmax, ties to class 0)."""
        return (self.joint_log_likelihood(1) > self.joint_log_likelihood(0)).cast("int")


def fit_naive_bayes(train: DataFrame, features, label: str = "label",
                    var_smoothing: float = VAR_SMOOTHING) -> NaiveBayes:
    """M2: class-wise mean and population variance plus
    ``var_smoothing * max feature variance``; one aggregate, ~4*d numbers
    come back."""
    features = list(features)
    per = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"),
                                   *[F.avg(qc(f)).alias(f"m{i}") for i, f in enumerate(features)],
                                   *[F.var_pop(qc(f)).alias(f"v{i}") for i, f in enumerate(features)]).collect()
    allv = train.agg(*[F.var_pop(qc(f)).alias(f"v{i}") for i, f in enumerate(features)]).first()
    eps = var_smoothing * max(float(allv[f"v{i}"]) for i in range(len(features)))
    n = sum(r["_n"] for r in per)
    priors, means, vars_ = {}, {}, {}
    for r in per:
        c = int(r[label])
        priors[c] = r["_n"] / n
        for i, f in enumerate(features):
            means[(c, f)] = float(r[f"m{i}"])
            vars_[(c, f)] = float(r[f"v{i}"]) + eps
    return NaiveBayes(features, sorted(priors), priors, means, vars_)


def classification_metrics(pred: DataFrame, label: str = "label", decision: str = "pred") -> DataFrame:
    """M7: accuracy, precision, recall, F1 of the positive class; 0 when a
    denominator is 0.  One aggregate."""
    y, p = F.col(label) == 1, F.col(decision) == 1
    c = pred.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                 F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    acc = F.when(tp + fp + fn + tn > 0, (tp + tn) / (tp + fp + fn + tn)).otherwise(0.0)
    return c.select("tp", "fp", "fn", "tn", acc.alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"), f1.alias("f1"))


CLASS_NAMES = {0: "No Churn", 1: "Churn"}   # fixed value: matrix labels


def confusion_matrix(pred: DataFrame, label: str = "label", decision: str = "pred") -> DataFrame:
    """M8 + M18: all four cells (zero-filled) with their share of the total."""
    spark = pred.sparkSession
    cells = spark.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], "actual int, predicted int")
    counts = pred.groupBy(F.col(label).cast("int").alias("actual"),
                          F.col(decision).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("count"))
    m = cells.join(counts, ["actual", "predicted"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    total = pred.select(F.count(F.lit(1))).scalar()
    names = F.create_map(*[x for k, v in CLASS_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return m.select("actual", "predicted", names[F.col("actual")].alias("actual_name"),
                    names[F.col("predicted")].alias("predicted_name"), F.col("count").cast("long").alias("count"),
                    F.try_divide(F.col("count") * 100.0, total).alias("share_percent"))


def score_counts(pred: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    """(score, pos, neg) per distinct score: the only input ROC/AUC need."""
    return pred.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def roc_auc(pred: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    """M9: tie-aware Mann-Whitney AUC: for each positive, negatives with a
    lower score count 1, equal score 1/2."""
    sc = score_counts(pred, label, score)
    pre = ordered_prefix(sc, "score", ["neg"])          # cum_neg includes the current score
    part = pre.agg(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + 0.5 * F.col("neg"))).alias("u"),
                   F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return part.select(F.try_divide(F.col("u"), F.col("P") * F.col("N")).alias("roc_auc"),
                       F.col("P").cast("long").alias("positives"), F.col("N").cast("long").alias("negatives"))


def roc_curve(pred: DataFrame, label: str = "label", score: str = "probability",
              drop_intermediate: bool = True) -> DataFrame:
    """(fpr, tpr, threshold) per distinct score, highest first, a
    leading (0, 0, +inf) point, and collinear points dropped.  Neighbours
    come from an equi-join on the global position, not a global window."""
    from tidemark.session import cut_lineage
    sc = cut_lineage(score_counts(pred, label, score).withColumn("_neg_score", -F.col("score")))
    pre = cut_lineage(ordered_prefix(sc, "_neg_score", ["pos", "neg"]))   # descending score
    pts = pre.select(F.col("_pos").alias("i"), "score", F.col("cum_pos").alias("tps"), F.col("cum_neg").alias("fps"))
    P = pre.agg(F.sum("pos")).scalar()
    N = pre.agg(F.sum("neg")).scalar()
    last = pts.agg(F.max("i")).scalar()
    if drop_intermediate:
        prev = pts.select((F.col("i") + 1).alias("i"), F.col("tps").alias("tps_p"), F.col("fps").alias("fps_p"))
        nxt = pts.select((F.col("i") - 1).alias("i"), F.col("tps").alias("tps_n"), F.col("fps").alias("fps_n"))
        j = pts.join(prev, "i", "left").join(nxt, "i", "left")
        # first and last points always stay; a middle point stays when the
        # curve bends there (non-zero second difference in fps or tps)
        keep = ((F.col("i") == 1) | (F.col("i") == last)
                | ((F.col("fps_n") - 2 * F.col("fps") + F.col("fps_p")) != 0)
                | ((F.col("tps_n") - 2 * F.col("tps") + F.col("tps_p")) != 0))
        pts = j.where(keep).select("i", "score", "tps", "fps")
    start = pred.sparkSession.range(1).select(F.lit(0).cast("long").alias("i"),
                                               F.lit(float("inf")).alias("score"),
                                               F.lit(0).cast("long").alias("tps"), F.lit(0).cast("long").alias("fps"))
    allp = start.unionByName(pts)
    return allp.select("i", F.col("score").alias("threshold"),
                       F.try_divide(F.col("fps"), N).alias("fpr"),
                       F.try_divide(F.col("tps"), P).alias("tpr"))


def threshold_sweep(pred: DataFrame, thresholds, label: str = "label", score: str = "probability") -> DataFrame:
    """Metrics when churn is p >= t, for each cut-off ``t``, from one
    grouped pass over the score counts (the cut-off list is small)."""
    sc = score_counts(pred, label, score)
    aggs = []
    for i, t in enumerate(thresholds):
        hit = F.col("score") >= t
        aggs += [F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias(f"tp{i}"),
                 F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias(f"fp{i}"),
                 F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias(f"fn{i}"),
                 F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias(f"tn{i}")]
    one = sc.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"),
                                        F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn"),
                                        F.col(f"tn{i}").alias("tn")) for i, t in enumerate(thresholds)]))
    c = one.select(rows.alias("x")).select("x.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return c.select("threshold", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
                    F.col("fn").cast("long").alias("fn"), F.col("tn").cast("long").alias("tn"),
                    prec.alias("precision"), rec.alias("recall"),
                    F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"))


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """M6: fold = (position inside its class by hash(id, seed) - 1) % k.
    A class is ordered over range partitions (hot classes are split)."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 15),
               16, 10).cast("long")
    d = df.select(id_col, label, h.alias("_h"))
    pre = ordered_prefix(d, "_h", [], key=label, tie=id_col)
    return pre.select(id_col, label, ((F.col("_pos") - 1) % k).cast("int").alias("fold"))
