"""Mixing to target weights with soft domain membership, column functions only.

A naive Bayes classifier, fitted on a table of labelled documents, gives every
document a posterior over the domains.  Nonnegative rates (expected copies per
document) are then fitted by projected-gradient least squares, so that the
expected tokens of each domain, ``sum(rate * tokens * posterior)``, match the
target weights times the token budget.

Documents whose posteriors round to the same of ``LEVELS`` steps share a rate,
so the descent runs over grid cells: at most (LEVELS + 1) ** (domains - 1) rows,
however many documents there are.  A cell carries its documents' expected
tokens per domain under their exact posteriors, so the totals that meet the
targets are exact; only the choice which documents share a rate is rounded.  Soft posteriors need thousands of
steps, so up to GATHERED cells the driver does them; above, each is one small
aggregate.  Targets that the rates cannot meet are reported by a warning.
"""
from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import bounded_sample, named, stored

MAX_LABELLED = 20_000
TOP_WORDS = 128
MIN_ROWS = 5
LEVELS = 100
#: Iterations after which the fit fails, relative error that ends them, iterations between proofs that no better rates exist.
MAX_ITER, TOLERANCE, CHECK_EVERY = 200_000, 1e-4, 5
#: Grid cells that the driver takes at most (all of four domains); more stay distributed.
GATHERED = 200_000
#: Words are cut at ASCII white space and used as they stand.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|<>{}\[\]~^=_\\/@]"
#: Bins of each shape feature.
SHAPE = {"length": 18, "symbols": 8, "word": 14, "lines": 8}


def features(docs: DataFrame, text_col: str, known: list[str] | None = None) -> DataFrame:
    """``docs`` plus ``__f``: tokens, a bin per shape feature, distinct words
    (all, or those of ``known``).  Null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = F.struct(text.alias("t"), F.split(text, BLANKS).alias("w"))

    def bins(x):
        # a text that starts or ends with white space yields an empty first or last word
        edge = F.when(F.element_at(x["w"], 1) == "", 1).otherwise(0) + F.when(
            (F.size(x["w"]) > 1) & (F.element_at(x["w"], -1) == ""), 1).otherwise(0)
        tokens = (F.size(x["w"]) - edge).cast("long")
        words = F.array_distinct(x["w"]) if known is None else F.array_intersect(
            x["w"], F.array(*[F.lit(w) for w in known]).cast("array<string>"))
        size = F.greatest(F.length(x["t"]), F.lit(1))
        upto = lambda name, v: F.least(F.floor(v), F.lit(SHAPE[name] - 1)).cast("int").alias(name)
        return F.struct(
            tokens.alias("tokens"), words.alias("words"), upto("length", F.log2(tokens + 1)),
            upto("symbols", F.sqrt(F.regexp_count(x["t"], F.lit(SYMBOLS)) / size) * 16),
            upto("word", F.length(x["t"]) / F.greatest(tokens, F.lit(1))),
            upto("lines", F.sqrt((F.length(x["t"]) - F.length(F.replace(x["t"], F.lit("\n"), F.lit("")))) / size) * 16))

    return docs.withColumn("__f", F.element_at(F.transform(F.array(raw), bins), 1))


@dataclass
class Classifier:
    """Log scores: ``prior[d]``, ``shape[name][bin][d]``, ``words[word][d]`` (presence against absence)."""
    domains: list[str]
    prior: np.ndarray
    shape: dict[str, np.ndarray]
    words: dict[str, np.ndarray]


def fit_classifier(docs: DataFrame, labels: DataFrame, domain: Column, id_col: str = "doc_id", text_col: str = "text",
                   domains: list[str] | None = None, max_labelled: int = MAX_LABELLED, top_words: int = TOP_WORDS) -> Classifier:
    """Naive Bayes from at most ``max_labelled`` labelled rows; ``domain`` is an
    expression over ``labels``.  Rows with a null id or domain take no part; a
    domain without rows keeps a smoothed prior."""
    marks = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), domain.alias("__y")).where("__y IS NOT NULL")
    marks = F.broadcast(bounded_sample(marks, "__id", max_labelled))            # at most max_labelled rows
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(marks, "__id")
    rows = stored(features(rows, "__t").select("__y", "__f.*"))
    count = {r["__y"]: r.n for r in rows.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    domains = sorted(count) if domains is None else list(domains)
    n = np.array([count.get(d, 0) for d in domains], float)
    prior = np.log((n + 1) / (n + 1).sum())
    at = {d: i for i, d in enumerate(domains)}
    shape = {}
    bins = rows.select("__y", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("bin")) for k in SHAPE])).alias("x"))
    for k, size in SHAPE.items():
        shape[k] = np.ones((size, len(domains)))
    for r in bins.groupBy("__y", "x.k", "x.bin").agg(F.count(F.lit(1)).alias("n")).collect():   # domains x bins rows
        if r["__y"] in at:
            shape[r.k][r.bin, at[r["__y"]]] += r.n
    shape = {k: np.log(m / m.sum(axis=0)) for k, m in shape.items()}
    if not domains:
        return Classifier([], prior, shape, {})
    # words by the chi-squared statistic of presence against domain
    has = [F.sum(F.when(F.col("__y") == d, 1).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains)]
    total = max(1.0, n.sum())
    both = sum((F.col(f"n{i}") for i in range(len(domains))), F.lit(0.0))
    chi2 = sum((F.pow(F.col(f"n{i}") - both * (m / total), F.lit(2.0)) / (both * max(m, 1.0) / total) for i, m in enumerate(n)), F.lit(0.0))
    best = (rows.select("__y", F.explode("words").alias("w")).where("w <> ''").groupBy("w").agg(*has).where(both >= MIN_ROWS)
            .orderBy(chi2.desc(), "w").limit(top_words).collect())
    words = {}
    for r in best:
        p = (np.array([r[f"n{i}"] for i in range(len(domains))], float) + 0.5) / (n + 1)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        words[r.w] = np.log(p) - np.log(1 - p)
        prior = prior + np.log(1 - p)
    return Classifier(domains, prior, shape, words)


def with_posterior(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``__tokens``, the posterior ``__p array<double>`` and ``__q array<int>``, the
    same in steps of 1 / LEVELS (the last domain takes what rounding leaves)."""
    d = range(len(model.domains))
    words = sorted(model.words)
    f = F.col("__f")
    table = F.create_map(*[x for w in words for x in (F.lit(w), F.array(*[F.lit(float(v)) for v in model.words[w]]))]) if words else None

    def log_score(i):
        out = F.lit(float(model.prior[i]))
        for k, m in model.shape.items():
            out = out + F.element_at(F.array(*[F.lit(float(v)) for v in m[:, i]]), f[k] + 1)
        return out

    def posterior(s):
        e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))

    def grid(p):
        q = F.transform(F.slice(p, 1, len(d) - 1), lambda x: F.floor(x * LEVELS + 0.5).cast("int")) if len(d) > 1 else F.array().cast("array<int>")
        return F.concat(q, F.array(F.greatest(F.lit(0), LEVELS - F.aggregate(q, F.lit(0), lambda a, x: a + x))))

    once = lambda x, fn: F.element_at(F.transform(F.array(x), fn), 1)  # noqa: E731  binds x once
    base = F.array(*[log_score(i) for i in d]).cast("array<double>")
    if table is not None:
        base = F.aggregate(f["words"], base, lambda a, w: F.zip_with(a, F.element_at(table, w), lambda x, y: x + y))
    scored = features(docs, text_col, words).withColumn("__s", base)
    return (scored.withColumn("__p", once(F.col("__s"), posterior)).withColumn("__q", grid(F.col("__p")))
            .withColumn("__tokens", f["tokens"]).drop("__f", "__s"))


def membership(q: Column, i: int) -> Column:
    """Posterior of domain i from the grid steps."""
    return F.element_at(q, i + 1) / F.aggregate(q, F.lit(0), lambda a, x: a + x)


class _Gathered:
    """State of the descent on the driver: at most GATHERED cells, ordered, so that sums do not depend on partitions."""

    def __init__(self, cells: DataFrame, n_domains: int, start: float):
        rows = sorted(cells.collect(), key=lambda r: r.q)                       # at most GATHERED rows
        self.spark, self.q = cells.sparkSession, [list(r.q) for r in rows]
        self.t = np.array([r.t for r in rows], float)
        self.p = np.array([[r[f"p{i}"] for i in range(n_domains)] for r in rows], float).reshape(len(rows), n_domains)
        self.tp = self.p * self.t[:, None]
        self.x = np.full(len(rows), start)
        self.y = self.x

    def totals(self):
        return self.x @ self.tp, self.y @ self.tp

    def extremes(self, pull, low, high):
        g = self.p @ pull
        return float(g.min()), float((self.t * np.where(g > 0, g * low, g * (high or 0.0))).sum())

    def restart(self):
        self.y = self.x

    def move(self, slope, ahead, low, high, iteration):
        z = np.clip(self.y - self.p @ slope, low, high)
        self.y, self.x = z + ahead * (z - self.x), z

    def rates(self):
        return self.spark.createDataFrame([(q, float(x)) for q, x in zip(self.q, self.x)], "q array<int>, rate double")


class _Distributed:
    """The same state as a table, for more cells; one number per domain reaches the driver."""

    def __init__(self, cells: DataFrame, n_domains: int, start: float):
        self.d = range(n_domains)
        self.state = cells.withColumn("x", F.lit(start)).withColumn("y", F.col("x"))

    def _along(self, v):
        return sum((F.lit(float(v[i])) * F.col(f"p{i}") for i in self.d), F.lit(0.0))

    def totals(self):
        r = self.state.agg(*[F.sum(F.col("t") * F.col(f"p{i}") * F.col(c)).alias(f"{c}{i}") for c in "xy" for i in self.d]).first()
        return np.array([r[f"x{i}"] for i in self.d]), np.array([r[f"y{i}"] for i in self.d])

    def extremes(self, pull, low, high):
        g = self._along(pull)
        r = self.state.agg(F.min(g).alias("least"), F.sum(F.col("t") * F.when(g > 0, g * low).otherwise(g * (high or 0.0))).alias("box")).first()
        return r.least, r.box

    def restart(self):
        self.state = self.state.withColumn("y", F.col("x"))

    def move(self, slope, ahead, low, high, iteration):
        moved = F.greatest(F.lit(low), F.col("y") - self._along(slope))
        if high is not None:
            moved = F.least(F.lit(high), moved)
        self.state = (self.state.withColumn("z", moved).withColumn("y", F.col("z") + F.lit(ahead) * (F.col("z") - F.col("x")))
                      .withColumn("x", F.col("z")).drop("z"))
        if iteration % CHECK_EVERY == 0:
            self.state = stored(self.state)

    def rates(self):
        return self.state.select("q", F.col("x").alias("rate"))


def fit_rates(cells: DataFrame, weights: dict[str, float], domains: list[str], budget: float | None = 1.0,
              min_rate: float = 0.0, max_rate: float | None = None, max_iter: int = MAX_ITER,
              tolerance: float = TOLERANCE) -> tuple[DataFrame, dict]:
    """``cells(q, tokens)`` -> ``(q, rate)`` and a report.  A column ``mass array<double>`` holds the
    cells' expected tokens per domain; without it they follow from q.

    Minimises the squared relative errors of the domain totals over rates in
    [min_rate, max_rate], from all ones, by projected gradient with momentum
    and restart.  ``budget`` times the present tokens is the total aimed at;
    None takes the smallest total that no domain exceeds already.

    It ends when the totals meet the targets, or when the gradient over the
    allowed rates proves that they are within ``tolerance`` of the best that the
    bounds and the posteriors allow (``report["met"]`` tells which).  Otherwise
    it raises after ``max_iter`` steps.
    """
    d = range(len(domains))
    p = [membership(F.col("q"), i) for i in d]
    if "mass" in cells.columns:
        p = [F.when(F.col("tokens") > 0, F.element_at("mass", i + 1) / F.col("tokens")).otherwise(x) for i, x in enumerate(p)]
    cells = stored(cells.select("q", F.col("tokens").cast("double").alias("t"), *[x.alias(f"p{i}") for i, x in enumerate(p)]))
    sums = cells.agg(*[F.sum(F.col("t") * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"m{i}_{j}") for i in d for j in d],
                     *[F.sum(F.col("t") * F.col(f"p{i}")).alias(f"a{i}") for i in d], F.count(F.lit(1)).alias("cells")).first()
    m = np.array([[sums[f"m{i}_{j}"] or 0.0 for j in d] for i in d]).reshape(len(d), len(d))
    now = np.array([sums[f"a{i}"] or 0.0 for i in d])
    share = np.array([float(weights[x]) for x in domains])
    share = share / share.sum() if len(d) else share
    if not len(d) or now.sum() <= 0:
        return cells.select("q", F.lit(max(1.0, min_rate)).alias("rate")), {
            "iterations": 0, "error": 0.0, "met": True, "totals": now.tolist(), "targets": now.tolist()}
    if budget is None:
        budget = max(1.0, float((now / np.maximum(share * now.sum(), 1e-12)).max()))
    target = share * budget * now.sum()
    scale = 1 / np.maximum(target, 1e-3 * target.sum())
    step = 1 / max(float(np.linalg.eigvalsh(np.sqrt(scale)[:, None] * m * np.sqrt(scale)[None, :]).max()), 1e-12)
    low, high = float(min_rate), None if max_rate is None else float(max_rate)
    state = (_Gathered if sums["cells"] <= GATHERED else _Distributed)(cells, len(d), max(1.0, low))
    momentum, last = 1.0, np.inf
    for iteration in range(1, max_iter + 1):
        totals, ahead_totals = state.totals()
        miss = totals - target
        error = float(np.abs(miss).sum() / target.sum())
        loss = float((scale * miss ** 2).sum() / 2)
        met = error < tolerance
        if met:
            break
        if iteration % CHECK_EVERY == 0:
            # no allowed rates lie below loss - gap: the totals of the best ones sum to `most` at most
            pull = scale * miss
            least, box = state.extremes(pull, low, high)
            most = float((target + np.sqrt(2 * loss / scale)).sum())
            gap = pull @ totals - low * (pull @ now) + max(0.0, most - low * now.sum()) * max(0.0, -least)
            if high is not None:
                gap = min(gap, pull @ totals - box)
            if gap <= tolerance ** 2 * target.sum() / 2:
                break                                                  # the bounds keep it from the target
        if loss > last:
            momentum, ahead_totals = 1.0, totals
            state.restart()
        last = loss
        ahead = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        state.move(step * scale * (ahead_totals - target), float((momentum - 1) / ahead), low, high, iteration)
        momentum = ahead
    else:
        raise RuntimeError(f"rates still move after {max_iter} steps: totals {totals.tolist()} for targets {target.tolist()}")
    report = {"iterations": iteration, "error": error, "met": met, "totals": totals.tolist(), "targets": target.tolist()}
    return state.rates(), report


def document_rates(docs: DataFrame, model: Classifier, weights: dict[str, float], id_col: str = "doc_id",
                   text_col: str = "text", **options) -> DataFrame:
    """``(id, __tokens, __p, __q, __rate)`` per row of ``docs``, reading the texts once."""
    scored = stored(with_posterior(docs.select(id_col, text_col), model, text_col).drop(text_col))
    return _with_rates(scored, scored, model, weights, **options)


def mixture_rates(docs: DataFrame, model: Classifier, weights: dict[str, float], text_col: str = "text",
                  **options) -> DataFrame:
    """``docs`` plus ``__tokens``, ``__p``, ``__q`` and ``__rate``: two passes over the
    texts, neither shuffles them.  Every row stays; repeated rows have equal rates."""
    scored = with_posterior(docs.select(text_col), model, text_col)
    return _with_rates(with_posterior(docs, model, text_col), scored, model, weights, **options)


def _with_rates(rows: DataFrame, scored: DataFrame, model: Classifier, weights: dict[str, float], **options) -> DataFrame:
    # decimal sums do not depend on the order of the rows
    mass = [F.sum((F.element_at("__p", i + 1) * F.col("__tokens")).cast("decimal(28,9)")).cast("double") for i in range(len(model.domains))]
    cells = scored.groupBy(F.col("__q").alias("q")).agg(F.sum("__tokens").alias("tokens"), F.array(*mass).cast("array<double>").alias("mass"))
    rates, report = fit_rates(cells, weights, model.domains, **options)
    if not report["met"]:
        warnings.warn(f"target weights not met: {report}")
    rates = stored(rates.select(F.col("q").alias("__q"), F.col("rate").alias("__rate")))
    return rows.join(F.broadcast(rates), "__q", "left")           # at most one row per grid cell


def emit(mixed: DataFrame, columns: list[str], id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """Rows of ``mixed`` repeated ``floor(rate + u)`` times, u a hash of the id in [0, 1)."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1_000_003)) / 1_000_003
    copies = F.floor(F.col("__rate") + u).cast("int")
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(named(columns))
