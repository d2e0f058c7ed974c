"""Toxicity classifier with counterfactual regularisation.

A logistic model over the presence of words.  Beside the log loss and an L2
term, training penalises the squared change of a sentence's logit when an
identity term in it is swapped for another of its group, so that the mention
of a group by itself does not move the score.  Labelled sentences that name an
identity are swapped as they stand; every group is also put into a bounded
number of labelled sentences that name none, so that terms that are rare in the
labels are regularised too.

Fitting uses a bounded sample: at most ``max_labelled`` labelled rows, at most
``max_words`` words chosen by how much their presence tells about the label.
Scoring reads every whole text and only the text.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import bounded_sample, named

MAX_LABELLED = 20_000
MAX_WORDS = 2_048
MIN_ROWS = 5
#: Ridge per feature: L2 + L2_ROWS / labelled rows, stronger where there are few.
L2, L2_ROWS = 1e-4, 0.1
COUNTERFACTUAL = 1.0
THRESHOLD = 0.7
#: A word or stem needs this z score; lengths of the stems.
LEAST_Z = 3.0
STEMS = (4, 5, 6)
#: Sentences without an identity term that get one put in, for each group.
INSERTED = 64
#: Identity terms by group; within a group any may stand for another.
IDENTITY_GROUPS = (
    ("man", "woman", "men", "women", "boy", "girl", "male", "female", "transgender", "nonbinary"),
    ("gay", "lesbian", "straight", "bisexual", "heterosexual", "homosexual", "queer"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("black", "white", "asian", "african", "american", "european", "mexican", "latino", "arab", "indian"),
    ("deaf", "blind", "disabled", "autistic", "old", "young", "elderly", "immigrant", "refugee"),
)

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    """Distinct lower-cased words, and their beginnings marked by a star, so
    that inflected forms of one stem share a feature."""
    words = set(_WORD.findall(text.lower())) if text else set()
    return words.union(w[:k] + "*" for k in STEMS for w in words if len(w) >= k)


@dataclass
class Model:
    words: list[str]
    weights: np.ndarray
    bias: float
    identity_logits: dict[str, float] = field(default_factory=dict)

    def table(self) -> dict[str, float]:
        return dict(zip(self.words, self.weights.tolist()))


def _word_rows(sample: DataFrame) -> DataFrame:
    """(row, y, words): the distinct words of each sampled text."""
    def run(batches):
        for b in batches:
            words = [sorted(words_of(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.string()))],
                                             names=["row", "y", "words"])
    return sample.select("row", "y", "text").mapInArrow(run, "row long, y int, words array<string>")


def _select_words(rows: DataFrame, max_words: int, min_rows: int) -> list[str]:
    """The words whose presence differs most between the labels (pooled z
    score of the difference in rates), besides all identity terms."""
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = max(1, n.get(1, 0)), max(1, n.get(0, 0))
    rate = (F.col("pos") + F.col("neg") + 0.5) / (pos + neg + 1.0)
    z = F.abs(F.col("pos") / pos - F.col("neg") / neg) / F.sqrt(rate * (1 - rate) * (1.0 / pos + 1.0 / neg))
    identity = [t for g in IDENTITY_GROUPS for t in g]
    best = (rows.select("y", F.explode("words").alias("word"))
            .groupBy("word").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
            .where((F.col("pos") + F.col("neg") >= min_rows) & ~F.col("word").isin(identity))
            .where(z >= LEAST_Z).orderBy(z.desc(), "word").limit(max_words))
    return identity + [r.word for r in best.select("word").collect()]


def _counterfactuals(features: list[set[int]], groups: list[list[int]]) -> list[tuple[set[int], set[int]]]:
    """Pairs of feature sets that differ in one identity term."""
    pairs, plain = [], []
    for f in features:
        named = [(g, t) for g in groups for t in g if t in f]
        for g, t in named:
            for other in g:
                if other != t and other not in f:
                    pairs.append((f, (f - {t}) | {other}))
        if not named:
            plain.append(f)
    plain = plain[:: max(1, len(plain) // INSERTED)][:INSERTED]
    for i, f in enumerate(plain):
        for g in groups:
            first = g[i % len(g)]
            pairs.append((f, f | {first}))
            pairs.append((f | {first}, f | {g[(i + 1) % len(g)]}))
    return pairs


class _Rows:
    """Sparse 0/1 rows with the two products that the gradient needs."""

    def __init__(self, sets: list[set[int]], width: int):
        self.n, self.width = len(sets), width
        self.row = np.repeat(np.arange(self.n), [len(s) for s in sets])
        self.col = np.fromiter((c for s in sets for c in sorted(s)), np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], minlength=self.width)


def _descend(features: list[set[int]], y: np.ndarray, pairs, width: int, l2: float, strength: float,
             steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Adam on: mean class-balanced log loss + l2 |w|^2 / 2 + strength * mean squared logit change of the pairs."""
    x = _Rows(features, width)
    left, right = _Rows([a for a, _ in pairs], width), _Rows([b for _, b in pairs], width)
    ones = max(1, int(y.sum()))
    weight = np.where(y == 1, 0.5 / ones, 0.5 / max(1, len(y) - ones))
    w, bias = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        err = weight * (1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -30, 30))) - y)
        change = (left.dot(w) - right.dot(w)) / max(1, len(pairs))
        grad = np.append(x.back(err) + l2 * w + 2 * strength * (left.back(change) - right.back(change)), err.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_labelled: int = MAX_LABELLED, max_words: int = MAX_WORDS, min_rows: int = MIN_ROWS,
        l2: float = L2, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Fit on the labelled rows of ``docs``.

    Rows with a null id, text or label, and labels of ids that ``docs`` lacks,
    take no part; an id labelled twice counts twice.  Without any row, or with
    one class only, the model has no words and scores every text alike.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("row"), F.col(label_col).cast("int").alias("y"))
    marks = F.broadcast(bounded_sample(marks, "row", max_labelled))         # at most max_labelled rows
    texts = docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    rows = _word_rows(texts.join(marks, "row")).persist()
    try:
        words = _select_words(rows, max_words, min_rows)
        index = {w: i for i, w in enumerate(words)}
        known = F.array(*[F.lit(w) for w in words])
        found = rows.select("row", "y", F.array_intersect("words", known).alias("words")).orderBy("row").collect()
    finally:
        rows.unpersist()
    y = np.array([r.y for r in found], float)
    prior = float(y.mean()) if len(y) else 0.0
    if len(set(y.tolist())) < 2:
        return Model([], np.zeros(0), float(np.log((prior + 1e-3) / (1 - prior + 1e-3))))
    features = [{index[w] for w in r.words} for r in found]
    groups = [[index[t] for t in g] for g in IDENTITY_GROUPS]
    w, bias = _descend(features, y, _counterfactuals(features, groups), len(words), l2 + L2_ROWS / len(y),
                       counterfactual)
    identity = {t: float(w[index[t]]) for g in IDENTITY_GROUPS for t in g}
    return Model(words, w, bias, identity)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` plus ``score`` in 0..1.  Null and empty texts get the bias's score."""
    weights = docs.sparkSession.sparkContext.broadcast(model.table())        # at most max_words entries
    bias = model.bias

    @F.pandas_udf("double")
    def run(text):
        import pandas as pd
        w = weights.value
        known = w.keys()
        logits = np.array([bias + sum(w[x] for x in known & words_of(t)) for t in text], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(logits, -30, 30))))

    return docs.withColumn(score_col, run(F.col(text_col)))


def held_out(id_col: Column) -> Column:
    """Fold of the contract: crc32 of the id as text leaves remainder 1 by 3 (null ids: no)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns as they are."""
    return score(docs, model, text_col, "__toxicity").where(F.col("__toxicity") < threshold).select(named(docs.columns))
