"""Corpus pipeline: stages over ``documents``, each on what its predecessor kept.

toxicity          documents that the classifier rejects go
simhash           one document of each near-duplicate group stays
secrets           secrets are replaced in the text; every document stays
mixing            documents are repeated towards the target weights, never dropped
sentencepiece     the remaining texts as piece ids
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import mixing, pieces, secret_scan, simhash_vp, toxicity
from tidemark.llm.common import named, stored, table

#: Target weights of the quality domains; a document is kept once at least, as often as the weights need.
QUALITY = "CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' END"
WEIGHTS = {"high": 0.9, "low": 0.1}
LEAST_RATE = 1.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold.  The classifier learns from the
    labelled rows outside the held-out fold of the whole documents table."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(table(spark, sf_dir, "documents"), labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every SimHash component."""
    return simhash_vp.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without secrets; ``n_chars`` follows the text."""
    clean = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return clean.select(named(docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the expected tokens of the quality domains
    approach the weights; the smallest total that needs no document dropped."""
    labels = table(spark, sf_dir, "labels")
    model = mixing.fit_classifier(docs, labels, F.expr(QUALITY), domains=list(WEIGHTS))
    mixed = mixing.mixture_rates(docs, model, WEIGHTS, budget=None, min_rate=LEAST_RATE)
    return mixing.emit(mixed, docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, lang, n_tokens, ids``."""
    tokens = pieces.encode(docs.select("doc_id", "source", "lang", "text"), pieces.load(spark))
    return tokens.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix),
          ("sentencepiece", encode)]
#: Classifiers, graphs and Viterbi have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
