"""A fitted preprocessing and model as one table (S9): saved, checked (V13), loaded.

The table is tidy, ``(stage, column, key, value)``: the preprocessing stages of P10, the
roles, and the model's parameters.  It is written as one Parquet folder, so any
session that reads the folder can score.
"""
from __future__ import annotations

from dataclasses import asdict, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.models import NaiveBayes
from tidemark.operators.prep import PrepModel, params_table
from tidemark.roles import Roles

SCHEMA = "stage string, column string, key string, value double"
#: What a usable artefact holds: these stages, one of the encodings, and the model's.
NEEDED, ENCODINGS, MODEL = ("scale", "order"), ("binary", "one_hot"), ("prior", "mean", "variance")


def rows_of(m: PrepModel, nb: NaiveBayes | None = None) -> list[tuple]:
    """The table's rows; the role of a column is its key, lists keep their order by value."""
    out = list(params_table(m))
    for name, value in asdict(m.roles).items():
        if value is None:
            continue
        if isinstance(value, str):
            out.append(("role", value, name, 0.0))
        elif isinstance(value, dict):
            out += [(f"domain:{c}", c, str(v), float(i)) for c, values in value.items() for i, v in enumerate(values)]
        else:
            out += [("role", c, name, float(i)) for i, c in enumerate(value)]
    out += [("mode", c, v, 0.0) for c, v in m.modes.items() if v is not None]
    if nb is not None:
        out += [("prior", "", str(c), float(p)) for c, p in nb.priors.items()]
        for name, values in (("mean", nb.means), ("variance", nb.vars)):
            out += [(name, f, str(c), float(v)) for (c, f), v in values.items()]
    return out


def save(spark: SparkSession, path: str, m: PrepModel, nb: NaiveBayes | None = None) -> None:
    """One file; an existing artefact at ``path`` is replaced."""
    spark.createDataFrame(rows_of(m, nb), SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def missing_parts(artefact: DataFrame) -> DataFrame:
    """``config_complete, missing`` (what is absent, comma-joined) of an artefact table:
    both of scaler and feature order, an encoding, and scaler values for every ordered feature."""
    a = artefact.agg(*[F.count_if(F.col("stage") == s).alias(s) for s in NEEDED],
                     F.count_if(F.col("stage").isin(*ENCODINGS)).alias("encodings"),
                     F.count_if((F.col("stage") == "order") & F.col("column").isNotNull()).alias("features"),
                     F.count_if((F.col("stage") == "scale") & (F.col("key") == "mean") & F.col("value").isNotNull()).alias("means"),
                     F.count_if((F.col("stage") == "scale") & (F.col("key") == "scale") & (F.col("value") != 0)).alias("scales"))
    gone = F.concat_ws(",", F.when(F.col("order") == 0, "feature order"), F.when(F.col("scale") == 0, "scaler"),
                       F.when(F.col("encodings") == 0, "encodings"),
                       F.when((F.col("scale") > 0) & ((F.col("means") < F.col("features")) | (F.col("scales") < F.col("features"))), "scaler values"))
    return a.select((gone == "").alias("config_complete"), gone.alias("missing"), F.col("features").cast("long").alias("features"))


def load(spark: SparkSession, path: str) -> tuple[PrepModel, NaiveBayes | None]:
    """The saved objects; an incomplete artefact is refused with what it lacks."""
    table = spark.read.schema(SCHEMA).parquet(path)
    about = missing_parts(table).first()
    if not about.config_complete:
        raise ValueError(f"incomplete preprocessing configuration: {about.missing}")
    rows = table.collect()                                                # some rows per feature and category
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.stage, r.value if r.value is not None else 0.0)):
        by.setdefault(r.stage, []).append(r)
    listed = {f.name: tuple(r.column for r in by.get("role", []) if r.key == f.name) for f in fields(Roles) if f.name != "domains"}
    values = {n: (v[0] if v else None) if n in ("id", "label", "time") else v for n, v in listed.items()}
    domains = {own[0].column: tuple(r.key for r in own) for stage, own in by.items() if stage.startswith("domain:")}
    m = PrepModel(Roles(**values, domains=domains))
    m.medians = {r.column: r.value for r in by.get("impute_median", [])}
    m.modes = {r.column: r.key for r in by.get("mode", [])}
    for c in {r.column for r in by.get("clip", [])}:
        own = {r.key: r.value for r in by["clip"] if r.column == c}
        m.bounds[c] = tuple(own[k] for k in ("q1", "q3", "lower", "upper"))
    for r in by.get("binary", []):
        m.binary_maps.setdefault(r.column, {})[r.key] = int(r.value)
    for r in by.get("one_hot", []):
        m.categories.setdefault(r.column, []).append(r.key)
    m.feature_columns = [r.column for r in by["order"]]
    m.means = {r.column: r.value for r in by["scale"] if r.key == "mean"}
    m.scales = {r.column: r.value for r in by["scale"] if r.key == "scale"}
    if not by.get("prior"):
        return m, None
    priors = {int(r.key): r.value for r in by["prior"]}
    part = lambda stage: {(int(r.key), r.column): r.value for r in by.get(stage, [])}
    return m, NaiveBayes(list(m.feature_columns), sorted(priors), priors, part("mean"), part("variance"))

