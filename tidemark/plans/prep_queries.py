"""Preprocessing queries: fitted parameters, split, encoded/scaled frames."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.stats import r
from tidemark.operators import prep
from tidemark.operators import validate as v
from tidemark.plans.catalog import register
from tidemark.plans.ingest_queries import _typed_sql
from tidemark.plans.prep_sql import CATS, FEATURES, R, apply_ctes, long_of, prep_ctes, q
from tidemark.sources.fixtures import churn_base, churn_raw

_FITTED: dict = {}


def fitted(spark, sf_dir):
    """Fit once per table directory in this process (parameters are small)."""
    key = (id(spark), sf_dir)
    if key not in _FITTED:
        _FITTED[key] = prep.fit(churn_base(spark, sf_dir), R)
    return _FITTED[key]


def typed_scoring_rows(spark, sf_dir):
    return v.typed_projection(churn_raw(spark, sf_dir))


def _long(df, idcol):
    cols = [c for c in df.columns if c != idcol]
    return (df.select(idcol, *[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot([idcol], cols, "feature", "value").withColumn("value", r("value")))


@register("p1_impute_median", f"""WITH {prep_ctes()}
SELECT "column", round(median, 6) AS median FROM _pmed""", ("churn_base",))
def p1(spark, sf_dir):
    return prep.fit_medians(churn_base(spark, sf_dir), R.numeric).select("column", r("median").alias("median"))


@register("p2_impute_mode", f"""WITH {prep_ctes()}
SELECT "column", mode FROM _pmode""", ("churn_base",))
def p2(spark, sf_dir):
    return prep.fit_modes(churn_base(spark, sf_dir), list(R.binary) + list(R.multi) + list(R.flag))


@register("p3_clip_iqr", f"""WITH {prep_ctes()}
SELECT "column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(lower, 6) AS lower, round(upper, 6) AS upper FROM _bnd""",
          ("churn_base",))
def p3(spark, sf_dir):
    m, _ = fitted(spark, sf_dir)
    rows = [(c, *b) for c, b in m.bounds.items()]
    # recomputed as a DataFrame over the imputed table (not from driver values)
    d = prep.impute(churn_base(spark, sf_dir).where(F.col(R.label).isNotNull()), m)
    b = prep.fit_bounds(d, R.numeric)
    assert len(rows) == len(R.numeric)
    return b.select("column", *[r(c).alias(c) for c in ("q1", "q3", "lower", "upper")])


@register("p4_binary_encode", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", v AS value, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code "
    f"FROM (SELECT DISTINCT {c} AS v FROM _imp)" for c in R.binary).join(["WITH " + prep_ctes() + "\n", ""]),
          ("churn_base",))
def p4(spark, sf_dir):
    m, _ = fitted(spark, sf_dir)
    d = prep.impute(churn_base(spark, sf_dir).where(F.col(R.label).isNotNull()), m)
    return prep.fit_categories(d, R.binary).select("column", "value", F.col("code").cast("int").alias("code"))


@register("p5_one_hot", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", v AS value, '{c}_' || v AS feature_name FROM (SELECT DISTINCT {c} AS v FROM _imp)"
    for c in R.multi).join(["WITH " + prep_ctes() + "\n", ""]), ("churn_base",))
def p5(spark, sf_dir):
    m, _ = fitted(spark, sf_dir)
    d = prep.impute(churn_base(spark, sf_dir).where(F.col(R.label).isNotNull()), m)
    c = prep.fit_categories(d, R.multi)
    return c.select("column", "value", F.concat_ws("_", "column", "value").alias("feature_name"))


@register("p6_p7_stratified_split", f"""WITH {prep_ctes()}
SELECT {R.id}, label, is_test FROM _enc""", ("churn_base",))
def p7(spark, sf_dir):
    _, enc = fitted(spark, sf_dir)
    return enc.select(R.id, "label", "is_test")


@register("p8_standard_scale", f"""WITH {prep_ctes()}
SELECT feature, round(mean, 4) AS mean, round(scale, 4) AS scale FROM _sc""", ("churn_base",))
def p8(spark, sf_dir):
    m, enc = fitted(spark, sf_dir)
    train = enc.where(~F.col("is_test"))
    fs = m.feature_columns
    # one aggregate pass over the training rows, then one row per feature
    one = train.agg(*[F.struct(F.avg(F.col(f"`{f}`")).alias("mean"),
                               F.stddev_pop(F.col(f"`{f}`")).alias("s")).alias(f"_{i}") for i, f in enumerate(fs)])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_{i}.mean").alias("mean"),
                                        F.col(f"_{i}.s").alias("s")) for i, f in enumerate(fs)]))
    out = one.select(rows.alias("x")).select("x.*")
    # means of charges reach 1e4..1e7: engines sum in different orders, so
    # compare at 4 decimals (~9 significant digits) rather than 6
    return out.select("feature", r("mean", 4).alias("mean"),
                      r(F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")), 4).alias("scale"))


@register("p8_scaled_train_frame", f"""WITH {prep_ctes()}
{long_of('_z', R.id)}""", ("churn_base",))
def p8z(spark, sf_dir):
    m, enc = fitted(spark, sf_dir)
    return _long(prep.transform(enc, m, keep=(R.id,)), R.id)


@register("p11_apply_to_new_rows", f"""WITH {prep_ctes()}, _typed AS ({_typed_sql()}), {apply_ctes()}
{long_of('_az', 'row_no')}""", ("churn_base", "churn_raw"))
def p11(spark, sf_dir):
    m, _ = fitted(spark, sf_dir)
    z = prep.apply_to_new_rows(typed_scoring_rows(spark, sf_dir), m, keep=("row_no",))
    return _long(z, "row_no")


def _strict_sql() -> str:
    """The scaled scoring frame where what is missing stays null."""
    enc = []
    for c in R.binary:
        enc.append(f"CASE WHEN (SELECT count(DISTINCT {c}) FROM _imp) <= 2 THEN CASE WHEN {c} = (SELECT max({c}) FROM _imp) AND "
                   f"(SELECT count(DISTINCT {c}) FROM _imp) = 2 THEN 1.0 WHEN {c} = (SELECT min({c}) FROM _imp) THEN 0.0 END END AS {c}")
    enc += [f"CAST({c} AS DOUBLE) AS {c}" for c in list(R.flag) + list(R.numeric)]
    enc += [f"CASE WHEN {c} = '{v_}' THEN 1.0 ELSE 0.0 END AS {q(c + '_' + v_)}" for c in R.multi for v_ in CATS[c]]
    z = ", ".join(f"({q(f)} - (SELECT mean FROM _sc WHERE feature = '{f}')) / (SELECT scale FROM _sc WHERE feature = '{f}') AS {q(f)}" for f in FEATURES)
    return f"""_senc AS MATERIALIZED (SELECT row_no, {', '.join(enc)} FROM _typed),
_sz AS MATERIALIZED (SELECT row_no, {z} FROM _senc)"""


@register("p13_apply_simple", f"""WITH {prep_ctes()}, _typed AS ({_typed_sql()}), {_strict_sql()}
{long_of('_sz', 'row_no')}""", ("churn_base", "churn_raw"))
def p13(spark, sf_dir):
    """Older apply path: no imputation and no unknown handling (nulls stay)."""
    m, _ = fitted(spark, sf_dir)
    z = prep.apply_to_new_rows(typed_scoring_rows(spark, sf_dir), m, keep=("row_no",), strict=True)
    return _long(z, "row_no")


#: Columns that the rows of the P12 query lack.
LACKING = ("partner", "monthly_charges", "internet_service")


@register("p12_align_columns", f"""WITH {prep_ctes()},
_typed AS (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS partner, CAST(NULL AS DOUBLE) AS monthly_charges, CAST(NULL AS VARCHAR) AS internet_service)
           FROM ({_typed_sql()})), {apply_ctes()}
{long_of('_az', 'row_no')}""", ("churn_base", "churn_raw"))
def p12(spark, sf_dir):
    """Rows without three expected columns, with one that nobody expects."""
    m, _ = fitted(spark, sf_dir)
    rows = typed_scoring_rows(spark, sf_dir).drop(*LACKING).withColumn("unexpected", F.lit(7))
    return _long(prep.apply_to_new_rows(rows, m, keep=("row_no",)), "row_no")


def _params_sql() -> str:
    parts = ["SELECT 'impute_median' AS stage, \"column\", 'median' AS key, round(median, 6) AS value FROM _pmed"]
    parts += [f"SELECT 'clip', \"column\", '{k}', round({k}, 6) FROM _bnd" for k in ("q1", "q3", "lower", "upper")]
    parts += [f"SELECT 'binary', '{c}', v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) FROM (SELECT DISTINCT {c} AS v FROM _imp) "
              f"WHERE (SELECT count(DISTINCT {c}) FROM _imp) <= 2" for c in R.binary]
    parts += [f"SELECT 'one_hot', '{c}', v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) FROM (SELECT DISTINCT {c} AS v FROM _imp)" for c in R.multi]
    parts += [f"SELECT 'scale', feature, '{k}', round({k}, 4) FROM _sc" for k in ("mean", "scale")]
    parts += [f"SELECT 'order', '{f}', 'position', {i}.0" for i, f in enumerate(FEATURES)]
    return f"WITH {prep_ctes()}\n" + " UNION ALL ".join(parts)


@register("p10_fitted_params", _params_sql(), ("churn_base",))
def p10(spark, sf_dir):
    m, _ = fitted(spark, sf_dir)
    rows = prep.params_table(m)
    return spark.createDataFrame(rows, "stage string, column string, key string, value double").withColumn(
        "value", F.when(F.col("stage") == "scale", r("value", 4)).otherwise(r("value")))


@register("v13_config_complete", f"""WITH {prep_ctes()}, _n AS (SELECT count(*) AS n FROM _sc)
SELECT 'whole' AS artefact, true AS config_complete, '' AS missing, n AS features FROM _n
UNION ALL SELECT 'no scaler', false, 'scaler', n FROM _n UNION ALL SELECT 'no encodings', false, 'encodings', n FROM _n
UNION ALL SELECT 'no order', false, 'feature order', 0 UNION ALL SELECT 'one scale lost', false, 'scaler values', n FROM _n""", ("churn_base",))
def v13(spark, sf_dir):
    """A saved configuration and four that lost a part, each read back from its files."""
    from tidemark.operators import artifact as A
    from tidemark.streaming.streams import scratch
    m, _ = fitted(spark, sf_dir)
    whole = scratch(spark, "v13-whole")
    A.save(spark, whole, m)
    table = spark.read.schema(A.SCHEMA).parquet(whole)
    first = m.feature_columns[0]
    lost = {"no scaler": F.col("stage") != "scale", "no encodings": ~F.col("stage").isin("binary", "one_hot"), "no order": F.col("stage") != "order",
            "one scale lost": ~((F.col("stage") == "scale") & (F.col("key") == "scale") & (F.col("column") == first))}
    out = A.missing_parts(table).withColumn("artefact", F.lit("whole"))
    for name, rule in lost.items():
        path = scratch(spark, "v13-part")
        table.where(rule).coalesce(1).write.mode("overwrite").parquet(path)
        out = out.unionByName(A.missing_parts(spark.read.schema(A.SCHEMA).parquet(path)).withColumn("artefact", F.lit(name)))
    return out.select("artefact", "config_complete", "missing", "features")
