"""Source/sink round trips over tables derived from the driver data."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.stats import r
from tidemark.operators import validate as v
from tidemark.plans.catalog import register
from tidemark.plans.ingest_queries import SCORE_COLS, _domains, _rules_sql, _typed_sql
from tidemark.plans.score_queries import SCORE_CTES, SCORE_TYPED, explanations, export_sql, x13
from tidemark.roles import REQUIRED_CSV_COLUMNS
from tidemark.session import stored
from tidemark.sources import io
from tidemark.sources.fixtures import RAW_COLUMNS, churn_raw
from tidemark.streaming.streams import scratch


@register("s1_csv_scan", "SELECT CAST(row_no AS VARCHAR) AS row_no, " + ", ".join(
    f"CASE WHEN \"{c}\" = '' THEN NULL ELSE \"{c}\" END AS \"{c}\"" for c in RAW_COLUMNS) + " FROM churn_raw",
          ("churn_raw",))
def s1(spark, sf_dir):
    """Raw table written as a header CSV, then scanned back as strings.
    Empty fields come back as nulls (CSV cannot tell them apart)."""
    path = scratch(spark, "s1-csv")
    io.write_csv(churn_raw(spark, sf_dir), path)
    df = io.csv_scan(spark, path)
    return df.select(*[F.when(F.col(c) == "", None).otherwise(F.col(c)).alias(c) for c in df.columns])


@register("s2_score_csv_scan")
def s2(spark, sf_dir):
    path = scratch(spark, "s2-csv")
    io.write_csv(churn_raw(spark, sf_dir).select("row_no", *SCORE_COLS), path)
    return io.score_csv_scan(spark, path, SCORE_COLS)


#: Uploads of V1: what their files lack.
UPLOADS = {"whole": (), "no_charges": ("MonthlyCharges", "TotalCharges"), "no_label": ("Churn",)}


def _v1_sql() -> str:
    parts = []
    for name, gone in UPLOADS.items():
        missing = sorted(set(REQUIRED_CSV_COLUMNS) - (set(RAW_COLUMNS) - set(gone)))
        parts += [f"SELECT '{name}' AS upload, '{m}' AS missing_column, (SELECT count(*) FROM churn_raw) AS data_rows" for m in missing]
    return " UNION ALL ".join(parts)


@register("v1_required_columns", _v1_sql(), ("churn_raw",))
def v1(spark, sf_dir):
    """Required columns that the headers of uploaded files lack, with the rows each file holds."""
    raw, out = stored(churn_raw(spark, sf_dir).select(*RAW_COLUMNS)), None
    for name, gone in UPLOADS.items():
        path = scratch(spark, f"v1-{name}")
        io.write_csv(raw.drop(*gone), path)
        upload = io.csv_scan(spark, path)
        missing = v.required_columns(upload).select(
            F.lit(name).alias("upload"), "missing_column", upload.select(F.count(F.lit(1))).scalar().alias("data_rows"))
        out = missing if out is None else out.unionByName(missing)
    return out


@register("s4_records_sink", f"WITH _typed AS ({_typed_sql()})\nSELECT * REPLACE (round(monthly_charges, 6) AS monthly_charges, "
          f"round(total_charges, 6) AS total_charges) FROM _typed", ("churn_raw",))
def s4(spark, sf_dir):
    """Typed rows appended partitioned by dataset (here the contract
    segment), read back whole."""
    path = scratch(spark, "s4-records")
    typed = v.typed_projection(churn_raw(spark, sf_dir)).withColumn("dataset_id", F.coalesce("contract", F.lit("none")))
    io.records_sink(typed, path, "dataset_id")
    back = spark.read.parquet(path)
    return back.select(*[c for c in typed.columns if c != "dataset_id"]).withColumns(
        {"monthly_charges": r("monthly_charges"), "total_charges": r("total_charges")})


@register("s5_all_or_nothing", f"""
WITH _d AS (SELECT row_no, trim("customerID") AS id FROM churn_raw WHERE trim("customerID") <> ''),
_f AS (SELECT id, min(row_no) AS first_row FROM _d GROUP BY id),
_e AS (SELECT row_no FROM ({_rules_sql()}) UNION ALL SELECT row_no FROM _d JOIN _f USING (id) WHERE row_no > first_row)
SELECT 'as_uploaded' AS load, 'failed' AS status, (SELECT count(*) FROM _e) AS error_count, CAST(0 AS BIGINT) AS rows_written
UNION ALL SELECT 'mended', 'ready', 0, (SELECT count(*) FROM churn_raw WHERE row_no NOT IN (SELECT row_no FROM _e))""", ("churn_raw",))
def s5(spark, sf_dir):
    """The file as uploaded fails and writes nothing; without its faulty rows it is written whole."""
    raw = stored(churn_raw(spark, sf_dir))
    bad = stored(_load_errors(raw))
    mended = raw.join(bad.select("row_no").distinct(), "row_no", "left_anti")
    out = None
    for name, rows, errors in (("as_uploaded", raw, bad), ("mended", mended, _load_errors(mended))):
        typed = v.typed_projection(rows).withColumn("dataset_id", F.lit(name))
        one = io.all_or_nothing(typed, errors, scratch(spark, f"s5-{name}"), "dataset_id").select(F.lit(name).alias("load"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _load_errors(raw):
    return v.validation_errors(raw, _domains()).unionByName(
        v.duplicate_ids(raw).select("row_no", F.lit(99).alias("rule_no"), F.lit("customerID").alias("column"),
                                    F.lit("duplicate").alias("message")))


@register("s6_predictions_export", f"""WITH {SCORE_CTES}
SELECT CAST(t.row_no AS VARCHAR) AS row_no, {', '.join(f"nullif({export_sql(c)}, '') AS {c}" for c in SCORE_TYPED)},
  printf('%.2f', s.probability) AS "Churn_Probability",
  CASE WHEN s.probability >= 0.5 THEN 'Yes' ELSE 'No' END AS "Churn_Prediction"
FROM _typed t JOIN _spred s USING (row_no)""", ("churn_base", "churn_raw"))
def s6(spark, sf_dir):
    """Export rows written as CSV and read back (empty fields as nulls)."""
    path = scratch(spark, "s6-export")
    io.write_csv(x13(spark, sf_dir), path)
    df = io.csv_scan(spark, path)
    return df.select(*[F.when(F.col(c) == "", None).otherwise(F.col(c)).alias(c) for c in df.columns])


@register("s7_json_columns", f"""WITH {SCORE_CTES}
SELECT row_no, feature, round(contribution, 6) AS contribution FROM _contrib""", ("churn_base", "churn_raw"))
def s7(spark, sf_dir):
    """Contributions stored as JSON text, loaded back as typed structs."""
    e = io.to_payload(explanations(spark, sf_dir).select("row_no", "contributions"), "contributions")
    back = io.from_payload(e, "contributions", "array<struct<feature:string,value:double,contribution:double>>")
    return back.select("row_no", F.explode("contributions").alias("c")).select(
        "row_no", F.col("c.feature").alias("feature"), r("c.contribution").alias("contribution"))


@register("s8_content_dedup")
def s8(spark, sf_dir):
    """Uploaded files (the table files themselves) hashed by content; each
    points at the newest reusable dataset with the same bytes."""
    up = io.content_hashes(spark, f"{sf_dir.rstrip('/')}/*.parquet")
    ds = up.select(F.col("file_name").alias("dataset_id"), "sha256", "uploaded_at",
                   F.lit("ready").alias("status"))
    return io.reuse_by_hash(up, ds).select("file_name", "sha256", "length", "reuse_dataset_id")


@register("s3_dataset_scan", """
SELECT b.customer_id, CAST(c.c_nationkey AS BIGINT) AS dataset_id, b.churn, b.contract, round(b.total_charges, 6) AS total_charges
FROM churn_base b JOIN customer c ON c.c_custkey = b.customer_id
WHERE CAST(c.c_nationkey AS BIGINT) IN (SELECT dataset_id FROM datasets WHERE status = 'ready')""",
          ("churn_base", "datasets"))
def s3(spark, sf_dir):
    """Customer records belong to the dataset of their nation; only ready
    datasets are readable."""
    from tidemark.sources.fixtures import churn_base, datasets
    from tidemark.sources.tables import table
    recs = churn_base(spark, sf_dir).join(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"),
                                                F.col("c_nationkey").cast("long").alias("dataset_id")),
        "customer_id")
    out = io.dataset_scan(recs, datasets(spark, sf_dir))
    return out.select("customer_id", "dataset_id", "churn", "contract", r("total_charges").alias("total_charges"))
