"""Streaming queries: run to completion over files derived from the driver
tables, then read the sink back.  Oracles are the batch SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.stats import r
from tidemark.operators import prep
from tidemark.operators import score as XS
from tidemark.operators import validate as v
from tidemark.plans.catalog import register
from tidemark.plans.ingest_queries import _scoring_ctes, scoring_domains, scoring_input
from tidemark.plans.model_queries import naive_bayes
from tidemark.plans.prep_queries import fitted
from tidemark.plans.score_queries import SCORE_CTES
from tidemark.session import stored
from tidemark.sources import fixtures as X
from tidemark.streaming import streams as S


@register("st2_stream_over_limit", """
SELECT * FROM (SELECT client, time_bucket(INTERVAL 1 MINUTE, ts) AS minute, count(*) AS requests,
                     count(*) > 1 AS over_limit FROM requests GROUP BY client, minute)
WHERE minute + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM requests) - INTERVAL 10 MINUTE""",
          ("requests",))
def st2(spark, sf_dir):
    src = S.scratch(spark, "st2-src")
    reqs = X.requests(spark, sf_dir).select("client", "ts")
    S.stage_in_time_order(reqs, src, "ts", files=4)
    stream = S.file_stream(spark, src, reqs.schema)
    out, ck = S.scratch(spark, "st2-out"), S.scratch(spark, "st2-ck")
    agg = S.over_limit_stream(stream, limit=1)
    S.run_available(agg.writeStream.outputMode("append").format("parquet").option("path", out), ck)
    res = spark.read.parquet(out)
    return res.select("client", F.col("minute").cast("timestamp_ntz").alias("minute"), "requests", "over_limit")


@register("st3_stream_dedup", "SELECT user_id, count(DISTINCT user_id) AS rows_kept FROM events GROUP BY user_id")
def st3(spark, sf_dir):
    """One row per user over the whole table: the watermark spans the data."""
    src = S.scratch(spark, "st3-src")
    ev = X.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    S.stage_in_time_order(ev, src, "ts", files=4)
    days = ev.select(F.date_diff(F.max("ts"), F.min("ts")).alias("d")).first().d or 0
    out, ck = S.scratch(spark, "st3-out"), S.scratch(spark, "st3-ck")
    d = S.dedup_stream(S.file_stream(spark, src, ev.schema), "user_id", "ts", f"{days + 1} days")
    S.run_available(d.writeStream.outputMode("append").format("parquet").option("path", out), ck)
    return spark.read.parquet(out).groupBy("user_id").agg(F.count(F.lit(1)).alias("rows_kept"))


@register("st3_stream_first_rows", """
SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM events GROUP BY user_id""")
def st3_rows(spark, sf_dir):
    """The kept rows themselves: each user's earliest event, from keyed state."""
    src = S.scratch(spark, "st3r-src")
    ev = X.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    S.stage_in_time_order(ev, src, "ts", files=4)
    out, ck = S.scratch(spark, "st3r-out"), S.scratch(spark, "st3r-ck")
    d = S.first_rows_stream(S.file_stream(spark, src, ev.schema), "user_id", "ts", "event_id")
    S.run_available(d.writeStream.outputMode("append").format("parquet").option("path", out), ck)
    return spark.read.schema(ev.schema).parquet(out)


@register("st4_stream_latest_metric", """
SELECT job_id, metric_name, arg_max(metric_value, (recorded_at, event_id)) AS metric_value,
       max(recorded_at) AS recorded_at FROM metric_events GROUP BY ALL""", ("metric_events",))
def st4(spark, sf_dir):
    src = S.scratch(spark, "st4-src")
    m = X.metric_events(spark, sf_dir)
    S.stage_as_files(m, src, files=4, order="recorded_at")
    stream = S.file_stream(spark, src, m.schema)
    out, ck = S.scratch(spark, "st4-out"), S.scratch(spark, "st4-ck")
    S.upsert_batches(S.latest_metric_stream(stream), out, ck, mode="update")
    return S.latest_state(spark, out, ["job_id", "metric_name"]).select(
        "job_id", "metric_name", "metric_value", "recorded_at")


@register("st5_stream_churn_by_segment", """
SELECT contract AS segment, count(*) AS total_customers, CAST(count_if(churn) AS BIGINT) AS churned_customers
FROM churn_base WHERE contract IS NOT NULL AND churn IS NOT NULL GROUP BY contract""", ("churn_base",))
def st5(spark, sf_dir):
    src = S.scratch(spark, "st5-src")
    b = X.churn_base(spark, sf_dir).select("customer_id", "contract", "churn")
    S.stage_as_files(b, src, files=4, order="customer_id")
    stream = S.file_stream(spark, src, b.schema)
    out, ck = S.scratch(spark, "st5-out"), S.scratch(spark, "st5-ck")
    S.upsert_batches(S.churn_by_segment_stream(stream, "contract", "churn"), out, ck, mode="complete")
    return S.latest_state(spark, out, ["segment"]).select("segment", "total_customers", "churned_customers")


@register("st1_stream_score", f"""WITH {SCORE_CTES},
{_scoring_ctes()}
SELECT row_no, round(probability, 6) AS probability FROM _spred WHERE row_no NOT IN (SELECT row_no FROM _bad)""",
          ("churn_base", "churn_raw"))
def st1(spark, sf_dir):
    """Arriving raw customer rows: rows breaking a scoring rule go to a
    rejected sink, the rest are scored; both sinks from one foreachBatch."""
    m, _ = fitted(spark, sf_dir)
    nb = naive_bayes(spark, sf_dir)
    raw = scoring_input(spark, sf_dir)
    src = S.scratch(spark, "st1-src")
    S.stage_as_files(stored(raw), src, files=4, order="row_no")              # ranges are sampled: not from the source tables again
    stream = S.file_stream(spark, src, raw.schema)
    good, bad, ck = S.scratch(spark, "st1-good"), S.scratch(spark, "st1-bad"), S.scratch(spark, "st1-ck")
    domains = scoring_domains()

    def write(batch, batch_id):
        errs = v.scoring_errors(batch, domains).withColumn("_batch", F.lit(batch_id))
        errs.write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")
        errs = spark.read.schema(errs.schema).parquet(f"{bad}/batch={batch_id}")         # the rules run once
        ok = batch.join(errs.select("row_no").distinct(), "row_no", "left_anti")
        z = prep.apply_to_new_rows(v.typed_projection(ok), m, keep=("row_no",))
        XS.batch_score(z, nb, keep=("row_no",)).select("row_no", "probability") \
            .write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
    S.run_available(stream.writeStream.foreachBatch(write), ck)
    return spark.read.parquet(good).select("row_no", r("probability").alias("probability"))
