"""Streams resume from their checkpoint and end equal to the batch result."""
from pyspark.sql import functions as F

from tidemark.operators import ops
from tidemark.sources import fixtures as X
from tidemark.streaming import streams as S

from .conftest import SF_SMALL


def test_latest_metric_stream_resumes_after_restart(spark):
    m = X.metric_events(spark, SF_SMALL)
    cut = m.select(F.percentile_approx(F.unix_micros(F.col("recorded_at").cast("timestamp")), 0.5)).first()[0]
    t = F.unix_micros(F.col("recorded_at").cast("timestamp"))
    src, out, ck = S.scratch(spark, "t-src"), S.scratch(spark, "t-out"), S.scratch(spark, "t-ck")
    m.where(t <= cut).coalesce(1).write.parquet(src)
    S.upsert_batches(S.latest_metric_stream(S.file_stream(spark, src, m.schema)), out, ck)
    # "restart": new data arrives, the query starts again on the same checkpoint
    m.where(t > cut).coalesce(1).write.mode("append").parquet(src)
    S.upsert_batches(S.latest_metric_stream(S.file_stream(spark, src, m.schema)), out, ck)
    got = S.latest_state(spark, out, ["job_id", "metric_name"]).select("job_id", "metric_name", "metric_value")
    want = ops.latest_metrics(m).select("job_id", "metric_name", "metric_value")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_over_limit_stream_equals_batch_for_closed_windows(spark):
    r = X.requests(spark, SF_SMALL).select("client", "ts")
    src, out, ck = S.scratch(spark, "t2-src"), S.scratch(spark, "t2-out"), S.scratch(spark, "t2-ck")
    S.stage_in_time_order(r, src, "ts", files=3)
    q = S.over_limit_stream(S.file_stream(spark, src, r.schema), limit=1)
    S.run_available(q.writeStream.outputMode("append").format("parquet").option("path", out), ck)
    got = spark.read.parquet(out).select("client", F.col("minute").cast("timestamp_ntz").alias("minute"), "requests")
    end = r.select(F.max("ts")).first()[0]
    import datetime
    want = (ops.over_limit(r, limit=1)
            .where(F.col("minute") + F.expr("INTERVAL 1 MINUTE") <= F.lit(end - datetime.timedelta(minutes=10)))
            .select("client", "minute", "requests"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_task_sends_one_row_per_key():
    """Of many batches a task sends each key's earliest row once, not once a batch."""
    import pyarrow as pa
    batches = [pa.RecordBatch.from_pydict({"k": [1, 2, None], "t": [50 - i, i + 5, None], "e": [i, 100 - i, -i]}) for i in range(40)]
    out = pa.Table.from_batches(list(S._earliest("k", "t", "e")(iter(batches)))).to_pylist()
    assert sorted(out, key=str) == sorted([{"k": 1, "t": 11, "e": 39}, {"k": 2, "t": 5, "e": 100}, {"k": None, "t": None, "e": -39}], key=str)
    assert list(S._earliest("k", "t", "e")(iter([]))) == []


def test_held_rows_are_bounded(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(S, "HELD", 10)
    monkeypatch.setattr(S, "KEYS", 20)
    batches = [pa.RecordBatch.from_pydict({"k": [i * 5 + j for j in range(5)] + [7], "t": [i] * 6, "e": [i] * 6}) for i in range(30)]
    rows = pa.Table.from_batches(list(S._earliest("k", "t", "e")(iter(batches)))).to_pylist()
    first = {}
    for r in sorted(rows, key=lambda r: (r["t"], r["e"])):
        first.setdefault(r["k"], r["t"])
    assert first == {k: 0 if k == 7 else k // 5 for k in range(150)}


def test_stream_score_runs_the_rules_once_and_fits_from_columns(spark, monkeypatch):
    from tidemark.operators import prep
    from tidemark.plans import stream_queries
    from tidemark.roles import FIXTURE
    _, enc = prep.fit(X.churn_base(spark, SF_SMALL), FIXTURE)
    assert enc.inputFiles() and all(f.endswith(".parquet") for f in enc.inputFiles())
    seen, plain = [], stream_queries.v.scoring_errors

    def counted(batch, domains):
        hits = batch.sparkSession.sparkContext.accumulator(0)
        seen.append((hits, batch.count()))

        def passing(batches):
            for b in batches:
                hits.add(b.num_rows)
                yield b
        return plain(batch.mapInArrow(passing, batch.schema), domains)
    monkeypatch.setattr(stream_queries.v, "scoring_errors", counted)
    assert stream_queries.st1(spark, SF_SMALL).count() > 0
    assert seen and all(hits.value == rows for hits, rows in seen)
