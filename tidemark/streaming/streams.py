"""Structured Streaming forms of the batch operators (ST1..ST5).

Each function takes a streaming DataFrame and returns a started query (or
the streaming DataFrame to start).  Sinks are files with a checkpoint
location in the shared checkpoint folder, so a restarted query resumes
exactly where it stopped; aggregates in update mode are written by
``foreachBatch`` as (batch_id, row) appends and the newest row per key is
the current state.
"""
from __future__ import annotations

import uuid

import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

WATERMARK = "10 minutes"
#: Rows that a task collects before it reduces them to the earliest per key, keys it holds at most.
HELD, KEYS = 200_000, 1_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/streams/{name}-{uuid.uuid4().hex[:12]}"


def stage_as_files(df: DataFrame, path: str, files: int = 4, order: str | None = None) -> None:
    """Write a batch table as several parquet files: the stream's arrivals."""
    (df.repartitionByRange(files, order) if order else df.repartition(files)).write.parquet(path)


def stage_in_time_order(df: DataFrame, path: str, time_col: str, files: int = 4) -> None:
    """Write ``files`` time slices one after another, so file arrival order
    follows event time (the file source reads oldest files first)."""
    cuts = df.select(F.unix_micros(F.col(time_col).cast("timestamp")).cast("double").alias("_t")).approxQuantile(
        "_t", [i / files for i in range(1, files)], 0.001)     # slices need not be exact
    t = F.unix_micros(F.col(time_col).cast("timestamp")).cast("double")
    bounds = [None] + cuts + [None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (t > lo)
        if hi is not None:
            cond = cond & (t <= hi)
        df.where(cond).repartition(1).write.mode("append").parquet(path)


def file_stream(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_available(query_builder, checkpoint: str):
    """Start with ``availableNow`` (process what is there, then stop)."""
    q = query_builder.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def over_limit_stream(requests: DataFrame, limit: int) -> DataFrame:
    """ST2: J14 with late data: watermark, fixed one-minute windows, append."""
    r = requests.withColumn("ts", F.col("ts").cast("timestamp"))
    g = (r.withWatermark("ts", WATERMARK)
         .groupBy("client", F.window("ts", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("requests")))
    return g.select("client", F.col("w.start").alias("minute"), F.col("w.end").alias("minute_end"), "requests",
                    (F.col("requests") > limit).alias("over_limit"))


def dedup_stream(rows: DataFrame, key: str, time_col: str, watermark: str = WATERMARK) -> DataFrame:
    """ST3: first row per key within the watermark, which bounds the state."""
    r = rows.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return r.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark([key])


def _earliest(key: str, time_col: str, tie: str):
    """Per task the earliest row of each key (of every ``KEYS`` of them): what a hot key sends to its task."""
    def earliest(t):
        t = t.sort_by([(time_col, "ascending"), (tie, "ascending")])
        first = t.append_column("__at", pa.array(range(t.num_rows), pa.int64())).group_by(key).aggregate([("__at", "min")])["__at_min"]
        return t.take(first).combine_chunks()

    def reduce(batches):
        held, rows, known = [], 0, 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows >= max(HELD, 2 * known):
                held = [earliest(pa.concat_tables(held))]
                rows = known = held[0].num_rows
                if known >= KEYS:
                    yield from held[0].to_batches()
                    held, rows, known = [], 0, 0
        if rows:
            yield from earliest(pa.concat_tables(held)).to_batches()
    return reduce


def first_rows_stream(rows: DataFrame, key: str, time_col: str, tie: str, horizon: str | None = None) -> DataFrame:
    """ST3: the earliest row per key, emitted in the micro-batch in which the key first arrives.

    Of a key's rows in that micro-batch the one with the smallest (time, tie) is kept.  The state is one
    flag per key; with a ``horizon`` (an interval such as ``"1 day"``) it is dropped by a timer once the watermark has
    passed the kept row by that much, after which the key counts as new; without one the keys are kept for good.  A null key is
    a key; rows whose time is null come after the others and start no timer.  Restarts resume from the checkpoint."""
    names, schema = rows.columns, rows.schema
    d = rows.mapInArrow(_earliest(key, time_col, tie), schema)
    span = None
    if horizon is not None:
        span = int(pd.Timedelta(horizon).total_seconds() * 1000)
        d = d.withColumn("__time", F.col(time_col).cast("timestamp")).withWatermark("__time", horizon)

    def first(_, chunks, state):
        if state.hasTimedOut:
            state.remove()
            return
        known, best = state.exists, None
        for c in chunks:                                                     # a row per task that saw the key
            if not known and len(c):
                best = c if best is None else pd.concat([best, c])
                if len(best) > 1:
                    best = best.sort_values([time_col, tie], na_position="last").head(1)
        if best is None:
            return
        state.update((True,))
        at = best[time_col].iloc[0]
        if span is not None and not pd.isna(at):
            state.setTimeoutTimestamp(max(int(pd.Timestamp(at).timestamp() * 1000) + span, state.getCurrentWatermarkMs() + 1))
        yield best if list(best.columns) == names else best[names]

    return d.groupBy(key).applyInPandasWithState(
        first, schema, "seen boolean", "append", "NoTimeout" if horizon is None else "EventTimeTimeout")


def latest_metric_stream(metrics: DataFrame) -> DataFrame:
    """ST4: J3 continuously (emit in update mode)."""
    return metrics.groupBy("job_id", "metric_name").agg(
        F.max_by("metric_value", F.struct("recorded_at", "event_id")).alias("metric_value"),
        F.max("recorded_at").alias("recorded_at"))


def churn_by_segment_stream(rows: DataFrame, segment: str, label: str) -> DataFrame:
    """ST5: E4 continuously (complete mode keeps one row per segment)."""
    d = rows.where(F.col(segment).isNotNull() & F.col(label).isNotNull())
    return d.groupBy(F.col(segment).alias("segment")).agg(
        F.count(F.lit(1)).alias("total_customers"), F.count_if(F.col(label)).alias("churned_customers"))


def upsert_batches(agg: DataFrame, out: str, checkpoint: str, mode: str = "update"):
    """Write an aggregate stream's changed rows per micro-batch as appends
    tagged with the batch id (idempotent per batch: the batch folder is
    overwritten on replay)."""
    def write(batch: DataFrame, batch_id: int):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return run_available(agg.writeStream.outputMode(mode).foreachBatch(write), checkpoint)


def latest_state(spark: SparkSession, out: str, keys) -> DataFrame:
    """Current state from the upsert log: the newest batch's row per key."""
    log = spark.read.parquet(out)
    return log.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in log.columns if c not in keys and c != "batch"]),
                                           F.col("batch")).alias("s")).select(*keys, "s.*").drop("_batch")
