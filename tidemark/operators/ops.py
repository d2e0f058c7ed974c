"""Job, model-registry, notification and request-log operators
(J1..J17, M12, M13, M15..M17, M19, S10)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import ordered_prefix, round_half_up, top_k_per_key

QUEUED_TIMEOUT_MIN = 15      # fixed values: stale-job timeouts
RUNNING_TIMEOUT_MIN = 60
STALE_FAILED_MESSAGE = "Training job was interrupted before completion. Please start it again."
GUARDED_ROLE = "Admin"       # fixed value: the role that must keep a member
SLOW_REQUEST_SEC = 1.0
RATE_LIMIT_PER_MINUTE = 100
# Path parts that become {id}
UUID_SEGMENT = r"(?i)/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
NUMERIC_SEGMENT = r"/\d+"


def stale_jobs(jobs: DataFrame, versions: DataFrame, as_of: Column) -> DataFrame:
    """Queued >= 15 min or running >= 1 h before ``as_of``; completed
    when the same owner/dataset/type has a version trained at or after the
    job was created (its latest one), else failed.  Versions are reduced to
    the latest per key first, so the join is many-to-one (no pair blow-up).
    A running job's age counts from its start where that is known; a failed
    job keeps its progress."""
    key = ["owner_id", "dataset_id", "model_type"]
    latest = versions.groupBy(*key).agg(
        F.max("trained_at").alias("latest_trained_at"),
        F.max_by("version_id", F.struct("trained_at", "version_id")).alias("latest_version"))
    begun = F.when(F.col("status") == "running", F.coalesce("started_at", "created_at")).otherwise(F.col("created_at"))
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(begun)) / 60
    stale = jobs.where(((F.col("status") == "queued") & (age >= QUEUED_TIMEOUT_MIN))
                       | ((F.col("status") == "running") & (age >= RUNNING_TIMEOUT_MIN)))
    j = stale.join(latest, key, "left")
    done = F.coalesce(F.col("latest_trained_at") >= F.col("created_at"), F.lit(False))
    return j.select("job_id", *key, "status",
                    F.when(done, "completed").otherwise("failed").alias("new_status"),
                    F.when(done, F.col("latest_version")).alias("resolved_version"),
                    F.when(done, F.col("latest_trained_at")).otherwise(as_of).alias("completed_at"),
                    F.when(done, F.lit(100)).otherwise(F.col("progress_percent")).alias("progress_percent"),
                    F.when(~F.coalesce(done, F.lit(False)), F.lit(STALE_FAILED_MESSAGE)).alias("error_message"))


def list_jobs(jobs: DataFrame, statuses=None, owner_id: int | None = None) -> DataFrame:
    """All jobs with the given statuses (all if none), optionally of one
    owner, newest first within the owner (``position``)."""
    d = jobs.select("owner_id", "job_id", "status", "created_at")
    if statuses is not None:
        d = d.where(F.col("status").isin(list(statuses)))
    if owner_id is not None:
        d = d.where(F.col("owner_id") == owner_id)
    d = d.withColumn("_age", -F.unix_micros(F.col("created_at").cast("timestamp")))
    d = d.withColumn("_tie", -F.col("job_id"))
    return (ordered_prefix(d, "_age", [], key="owner_id", tie="_tie").drop("_age", "_tie")
            .withColumnRenamed("_pos", "position"))


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """Newest value per (job, metric); ties by the larger event id."""
    return metrics.groupBy("job_id", "metric_name").agg(
        F.max_by("metric_value", F.struct("recorded_at", "event_id")).alias("metric_value"),
        F.max("recorded_at").alias("recorded_at"))


def progress_history(metrics: DataFrame) -> DataFrame:
    """Iteration number per (job, metric) in time order, over range
    partitions (a hot job is split over many tasks)."""
    d = metrics.select("job_id", "metric_name", "event_id", "metric_value",
                       F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("_t"))
    p = ordered_prefix(d, "_t", [], key=["job_id", "metric_name"], tie="event_id")
    return p.select("job_id", "metric_name", F.col("_pos").alias("iteration"), "metric_value")


def notifications(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("notification_id"), F.col("user_id"),
                         F.col("event_type").alias("type"), F.col("ts").alias("created_at"),
                         F.col("event_type").isin("view", "click").alias("is_read"))


def newest_unread(notes: DataFrame, k: int = 50) -> DataFrame:
    """Newest ``k`` unread per user (salted two-stage top-k)."""
    unread = notes.where(~F.col("is_read"))
    return top_k_per_key(unread, "user_id", [F.col("created_at").desc(), F.col("notification_id").desc()], k)


def unread_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy("user_id").agg(F.count_if(~F.col("is_read")).alias("unread_count"))


def mark_read(notes: DataFrame, asked: DataFrame) -> DataFrame:
    """J5 update: ``asked(user_id, notification_id)`` marks one notification of a user, or
    with a null id all of theirs; a notification of another user is left alone.  Adds
    ``marked`` (newly read); notifications read before stay as they are."""
    everything = asked.where("notification_id IS NULL").select(F.col("user_id").alias("_u")).distinct().withColumn("_all", F.lit(True))
    one = asked.where("notification_id IS NOT NULL").select(F.col("user_id").alias("_o"), F.col("notification_id").alias("_n")).distinct().withColumn(
        "_one", F.lit(True))
    found = notes.join(everything, F.col("user_id") == F.col("_u"), "left").join(
        one, (F.col("user_id") == F.col("_o")) & (F.col("notification_id") == F.col("_n")), "left")
    marked = ~F.col("is_read") & F.coalesce("_all", "_one", F.lit(False))
    return found.withColumn("marked", marked).withColumn("is_read", F.col("is_read") | F.col("marked")).drop("_u", "_o", "_n", "_all", "_one")


def table_counts(spark, sf_dir, tables) -> DataFrame:
    """Row count per table, UNION ALL."""
    from tidemark.sources.tables import table
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
             for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def text_search(df: DataFrame, cols, term: str, current_col: str, current_value) -> DataFrame:
    """Case-insensitive substring over several columns (nulls never
    match), with ``position``: the current user first, then by that column."""
    t = term.lower()
    cond = None
    for c in cols:
        x = F.coalesce(F.lower(F.col(c)).contains(t), F.lit(False))
        cond = x if cond is None else cond | x
    found = df.where(cond).withColumn("is_current", F.coalesce(F.col(current_col) == F.lit(current_value), F.lit(False)))
    found = found.withColumn("_later", (~F.col("is_current")).cast("int"))
    return ordered_prefix(found, "_later", [], tie=current_col).drop("_later").withColumnRenamed("_pos", "position")


STATUS_PREFERENCE = {"running": 1, "completed": 2, "failed": 3}


def pick_by_status(jobs: DataFrame, key: str = "owner_id") -> DataFrame:
    """Per owner the first job that is processing, else ready, else
    failed; one grouped min_by."""
    rank = F.coalesce(*[F.when(F.col("status") == s, F.lit(v)) for s, v in STATUS_PREFERENCE.items()], F.lit(9))
    return jobs.groupBy(key).agg(F.min_by("job_id", F.struct(rank, F.col("job_id"))).alias("job_id"))


def model_dataset_lookup(versions: DataFrame, datasets: DataFrame) -> DataFrame:
    """Distinct dataset ids of the models with their file names."""
    ids = versions.select("dataset_id").distinct()
    return ids.join(datasets.select("dataset_id", "filename"), "dataset_id", "left")


def progress_percent(done: Column, total: Column) -> Column:
    """int(100 * done / total), 0 when total is 0, clamped to 0..100."""
    p = F.when(total > 0, F.floor(done * 100.0 / total)).otherwise(F.lit(0))
    return F.least(F.greatest(p, F.lit(0)), F.lit(100)).cast("int")


def normalise_path(path: Column) -> Column:
    """Uuid and numeric path segments to {id}."""
    return F.regexp_replace(F.regexp_replace(path, UUID_SEGMENT, "/{id}"), NUMERIC_SEGMENT, "/{id}")


def request_class(status: Column, response_ms: Column):
    """Slow flag (> 1 s) and level by status (>= 500 error, >= 400 warning)."""
    level = F.when(status >= 500, "error").when(status >= 400, "warning").otherwise("ok")
    return (response_ms / 1000 > SLOW_REQUEST_SEC), level


def client_ip(xff: Column, host: Column) -> Column:
    """First forwarded-for entry, trimmed; else the host; else unknown."""
    first = F.trim(F.split(xff, ",").getItem(0))
    return F.coalesce(F.when(F.coalesce(xff, F.lit("")) != "", first), host, F.lit("unknown"))


def over_limit(requests: DataFrame, limit: int = RATE_LIMIT_PER_MINUTE) -> DataFrame:
    """Requests per client and fixed minute; over when count > limit."""
    g = requests.groupBy("client", F.window("ts", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return g.select("client", F.col("w.start").alias("minute"), "requests",
                    (F.col("requests") > limit).alias("over_limit"))


def status_mapping(datasets: DataFrame) -> DataFrame:
    """Stored dataset status to what the UI shows (status, progress,
    step, error taken from the JSON ``error`` or ``duplicates`` field)."""
    st = F.col("status")
    shown = F.when(st == "ready", "completed").otherwise(st)
    progress = F.when(st.isin("ready", "failed"), 100).otherwise(0)
    step = (F.when(st == "processing", "Initializing...").when(st == "ready", "Complete")
            .when(st == "failed", "Failed").otherwise(F.initcap(st)))
    err = F.when(st == "failed", F.coalesce(F.get_json_object("validation_errors", "$.error"),
                                            F.get_json_object("validation_errors", "$.duplicates"),
                                            F.lit("Processing failed")))
    return datasets.select("dataset_id", "status", shown.alias("display_status"),
                           progress.cast("int").alias("progress"), step.alias("current_step"), err.alias("error"))


def last_of_role(users: DataFrame) -> DataFrame:
    """Users with whether removing them is refused (the last Admin)."""
    admins = users.where(F.col("role") == GUARDED_ROLE).select(F.count(F.lit(1))).scalar()
    return users.select("user_id", "role", "created_at",
                        ((F.col("role") == GUARDED_ROLE) & (admins <= 1)).alias("removal_refused"))


def version_string(model_type: Column, dataset_id: Column, ts: Column) -> Column:
    """``type_datasetprefix_YYYYMMDD_HHMMSS`` (type as given, first 8
    characters of the dataset id)."""
    return F.concat_ws("_", model_type, F.substring(dataset_id.cast("string"), 1, 8),
                       F.date_format(ts, "yyyyMMdd_HHmmss"))


def list_versions(versions: DataFrame, status: str | None = "active", sort_by: str = "f1", descending: bool = True,
                  owner_id: int | None = None, dataset_id: int | None = None, model_type: str | None = None,
                  key="model_type") -> DataFrame:
    """Filter by status, owner, dataset and type, then position per ``key``
    (model type) by any column (numbers, times, metrics), either direction; nulls come
    last, and a null type is a type of its own."""
    d = versions
    for column, value in (("status", status), ("owner_id", owner_id), ("dataset_id", dataset_id), ("model_type", model_type)):
        if value is not None:
            d = d.where(F.col(column) == value)
    o = F.col(sort_by)
    if dict(versions.dtypes)[sort_by].startswith("timestamp"):
        o = F.unix_micros(o.cast("timestamp"))
    d = d.withColumn("_o", F.coalesce((-o if descending else o).cast("double"), F.lit(float("inf"))))
    p = ordered_prefix(d, "_o", [], key=key, tie="version_id")
    return p.drop("_o").withColumnRenamed("_pos", "position")


def archive(versions: DataFrame, before: Column, at: Column) -> DataFrame:
    """Versions trained before ``before`` become archived."""
    hit = (F.col("trained_at") < before) & (F.col("status") == "active")
    return versions.withColumns({"status": F.when(hit, "archived").otherwise(F.col("status")),
                                 "archived_at": F.when(hit, at)})


def scoreable(predict_requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Archived versions are refused at scoring (semi join on active)."""
    return predict_requests.join(versions.where(F.col("status") == "active").select("version_id"),
                                 "version_id", "left_semi")


def best_model(versions: DataFrame, key: str | None = None) -> DataFrame:
    """Highest F1 of the (filtered) versions, or per key; the earliest version wins ties."""
    return versions.groupBy(*([key] if key else [])).agg(
        F.max_by("version_id", F.struct(F.col("f1"), -F.col("version_id"))).alias("version_id"),
        F.max("f1").alias("f1"))


def untrained_types(requests: DataFrame, types, versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """For each (owner, dataset) training request and each requested
    type: skipped as "already exists" (active version), skipped as
    "training in progress" (queued/running job), else trained.  Types come
    from a literal list; joins are on (owner, dataset, type) sets."""
    key = ["owner_id", "dataset_id", "model_type"]
    req = requests.select("owner_id", "dataset_id", F.explode(F.array(*[F.lit(t) for t in types])).alias("model_type"))
    active = versions.where(F.col("status") == "active").select(*key).distinct().withColumn("_a", F.lit(True))
    pending = (jobs.where(F.col("status").isin("queued", "running")).select(*key).distinct()
               .withColumn("_p", F.lit(True)))
    j = req.join(active, key, "left").join(pending, key, "left")
    decision = (F.when(F.col("_a"), "already exists").when(F.col("_p"), "training in progress")
                .otherwise("train"))
    return j.select(*key, decision.alias("decision"))


def comparison_table(versions: DataFrame, search: str | None = None) -> DataFrame:
    """F1 percent and training time with 2 decimals; text search."""
    vs = F.concat_ws("_", F.col("model_type"), F.col("version_id").cast("string"))
    d = versions.select("version_id", "model_type", vs.alias("version"),
                        round_half_up(F.col("f1") * 100, 2).alias("f1_percent"),
                        round_half_up("training_time_seconds", 2).alias("training_time_seconds"))
    if search:
        t = search.lower()
        d = d.where(F.lower("model_type").contains(t) | F.lower("version").contains(t))
    return d


def cascade_delete(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Children whose parent row was deleted are removed (anti join)."""
    return child.join(parent.select(key), key, "left_anti")


def cascade_counts(parent: DataFrame, children: dict, key: str) -> DataFrame:
    """Rows of each child table that go and stay when ``parent`` rows are deleted: (table_name, deleted, kept).

    Children without a parent (null key) stay."""
    gone = parent.select(F.col(key).alias("_gone")).where("_gone IS NOT NULL").distinct()
    out = None
    for name, child in children.items():
        n = child.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n")).join(gone, F.col("_key") == F.col("_gone"), "left")
        counts = n.agg(F.coalesce(F.sum(F.when(F.col("_gone").isNotNull(), F.col("n"))), F.lit(0)).alias("deleted"),
                       F.coalesce(F.sum(F.when(F.col("_gone").isNull(), F.col("n"))), F.lit(0)).alias("kept"))
        row = counts.select(F.lit(name).alias("table_name"), "deleted", "kept")
        out = row if out is None else out.unionByName(row)
    return out


def delete_history(metrics: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The metrics left after the history of the jobs in ``asked(job_id)`` is deleted, and
    (job_id, deleted_count) for every asked job, 0 where it had none."""
    asked = asked.select("job_id").where("job_id IS NOT NULL").distinct()
    counts = metrics.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"))
    deleted = asked.join(counts, "job_id", "left").select("job_id", F.coalesce("_n", F.lit(0)).alias("deleted_count"))
    return metrics.join(asked, "job_id", "left_anti"), deleted


def bulk_clear(spark, paths: dict) -> DataFrame:
    """Empty the stored tables ``{name: path}``; schemas stay.  Returns (table_name,
    deleted, remaining), the latter read back after the deletion; a rerun deletes 0."""
    done = []
    for name, path in paths.items():
        had = spark.read.parquet(path)
        n, schema = had.count(), had.schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
        done.append((name, n, spark.read.schema(schema).parquet(path).count()))
    return spark.createDataFrame(done, "table_name string, deleted long, remaining long")


def list_datasets(datasets: DataFrame, owner_id: int | None = None, per_owner: bool = False) -> DataFrame:
    """Datasets with ``position`` (newest first, unknown dates before all, ties by the
    larger id) and ``total``: all of them, one owner's, or every owner's own list."""
    d = datasets if owner_id is None else datasets.where(F.col("owner_id") == owner_id)
    d = d.withColumn("_newest", -F.unix_micros(F.col("uploaded_at").cast("timestamp"))).withColumn("_tie", -F.col("dataset_id"))
    key = "owner_id" if per_owner else None
    out = ordered_prefix(d, "_newest", [], key=key, tie="_tie").drop("_newest", "_tie").withColumnRenamed("_pos", "position")
    if not per_owner:
        return out.withColumn("total", datasets.where(F.lit(True) if owner_id is None else F.col("owner_id") == owner_id).select(
            F.count(F.lit(1))).scalar())
    totals = datasets.groupBy(F.col("owner_id").alias("_owner")).agg(F.count(F.lit(1)).alias("total"))
    return out.join(totals, F.col("owner_id").eqNullSafe(F.col("_owner"))).drop("_owner")


DEFAULT_THRESHOLD = 0.5      # fixed value: of a version that has none of its own


def set_thresholds(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes(version_id, threshold)``, one per version, stored with the versions:
    adds ``classification_threshold`` and ``refused`` (the message, where the value is
    null or not between 0 and 1; the version then keeps what it had).  Changes of unknown versions are
    listed by :func:`unknown_versions`."""
    had = F.col("classification_threshold") if "classification_threshold" in versions.columns else F.lit(DEFAULT_THRESHOLD)
    new = changes.select(F.col("version_id").alias("_v"), F.col("threshold").cast("double").alias("_t"), F.lit(True).alias("_asked"))
    ok = F.coalesce(F.col("_t").between(0.0, 1.0) & ~F.isnan("_t"), F.lit(False))
    return (versions.withColumn("_had", had).join(new, F.col("version_id") == F.col("_v"), "left")
            .withColumn("classification_threshold", F.when(ok, F.col("_t")).otherwise(F.col("_had")))
            .withColumn("refused", F.when(F.col("_asked") & ~ok, F.lit("Threshold must be between 0.0 and 1.0"))).drop("_had", "_v", "_t", "_asked"))


def unknown_versions(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes that name no version."""
    return changes.join(versions.select("version_id"), "version_id", "left_anti")


def decide(scored: DataFrame, versions: DataFrame) -> DataFrame:
    """M14 at scoring: ``scored(version_id, probability, ...)`` with the prediction under its
    version's own threshold (inclusive)."""
    own = versions.select(F.col("version_id").alias("_v"), "classification_threshold")
    return (scored.join(own, F.col("version_id") == F.col("_v"), "left").drop("_v")
            .withColumn("prediction", F.col("probability") >= F.coalesce("classification_threshold", F.lit(DEFAULT_THRESHOLD))))


def list_reports(reports: DataFrame, viewer_id=None, role: str | None = None) -> DataFrame:
    """R2: reports newest first with ``position``: all of them for an Admin, else the
    viewer's own.  Without a viewer: every owner's own list."""
    d = reports.withColumn("_newest", -F.unix_micros(F.col("generated_at").cast("timestamp"))).withColumn("_tie", -F.col("report_id"))
    if role == GUARDED_ROLE:
        key = None
    elif viewer_id is not None:
        d, key = d.where(F.col("owner_id") == viewer_id), None
    else:
        key = "owner_id"
    return ordered_prefix(d, "_newest", [], key=key, tie="_tie").drop("_newest", "_tie").withColumnRenamed("_pos", "position")
