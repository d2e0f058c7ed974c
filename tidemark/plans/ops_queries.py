"""Job, registry, notification, request-log and table-count queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.stats import r
from tidemark.operators import ops as O
from tidemark.plans.catalog import register
from tidemark.sources import fixtures as X
from tidemark.sources.tables import TABLES, table
from tidemark.streaming.streams import scratch

TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("j1_stale_jobs", """
WITH _asof AS (SELECT max(created_at) AS t FROM jobs),
_l AS (SELECT owner_id, dataset_id, model_type, max(trained_at) AS lt,
              arg_max(version_id, (trained_at, version_id)) AS lv FROM versions GROUP BY ALL),
_s AS (SELECT j.* FROM jobs j, _asof a
       WHERE (status = 'queued' AND date_diff('second', created_at, a.t) / 60 >= 15)
          OR (status = 'running' AND date_diff('second', coalesce(started_at, created_at), a.t) / 60 >= 60))
SELECT job_id, owner_id, dataset_id, model_type, status,
       CASE WHEN lt >= created_at THEN 'completed' ELSE 'failed' END AS new_status,
       CASE WHEN lt >= created_at THEN lv END AS resolved_version,
       CASE WHEN lt >= created_at THEN lt ELSE (SELECT t FROM _asof) END AS completed_at,
       CASE WHEN lt >= created_at THEN 100 ELSE progress_percent END AS progress_percent,
       CASE WHEN lt >= created_at THEN NULL ELSE 'Training job was interrupted before completion. Please start it again.' END AS error_message
FROM _s LEFT JOIN _l USING (owner_id, dataset_id, model_type)""", ("versions",))
def j1(spark, sf_dir):
    jobs = X.jobs(spark, sf_dir)
    as_of = jobs.select(F.max("created_at")).scalar()
    return O.stale_jobs(jobs, X.versions(spark, sf_dir), as_of)


@register("j2_list_jobs", """
SELECT owner_id, job_id, status, created_at,
       row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, job_id DESC) AS position
FROM jobs WHERE status IN ('queued', 'running')""", ("jobs",))
def j2(spark, sf_dir):
    return O.list_jobs(X.jobs(spark, sf_dir), ["queued", "running"])


@register("j3_latest_metrics", """
SELECT job_id, metric_name, arg_max(metric_value, (recorded_at, event_id)) AS metric_value,
       max(recorded_at) AS recorded_at FROM metric_events GROUP BY ALL""", ("metric_events",))
def j3(spark, sf_dir):
    return O.latest_metrics(X.metric_events(spark, sf_dir))


@register("j4_progress_history", """
SELECT job_id, metric_name, row_number() OVER (PARTITION BY job_id, metric_name ORDER BY recorded_at, event_id) AS iteration,
       metric_value FROM metric_events""", ("metric_events",))
def j4(spark, sf_dir):
    return O.progress_history(X.metric_events(spark, sf_dir))


@register("j5_newest_unread", """
SELECT notification_id, user_id, type, created_at, is_read, CAST(rank AS INTEGER) AS rank FROM (
  SELECT event_id AS notification_id, user_id, event_type AS type, ts AS created_at,
         event_type IN ('view', 'click') AS is_read,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank
  FROM events WHERE event_type NOT IN ('view', 'click')) WHERE rank <= 50""")
def j5(spark, sf_dir):
    n = O.notifications(table(spark, sf_dir, "events"))
    return O.newest_unread(n).withColumn("rank", F.col("rank").cast("int"))


@register("j5_unread_counts", """
SELECT user_id, CAST(count_if(event_type NOT IN ('view', 'click')) AS BIGINT) AS unread_count FROM events GROUP BY user_id""")
def j5c(spark, sf_dir):
    return O.unread_counts(O.notifications(table(spark, sf_dir, "events")))


def _asked(spark, sf_dir):
    """Who marks what: every third user all notifications, the others one, their newest unread."""
    notes = O.notifications(table(spark, sf_dir, "events"))
    everything = notes.where("user_id % 3 = 0").select("user_id", F.lit(None).cast("long").alias("notification_id")).distinct()
    one = O.newest_unread(notes, 1).where("user_id % 3 <> 0").select("user_id", "notification_id")
    return notes, everything.unionByName(one)


@register("j5_mark_read", """
WITH n AS (SELECT event_id AS notification_id, user_id, ts AS created_at, event_type IN ('view', 'click') AS is_read FROM events),
u AS (SELECT user_id, arg_max(notification_id, (created_at, notification_id)) AS newest FROM n WHERE NOT is_read AND user_id % 3 <> 0 GROUP BY user_id),
m AS (SELECT n.*, NOT is_read AND (n.user_id % 3 = 0 OR coalesce(notification_id = newest, false)) AS marked FROM n LEFT JOIN u USING (user_id))
SELECT notification_id, user_id, is_read OR marked AS is_read, marked FROM m""")
def j5_mark(spark, sf_dir):
    """Mark one, mark all: the notifications afterwards."""
    notes, asked = _asked(spark, sf_dir)
    return O.mark_read(notes, asked).select("notification_id", "user_id", "is_read", "marked")


@register("j6_table_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def j6(spark, sf_dir):
    return O.table_counts(spark, sf_dir, TABLES)


@register("j7_text_search", """
SELECT user_id, name, team, role, created_at, user_id = 0 AS is_current FROM users
WHERE coalesce(contains(lower(name), '00001'), false) OR coalesce(contains(lower(team), 'build'), false)
   OR coalesce(contains(lower(role), 'admin'), false)""", ("users",))
def j7(spark, sf_dir):
    # three search terms or-ed as the UI does over name, team and role
    u = X.users(spark, sf_dir)
    cond = (F.coalesce(F.lower("name").contains("00001"), F.lit(False))
            | F.coalesce(F.lower("team").contains("build"), F.lit(False))
            | F.coalesce(F.lower("role").contains("admin"), F.lit(False)))
    return u.where(cond).withColumn("is_current", F.col("user_id") == 0)


@register("j8_pick_by_status", """
SELECT owner_id, arg_min(job_id, (CASE status WHEN 'running' THEN 1 WHEN 'completed' THEN 2 WHEN 'failed' THEN 3 ELSE 9 END, job_id)) AS job_id
FROM jobs GROUP BY owner_id""", ("jobs",))
def j8(spark, sf_dir):
    return O.pick_by_status(X.jobs(spark, sf_dir))


@register("j9_model_dataset_lookup", """
SELECT v.dataset_id, d.filename FROM (SELECT DISTINCT dataset_id FROM versions) v
LEFT JOIN datasets d USING (dataset_id)""", ("versions", "datasets"))
def j9(spark, sf_dir):
    return O.model_dataset_lookup(X.versions(spark, sf_dir), X.datasets(spark, sf_dir))


@register("j10_progress_percent", """
SELECT owner_id, CAST(least(greatest(CASE WHEN count(*) > 0 THEN floor(count_if(status = 'completed') * 100.0 / count(*)) ELSE 0 END, 0), 100) AS INTEGER) AS progress
FROM jobs GROUP BY owner_id""", ("jobs",))
def j10(spark, sf_dir):
    g = X.jobs(spark, sf_dir).groupBy("owner_id").agg(F.count_if(F.col("status") == "completed").alias("d"),
                                                      F.count(F.lit(1)).alias("t"))
    return g.select("owner_id", O.progress_percent(F.col("d"), F.col("t")).alias("progress"))


@register("j11_path_normalise", f"""
SELECT regexp_replace(regexp_replace(coalesce(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1), ''),
         '{O.UUID_SEGMENT}', '/{{id}}', 'g'), '{O.NUMERIC_SEGMENT}', '/{{id}}', 'g') AS path,
       count(*) AS requests FROM pages GROUP BY 1""")
def j11(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    path = F.coalesce(F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)?", 1), F.lit(""))
    return p.groupBy(O.normalise_path(path).alias("path")).agg(F.count(F.lit(1)).alias("requests"))


@register("j12_request_class", """
SELECT response_ms / 1000 > 1.0 AS slow,
       CASE WHEN status_code >= 500 THEN 'error' WHEN status_code >= 400 THEN 'warning' ELSE 'ok' END AS level,
       count(*) AS requests FROM request_log GROUP BY ALL""", ("request_log",))
def j12(spark, sf_dir):
    log = X.request_log(spark, sf_dir)
    slow, level = O.request_class(F.col("status_code"), F.col("response_ms"))
    return log.groupBy(slow.alias("slow"), level.alias("level")).agg(F.count(F.lit(1)).alias("requests"))


@register("j13_client_ip", """
SELECT event_id, coalesce(CASE WHEN coalesce(x_forwarded_for, '') <> '' THEN trim(split_part(x_forwarded_for, ',', 1)) END,
                          host, 'unknown') AS client_ip FROM request_log""", ("request_log",))
def j13(spark, sf_dir):
    log = X.request_log(spark, sf_dir)
    return log.select("event_id", O.client_ip(F.col("x_forwarded_for"), F.col("host")).alias("client_ip"))


@register("j14_over_limit", """
SELECT client, time_bucket(INTERVAL 1 MINUTE, ts) AS minute, count(*) AS requests, count(*) > 1 AS over_limit
FROM requests GROUP BY ALL""", ("requests",))
def j14(spark, sf_dir):
    # fixture limit: at most 2 events per user and minute, so the limit is 1
    return O.over_limit(X.requests(spark, sf_dir), limit=1)


@register("j15_list_datasets", """
SELECT dataset_id, filename, status, uploaded_at, (SELECT count(*) FROM datasets) AS total,
       row_number() OVER (ORDER BY uploaded_at DESC, dataset_id DESC) AS position FROM datasets""",
          ("datasets",))
def j15(spark, sf_dir):
    return O.list_datasets(X.datasets(spark, sf_dir)).select("dataset_id", "filename", "status", "uploaded_at", "total", "position")


@register("j15_datasets_by_owner", """
SELECT owner_id, dataset_id, filename, count(*) OVER (PARTITION BY owner_id) AS total,
       row_number() OVER (PARTITION BY owner_id ORDER BY uploaded_at DESC, dataset_id DESC) AS position FROM datasets""",
          ("datasets",))
def j15_owner(spark, sf_dir):
    """Every owner's own list."""
    return O.list_datasets(X.datasets(spark, sf_dir), per_owner=True).select("owner_id", "dataset_id", "filename", "total", "position")


@register("j16_status_mapping", """
SELECT dataset_id, status, CASE status WHEN 'ready' THEN 'completed' ELSE status END AS display_status,
       CAST(CASE WHEN status IN ('ready', 'failed') THEN 100 ELSE 0 END AS INTEGER) AS progress,
       CASE status WHEN 'processing' THEN 'Initializing...' WHEN 'ready' THEN 'Complete' WHEN 'failed' THEN 'Failed'
            ELSE upper(substr(status, 1, 1)) || lower(substr(status, 2)) END AS current_step,
       CASE WHEN status = 'failed' THEN coalesce(json_extract_string(validation_errors, '$.error'),
            json_extract_string(validation_errors, '$.duplicates'), 'Processing failed') END AS error
FROM datasets""", ("datasets",))
def j16(spark, sf_dir):
    return O.status_mapping(X.datasets(spark, sf_dir))


@register("j17_last_of_role", """
SELECT user_id, role, created_at,
       role = 'Admin' AND (SELECT count(*) FROM users WHERE role = 'Admin') <= 1 AS removal_refused FROM users""",
          ("users",))
def j17(spark, sf_dir):
    return O.last_of_role(X.users(spark, sf_dir))


@register("m12_version_string", """
SELECT version_id, model_type || '_' || substr(CAST(dataset_id AS VARCHAR), 1, 8)
       || '_' || strftime(trained_at, '%Y%m%d_%H%M%S') AS version FROM versions""", ("versions",))
def m12(spark, sf_dir):
    v = X.versions(spark, sf_dir)
    return v.select("version_id", O.version_string(F.col("model_type"), F.col("dataset_id"),
                                                   F.col("trained_at")).alias("version"))


@register("m13_list_versions", """
SELECT version_id, model_type, f1, row_number() OVER (PARTITION BY model_type ORDER BY -f1, version_id) AS position
FROM versions WHERE status = 'active'""", ("versions",))
def m13(spark, sf_dir):
    return O.list_versions(X.versions(spark, sf_dir)).select("version_id", "model_type", "f1", "position")


@register("m15_archive", """
WITH _c AS (SELECT max(trained_at) - INTERVAL 730 DAY AS cut FROM versions)
SELECT version_id, CASE WHEN trained_at < cut AND status = 'active' THEN 'archived' ELSE status END AS status,
       CASE WHEN trained_at < cut AND status = 'active' THEN cut END AS archived_at FROM versions, _c""",
          ("versions",))
def m15(spark, sf_dir):
    v = X.versions(spark, sf_dir)
    cut = v.select(F.max("trained_at")).scalar() - F.expr("INTERVAL 730 DAYS")
    return O.archive(v, cut, cut).select("version_id", "status", "archived_at")


@register("m16_best_model", """
SELECT model_type, arg_max(version_id, (f1, -version_id)) AS version_id, max(f1) AS f1 FROM versions GROUP BY model_type""",
          ("versions",))
def m16(spark, sf_dir):
    return O.best_model(X.versions(spark, sf_dir), "model_type")


@register("m16_best_of_dataset", """
SELECT dataset_id, arg_max(version_id, (f1, -version_id)) AS version_id, max(f1) AS f1 FROM versions WHERE status = 'active' GROUP BY dataset_id""",
          ("versions",))
def m16_all(spark, sf_dir):
    """The best active version of every dataset."""
    return O.best_model(X.versions(spark, sf_dir).where("status = 'active'"), "dataset_id")


@register("m13_versions_by_training", """
SELECT version_id, dataset_id, model_type, trained_at,
       row_number() OVER (PARTITION BY dataset_id, model_type ORDER BY trained_at, version_id) AS position FROM versions""", ("versions",))
def m13_by_time(spark, sf_dir):
    """Versions of every dataset, any status, oldest first."""
    v = O.list_versions(X.versions(spark, sf_dir), status=None, sort_by="trained_at", descending=False, key=["dataset_id", "model_type"])
    return v.select("version_id", "dataset_id", "model_type", "trained_at", "position")


@register("m15_scoreable_requests", """
SELECT j.job_id AS request_id, v.version_id FROM jobs j JOIN versions v ON v.version_id = j.job_id
WHERE v.status = 'active'""", ("jobs", "versions"))
def m15_requests(spark, sf_dir):
    """Prediction requests that name an archived version are refused."""
    wanted = X.jobs(spark, sf_dir).select(F.col("job_id").alias("request_id"), F.col("job_id").alias("version_id"))
    return O.scoreable(wanted, X.versions(spark, sf_dir)).select("request_id", "version_id")


@register("m17_untrained_types", f"""
WITH _req AS (SELECT DISTINCT owner_id, dataset_id FROM jobs),
_r AS (SELECT owner_id, dataset_id, t.model_type FROM _req, (SELECT unnest({TYPES!r}) AS model_type) t),
_act AS (SELECT DISTINCT owner_id, dataset_id, model_type FROM versions WHERE status = 'active'),
_pen AS (SELECT DISTINCT owner_id, dataset_id, model_type FROM jobs WHERE status IN ('queued', 'running'))
SELECT r.owner_id, r.dataset_id, r.model_type,
       CASE WHEN a.owner_id IS NOT NULL THEN 'already exists'
            WHEN p.owner_id IS NOT NULL THEN 'training in progress' ELSE 'train' END AS decision
FROM _r r LEFT JOIN _act a USING (owner_id, dataset_id, model_type) LEFT JOIN _pen p USING (owner_id, dataset_id, model_type)""",
          ("versions",))
def m17(spark, sf_dir):
    """Every (owner, dataset) that has jobs asks for all five types."""
    jobs = X.jobs(spark, sf_dir)
    reqs = jobs.select("owner_id", "dataset_id").distinct()
    return O.untrained_types(reqs, TYPES, X.versions(spark, sf_dir), jobs)


@register("m19_comparison_table", """
SELECT version_id, model_type, model_type || '_' || version_id AS version,
       CAST(round(CAST(f1 * 100 AS DECIMAL(38,10)), 2) AS DOUBLE) AS f1_percent,
       CAST(round(CAST(training_time_seconds AS DECIMAL(38,10)), 2) AS DOUBLE) AS training_time_seconds FROM versions
WHERE contains(lower(model_type), 'high') OR contains(lower(model_type || '_' || version_id), 'high')""",
          ("versions",))
def m19(spark, sf_dir):
    return O.comparison_table(X.versions(spark, sf_dir), search="high")


@register("s10_dataset_cascade", """
SELECT j.* FROM jobs j WHERE dataset_id NOT IN (SELECT dataset_id FROM datasets WHERE status = 'failed')""",
          ("jobs", "datasets"))
def s10(spark, sf_dir):
    d = X.datasets(spark, sf_dir).where(F.col("status") == "failed")
    return O.cascade_delete(d, X.jobs(spark, sf_dir), "dataset_id")


_FAILED = "dataset_id IN (SELECT dataset_id FROM datasets WHERE status = 'failed')"


@register("s10_cascade_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST(count_if({_FAILED}) AS BIGINT) AS deleted, CAST(count_if(NOT {_FAILED}) AS BIGINT) AS kept FROM {t}"
    for t in ("jobs", "versions")), ("versions", "datasets"))
def s10_counts(spark, sf_dir):
    """Rows of the dependent tables that go with the failed datasets."""
    d = X.datasets(spark, sf_dir).where(F.col("status") == "failed")
    return O.cascade_counts(d, {"jobs": X.jobs(spark, sf_dir), "versions": X.versions(spark, sf_dir)}, "dataset_id")


@register("s10_history_left", "SELECT event_id, job_id, metric_name FROM metric_events WHERE job_id % 3 <> 0", ("metric_events",))
def s10_left(spark, sf_dir):
    """Metrics left after every third job's history was deleted."""
    m = X.metric_events(spark, sf_dir)
    return O.delete_history(m, m.select("job_id").where("job_id % 3 = 0"))[0].select("event_id", "job_id", "metric_name")


@register("s10_history_deleted", """
WITH _ask AS (SELECT DISTINCT c_custkey AS job_id FROM customer WHERE c_custkey % 3 = 0)
SELECT a.job_id, count(m.event_id) AS deleted_count FROM _ask a LEFT JOIN metric_events m USING (job_id) GROUP BY a.job_id""", ("metric_events",))
def s10_deleted(spark, sf_dir):
    """How many entries each asked job lost; jobs without history lose none."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id")).where("job_id % 3 = 0")
    return O.delete_history(X.metric_events(spark, sf_dir), asked)[1]


@register("s10_bulk_clear", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS deleted, CAST(0 AS BIGINT) AS remaining FROM {f}" for t, f in (
        ("training_progress", "metric_events"), ("model_versions", "versions"), ("training_jobs", "jobs"), ("notifications", "events"))),
          ("metric_events", "versions"))
def s10_clear(spark, sf_dir):
    """The four training tables written, emptied and counted again."""
    made = {"training_progress": X.metric_events(spark, sf_dir), "model_versions": X.versions(spark, sf_dir),
            "training_jobs": X.jobs(spark, sf_dir), "notifications": O.notifications(table(spark, sf_dir, "events"))}
    paths = {name: scratch(spark, f"s10-{name}") for name in made}
    for name, df in made.items():
        df.write.parquet(paths[name])
    return O.bulk_clear(spark, paths)


@register("r2_list_reports", """
WITH _own AS (SELECT owner_id, count(*) AS n FROM versions GROUP BY owner_id)
SELECT u.user_id, u.role, CASE WHEN u.role = 'Admin' THEN (SELECT count(*) FROM versions) ELSE coalesce(o.n, 0) END AS visible_reports,
       (SELECT max(trained_at) FROM versions v WHERE u.role = 'Admin' OR v.owner_id = u.user_id) AS newest_report_at
FROM users u LEFT JOIN _own o ON o.owner_id = u.user_id""", ("versions", "users"))
def r2(spark, sf_dir):
    """Reports (one per model version): a user sees their own, an admin all.
    Counted per viewer from per-owner aggregates, never as viewer x report
    pairs."""
    rep = X.versions(spark, sf_dir)
    own = rep.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"), F.max("trained_at").alias("newest"))
    total = rep.select(F.count(F.lit(1))).scalar()
    newest = rep.select(F.max("trained_at")).scalar()
    u = X.users(spark, sf_dir)
    j = u.join(own, u.user_id == own.owner_id, "left")
    admin = F.col("role") == "Admin"
    return j.select("user_id", "role",
                    F.when(admin, total).otherwise(F.coalesce("n", F.lit(0))).alias("visible_reports"),
                    F.when(admin, newest).otherwise(F.col("newest")).alias("newest_report_at"))


# ---- stored thresholds, report lists

_CHANGES = "SELECT version_id, CASE WHEN version_id % 7 = 0 THEN 1.5 ELSE (version_id % 101) / 100 END AS threshold FROM versions WHERE version_id % 3 = 0"
_STORED = f"""_chg AS ({_CHANGES}),
_ver AS (SELECT v.*, CASE WHEN c.threshold BETWEEN 0 AND 1 THEN c.threshold ELSE 0.5 END AS classification_threshold,
                CASE WHEN c.version_id IS NOT NULL AND NOT c.threshold BETWEEN 0 AND 1 THEN 'Threshold must be between 0.0 and 1.0' END AS refused
         FROM versions v LEFT JOIN _chg c USING (version_id))"""


def stored_versions(spark, sf_dir):
    """Every third version gets a threshold of its own; some asked values are out of range."""
    v = X.versions(spark, sf_dir)
    asked = v.where("version_id % 3 = 0").select("version_id", F.when(F.col("version_id") % 7 == 0, 1.5).otherwise((F.col("version_id") % 101) / 100).alias("threshold"))
    return O.set_thresholds(v, asked)


@register("m14_stored_threshold", f"WITH {_STORED} SELECT version_id, classification_threshold, refused FROM _ver", ("versions",))
def m14_stored(spark, sf_dir):
    return stored_versions(spark, sf_dir).select("version_id", "classification_threshold", "refused")


@register("m14_decisions_by_version", f"""WITH {_STORED},
_best AS (SELECT dataset_id, arg_max(version_id, (f1, -version_id)) AS version_id FROM _ver WHERE status = 'active' GROUP BY dataset_id),
_row AS (SELECT o_orderkey AS row_id, CAST(c_nationkey AS BIGINT) AS dataset_id, (o_orderkey % 1000) / 1000 AS probability
         FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT r.row_id, b.version_id, r.probability >= coalesce(v.classification_threshold, 0.5) AS prediction
FROM _row r JOIN _best b USING (dataset_id) JOIN _ver v ON v.version_id = b.version_id""", ("versions",))
def m14_decisions(spark, sf_dir):
    """Scored rows decided by the stored threshold of their dataset's best version."""
    v = stored_versions(spark, sf_dir)
    best = O.best_model(v.where("status = 'active'"), "dataset_id").select("dataset_id", "version_id")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("row_id"), F.col("c_nationkey").cast("long").alias("dataset_id"), ((F.col("o_orderkey") % 1000) / 1000).alias("probability"))
    return O.decide(rows.join(best, "dataset_id"), v).select("row_id", "version_id", "prediction")


def reports(spark, sf_dir):
    """One report per model version, generated when it was trained."""
    return X.versions(spark, sf_dir).select(F.col("version_id").alias("report_id"), "owner_id", F.col("trained_at").alias("generated_at"))


@register("r2_report_rows", """
SELECT version_id AS report_id, owner_id, trained_at AS generated_at,
       row_number() OVER (PARTITION BY owner_id ORDER BY trained_at DESC, version_id DESC) AS position FROM versions""", ("versions",))
def r2_rows(spark, sf_dir):
    """Every owner's own reports, newest first."""
    return O.list_reports(reports(spark, sf_dir)).select("report_id", "owner_id", "generated_at", "position")


@register("r2_admin_rows", """
SELECT version_id AS report_id, owner_id, trained_at AS generated_at,
       row_number() OVER (ORDER BY trained_at DESC, version_id DESC) AS position FROM versions""", ("versions",))
def r2_admin(spark, sf_dir):
    """What an Admin sees: all reports, newest first."""
    return O.list_reports(reports(spark, sf_dir), role="Admin").select("report_id", "owner_id", "generated_at", "position")


@register("j7_search_own_first", """
SELECT user_id, name, user_id = 5 AS is_current, row_number() OVER (ORDER BY user_id <> 5, user_id) AS position FROM users
WHERE coalesce(contains(lower(name), '005'), false) OR coalesce(contains(lower(team), '005'), false) OR coalesce(contains(lower(role), '005'), false)""",
          ("users",))
def j7_own_first(spark, sf_dir):
    """One term over three columns; the current user comes first."""
    return O.text_search(X.users(spark, sf_dir), ["name", "team", "role"], "005", "user_id", 5).select("user_id", "name", "is_current", "position")
