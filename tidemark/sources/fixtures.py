"""Derived inputs (FIXTURES.md section 3), each in two forms:

* a Spark builder ``name(spark, sf_dir) -> DataFrame``;
* an equivalent DuckDB CTE body in ``FIXTURE_SQL[name]`` for oracles.

The churn fixture turns TPC-H-like orders into a customer churn table:
``snap = max(o_orderdate) - 365 days``; features use orders before ``snap``,
the label is "no order on or after snap".
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.roles import FIXTURE, FIXTURE_CSV_NAMES
from tidemark.sources.tables import table

SNAP_DAYS = 365


def _yes_no(cond: Column) -> Column:
    return F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))


def churn_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    lineitem = table(spark, sf_dir, "lineitem")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")

    # Global snapshot date as a scalar subquery (evaluated once, no driver round trip).
    snap = orders.select(F.max("o_orderdate")).scalar() - F.expr(f"INTERVAL {SNAP_DAYS} DAYS")

    # Lines per order are pre-aggregated before the join so the big table
    # shrinks to one row per order before it is shuffled again.
    lines = (lineitem.groupBy("l_orderkey")
             .agg(F.count(F.lit(1)).alias("n_lines"),
                  F.count_if(F.col("l_returnflag") == "R").alias("n_r")))
    o = (orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                       "o_orderdate", "o_orderpriority")
         .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
         .withColumn("before", F.col("o_orderdate") < snap))
    b = F.col("before")
    per_cust = o.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_any"),
        F.min(F.when(b, F.col("o_orderdate"))).alias("first_before"),
        F.sum(F.when(b, F.col("o_totalprice"))).alias("total_before"),
        F.count_if(b).alias("n_before"),
        F.count_if(b & (F.col("o_orderpriority") == "1-URGENT")).alias("n_urgent"),
        F.count_if(b & (F.col("o_orderstatus") == "P")).alias("n_p"),
        F.sum(F.when(b, F.col("n_lines"))).alias("lines_before"),
        F.sum(F.when(b, F.col("n_r"))).alias("r_before"),
        F.count_if(~b).alias("n_after"),
        # most frequent priority before snap; ties go to the smallest value
        F.mode(F.when(b, F.col("o_orderpriority")), True).alias("top_priority"),
    )
    geo = (nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "r_name"))
    tenure = F.floor(F.datediff(snap, F.col("first_before")) / 30).cast("int")
    total = F.round(F.col("total_before"), 2)      # money: cents
    out = (customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
           .join(per_cust, F.col("c_custkey") == F.col("o_custkey"), "left")
           .join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "left")
           .select(
               F.col("c_custkey").alias("customer_id"),
               (F.coalesce(F.col("n_after"), F.lit(0)) == 0).alias("churn"),
               tenure.alias("tenure"),
               total.alias("total_charges"),
               # whole cents per month by integer division: identical in every engine
               (F.floor(F.round(total * 100) / F.greatest(tenure, F.lit(1))) / 100.0).alias("monthly_charges"),
               (F.col("c_acctbal") < 0).cast("int").alias("senior_citizen"),
               F.when(F.col("c_custkey") % 2 == 1, F.lit("Male")).otherwise(F.lit("Female")).alias("gender"),
               _yes_no(F.col("n_urgent") * 5 > F.col("n_before")).alias("partner"),
               _yes_no(F.col("r_before") * 3 > F.col("lines_before")).alias("dependents"),
               _yes_no(F.col("n_p") * 3 > F.col("n_before")).alias("phone_service"),
               _yes_no(F.col("c_acctbal") >= 5000).alias("paperless_billing"),
               F.col("c_mktsegment").alias("contract"),
               F.col("top_priority").alias("internet_service"),
               F.col("r_name").alias("online_security"),
               F.col("first_any").alias("created_at"),
           ))
    return out


_CHURN_BASE_SQL = f"""
  _snap AS (SELECT max(o_orderdate) - INTERVAL {SNAP_DAYS} DAY AS snap FROM orders),
  _lines AS (SELECT l_orderkey, count(*) AS n_lines, count_if(l_returnflag = 'R') AS n_r
             FROM lineitem GROUP BY l_orderkey),
  _o AS (SELECT o.*, l.n_lines, l.n_r, (o.o_orderdate < s.snap) AS before, s.snap
         FROM orders o LEFT JOIN _lines l ON o.o_orderkey = l.l_orderkey, _snap s),
  _pm AS (SELECT o_custkey, o_orderpriority, count(*) AS c FROM _o WHERE before GROUP BY ALL),
  _mode AS (SELECT o_custkey, o_orderpriority AS top_priority FROM (
              SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, o_orderpriority) AS rn
              FROM _pm) WHERE rn = 1),
  _agg AS (SELECT o_custkey, min(o_orderdate) AS first_any,
             min(o_orderdate) FILTER (WHERE before) AS first_before,
             sum(o_totalprice) FILTER (WHERE before) AS total_before,
             count(*) FILTER (WHERE before) AS n_before,
             count(*) FILTER (WHERE before AND o_orderpriority = '1-URGENT') AS n_urgent,
             count(*) FILTER (WHERE before AND o_orderstatus = 'P') AS n_p,
             sum(n_lines) FILTER (WHERE before) AS lines_before,
             sum(n_r) FILTER (WHERE before) AS r_before,
             count(*) FILTER (WHERE NOT before) AS n_after
           FROM _o GROUP BY o_custkey),
  _cb AS (SELECT c.c_custkey, c.c_acctbal, c.c_mktsegment, a.*, m.top_priority, r.r_name,
             CAST(floor(date_diff('day', a.first_before, (SELECT snap FROM _snap)) / 30) AS INTEGER) AS tenure
           FROM customer c LEFT JOIN _agg a ON c.c_custkey = a.o_custkey
           LEFT JOIN _mode m ON c.c_custkey = m.o_custkey
           LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
           LEFT JOIN region r ON n.n_regionkey = r.r_regionkey),
  churn_base AS (SELECT c_custkey AS customer_id,
             coalesce(n_after, 0) = 0 AS churn,
             tenure,
             round(total_before, 2) AS total_charges,
             floor(round(round(total_before, 2) * 100) / greatest(tenure, 1)) / 100.0 AS monthly_charges,
             CAST(c_acctbal < 0 AS INTEGER) AS senior_citizen,
             CASE WHEN c_custkey % 2 = 1 THEN 'Male' ELSE 'Female' END AS gender,
             CASE WHEN n_urgent * 5 > n_before THEN 'Yes' ELSE 'No' END AS partner,
             CASE WHEN r_before * 3 > lines_before THEN 'Yes' ELSE 'No' END AS dependents,
             CASE WHEN n_p * 3 > n_before THEN 'Yes' ELSE 'No' END AS phone_service,
             CASE WHEN c_acctbal >= 5000 THEN 'Yes' ELSE 'No' END AS paperless_billing,
             c_mktsegment AS contract,
             top_priority AS internet_service,
             r_name AS online_security,
             first_any AS created_at
           FROM _cb)"""


# Deterministic faults (FIXTURES.md 3.2), applied to the typed fixture.
FAULTS = {"contract_null": 97, "contract_outside": 89, "monthly_negated": 101,
          "total_blank": 83, "total_times_50": 79, "tenure_text": 103}
DUPLICATE_MOD = 211


def churn_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed dirty table: blank totals and text tenures become null here."""
    base = churn_base(spark, sf_dir)
    k = F.col("customer_id")
    return base.withColumns({
        "contract": F.when(k % FAULTS["contract_null"] == 0, F.lit(None).cast("string"))
                     .when(k % FAULTS["contract_outside"] == 0, F.lit("Lifetime"))
                     .otherwise(F.col("contract")),
        "monthly_charges": F.when(k % FAULTS["monthly_negated"] == 0, -F.col("monthly_charges"))
                            .otherwise(F.col("monthly_charges")),
        "total_charges": F.when(k % FAULTS["total_blank"] == 0, F.lit(None).cast("double"))
                          .when(k % FAULTS["total_times_50"] == 0, F.round(F.col("total_charges") * 50, 2))
                          .otherwise(F.col("total_charges")),
        "tenure": F.when(k % FAULTS["tenure_text"] == 0, F.lit(None).cast("int"))
                   .otherwise(F.col("tenure")),
    })


_CHURN_DIRTY_SQL = f"""
  churn_dirty AS (SELECT * REPLACE (
      CASE WHEN customer_id % {FAULTS['contract_null']} = 0 THEN NULL
           WHEN customer_id % {FAULTS['contract_outside']} = 0 THEN 'Lifetime' ELSE contract END AS contract,
      CASE WHEN customer_id % {FAULTS['monthly_negated']} = 0 THEN -monthly_charges ELSE monthly_charges END AS monthly_charges,
      CASE WHEN customer_id % {FAULTS['total_blank']} = 0 THEN NULL
           WHEN customer_id % {FAULTS['total_times_50']} = 0 THEN round(total_charges * 50, 2) ELSE total_charges END AS total_charges,
      CASE WHEN customer_id % {FAULTS['tenure_text']} = 0 THEN NULL ELSE tenure END AS tenure)
    FROM churn_base)"""


RAW_COLUMNS = ["customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
               "PhoneService", "InternetService", "OnlineSecurity", "Contract",
               "PaperlessBilling", "MonthlyCharges", "TotalCharges", "Churn"]


def churn_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string CSV-like form with ``row_no`` (file line, header is line 1).

    Rows with ``customer_id % 211 == 0`` are appended again at the end, so
    the id column has duplicates.  Row numbers are data, assigned from the
    customer key order, never from physical row order.
    """
    base = churn_base(spark, sf_dir)
    k = F.col("customer_id")
    typed = {v: k2 for k2, v in FIXTURE_CSV_NAMES.items()}  # csv -> typed
    cols = {}
    for csv_name in RAW_COLUMNS:
        src = F.col(typed[csv_name])
        if csv_name == "Churn":
            c = F.when(src, F.lit("Yes")).otherwise(F.lit("No"))
        elif csv_name == "Contract":
            c = (F.when(k % FAULTS["contract_null"] == 0, F.lit(""))
                 .when(k % FAULTS["contract_outside"] == 0, F.lit("Lifetime")).otherwise(src))
        elif csv_name == "MonthlyCharges":
            m = F.when(k % FAULTS["monthly_negated"] == 0, -src).otherwise(src)
            c = F.when(m.isNotNull(), F.format_string("%.2f", m))
        elif csv_name == "TotalCharges":
            c = (F.when(k % FAULTS["total_blank"] == 0, F.lit(" "))
                 .when(src.isNull(), F.lit(None).cast("string"))
                 .when(k % FAULTS["total_times_50"] == 0, F.format_string("%.2f", F.round(src * 50, 2)))
                 .otherwise(F.format_string("%.2f", src)))
        elif csv_name == "tenure":
            c = F.when(k % FAULTS["tenure_text"] == 0, F.lit("abc")).otherwise(src.cast("string"))
        else:
            c = src.cast("string")
        cols[csv_name] = F.coalesce(c, F.lit(""))
    raw = base.select(k.alias("_k"), F.lit(0).alias("_dup"), *[v.alias(n) for n, v in cols.items()])
    dup = raw.where(F.col("_k") % DUPLICATE_MOD == 0).withColumn("_dup", F.lit(1))
    both = raw.unionByName(dup)
    top = table(spark, sf_dir, "customer").select(F.max("c_custkey") + 1).scalar()
    # row_no: originals at 2 + key, the repeated rows after all of them in key
    # order.  Derived from the key, so no global (single-task) window is needed.
    return both.select(
        (F.lit(2) + F.when(F.col("_dup") == 1, top + F.floor(F.col("_k") / DUPLICATE_MOD))
         .otherwise(F.col("_k"))).cast("long").alias("row_no"),
        *RAW_COLUMNS)


def _raw_select_sql() -> str:
    typed = {v: k2 for k2, v in FIXTURE_CSV_NAMES.items()}
    parts = []
    for csv_name in RAW_COLUMNS:
        src = typed[csv_name]
        if csv_name == "Churn":
            e = f"CASE WHEN {src} THEN 'Yes' ELSE 'No' END"
        elif csv_name == "Contract":
            e = (f"CASE WHEN customer_id % {FAULTS['contract_null']} = 0 THEN '' "
                 f"WHEN customer_id % {FAULTS['contract_outside']} = 0 THEN 'Lifetime' ELSE {src} END")
        elif csv_name == "MonthlyCharges":
            e = (f"printf('%.2f', CASE WHEN customer_id % {FAULTS['monthly_negated']} = 0 THEN -{src} "
                 f"ELSE {src} END)")
        elif csv_name == "TotalCharges":
            e = (f"CASE WHEN customer_id % {FAULTS['total_blank']} = 0 THEN ' ' "
                 f"WHEN customer_id % {FAULTS['total_times_50']} = 0 THEN printf('%.2f', round({src} * 50, 2)) "
                 f"ELSE printf('%.2f', {src}) END")
        elif csv_name == "tenure":
            e = f"CASE WHEN customer_id % {FAULTS['tenure_text']} = 0 THEN 'abc' ELSE CAST({src} AS VARCHAR) END"
        else:
            e = f"CAST({src} AS VARCHAR)"
        parts.append(f"coalesce({e}, '') AS \"{csv_name}\"")
    return ",\n      ".join(parts)


_CHURN_RAW_SQL = f"""
  _raw0 AS (SELECT customer_id AS _k, {_raw_select_sql()} FROM churn_base),
  churn_raw AS (
    SELECT CAST(2 + _k AS BIGINT) AS row_no, * EXCLUDE (_k) FROM _raw0
    UNION ALL
    SELECT CAST(2 + (SELECT max(c_custkey) + 1 FROM customer) + floor(_k / {DUPLICATE_MOD}) AS BIGINT) AS row_no,
           * EXCLUDE (_k) FROM _raw0 WHERE _k % {DUPLICATE_MOD} = 0)"""


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training-progress style long metrics from ``events``."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id"), F.col("user_id").alias("job_id"),
                     F.col("event_type").alias("metric_name"),
                     F.col("value").alias("metric_value"),
                     F.col("ts").alias("recorded_at"))


_METRIC_EVENTS_SQL = """
  metric_events AS (SELECT event_id, user_id AS job_id, event_type AS metric_name,
                           value AS metric_value, ts AS recorded_at FROM events)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.col("user_id").alias("client"), F.col("ts"), "props")


_REQUESTS_SQL = """
  requests AS (SELECT event_id, user_id AS client, ts, props FROM events)"""

JOB_STATUS = {"O": "queued", "P": "running", "F": "completed"}


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training-job rows from ``orders`` (owner = customer, model type = priority)."""
    o = table(spark, sf_dir, "orders")
    st = F.col("o_orderstatus")
    status = F.when(st == "O", "queued").when(st == "P", "running").when(st == "F", "completed")
    return o.select(F.col("o_orderkey").alias("job_id"),
                    F.col("o_custkey").alias("owner_id"),
                    (F.col("o_custkey") % 25).alias("dataset_id"),
                    F.col("o_orderpriority").alias("model_type"),
                    status.alias("status"),
                    F.col("o_orderdate").alias("created_at"),
                    F.when((st != "O") & (F.col("o_orderkey") % 3 > 0), F.col("o_orderdate") + F.make_dt_interval(
                        F.lit(0), F.lit(0), (F.col("o_orderkey") % 90).cast("int"))).alias("started_at"),
                    (F.col("o_orderkey") % 100).cast("int").alias("progress_percent"),
                    F.col("o_totalprice").alias("score"))


_JOBS_SQL = """
  jobs AS (SELECT o_orderkey AS job_id, o_custkey AS owner_id, o_custkey % 25 AS dataset_id,
                  o_orderpriority AS model_type,
                  CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running'
                       WHEN 'F' THEN 'completed' END AS status,
                  o_orderdate AS created_at,
                  CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 3 > 0
                       THEN o_orderdate + to_minutes(CAST(o_orderkey % 90 AS INTEGER)) END AS started_at,
                  CAST(o_orderkey % 100 AS INTEGER) AS progress_percent,
                  o_totalprice AS score FROM orders)"""


FIXTURE_SQL = {
    "churn_base": (_CHURN_BASE_SQL, ()),
    "churn_dirty": (_CHURN_DIRTY_SQL, ("churn_base",)),
    "churn_raw": (_CHURN_RAW_SQL, ("churn_base",)),
    "metric_events": (_METRIC_EVENTS_SQL, ()),
    "requests": (_REQUESTS_SQL, ()),
    "jobs": (_JOBS_SQL, ()),
}


def with_fixtures(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs of the named fixtures (and their deps)."""
    order: list[str] = []

    def add(n):
        for d in FIXTURE_SQL[n][1]:
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    ctes = ",".join(FIXTURE_SQL[n][0] for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


# ---- operational tables derived from orders / nation / events / customer ----

def _rhu(c, d):
    from tidemark.functions.stats import round_half_up
    return round_half_up(c, d)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model versions: one per completed job; metrics derived from the order."""
    j = jobs(spark, sf_dir).where(F.col("status") == "completed")
    s = F.col("score")
    return j.select(
        F.col("job_id").alias("version_id"), "owner_id", "dataset_id", "model_type",
        (F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("job_id") % 97).cast("int"))).alias("trained_at"),
        _rhu((s % 1000) / 1000, 4).alias("f1"), _rhu((s % 997) / 997, 4).alias("accuracy"),
        _rhu((s % 991) / 991, 4).alias("precision"), _rhu((s % 983) / 983, 4).alias("recall"),
        _rhu(s / 1000, 2).alias("training_time_seconds"),
        F.when(F.col("job_id") % 5 == 0, "archived").otherwise("active").alias("status"))


_VERSIONS_SQL = """
  versions AS (SELECT job_id AS version_id, owner_id, dataset_id, model_type,
                 created_at + to_minutes(CAST(job_id % 97 AS BIGINT)) AS trained_at,
                 CAST(round(CAST((score % 1000) / 1000 AS DECIMAL(38,10)), 4) AS DOUBLE) AS f1,
                 CAST(round(CAST((score % 997) / 997 AS DECIMAL(38,10)), 4) AS DOUBLE) AS accuracy,
                 CAST(round(CAST((score % 991) / 991 AS DECIMAL(38,10)), 4) AS DOUBLE) AS precision,
                 CAST(round(CAST((score % 983) / 983 AS DECIMAL(38,10)), 4) AS DOUBLE) AS recall,
                 CAST(round(CAST(score / 1000 AS DECIMAL(38,10)), 2) AS DOUBLE) AS training_time_seconds,
                 CASE WHEN job_id % 5 = 0 THEN 'archived' ELSE 'active' END AS status
               FROM jobs WHERE status = 'completed')"""


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded datasets: one per nation."""
    n = table(spark, sf_dir, "nation")
    st = F.when(F.col("n_regionkey") == 0, "processing").when(F.col("n_regionkey") == 1, "failed").otherwise("ready")
    return n.select(F.col("n_nationkey").cast("long").alias("dataset_id"),
                    F.concat(F.lower("n_name"), F.lit(".csv")).alias("filename"),
                    F.col("n_regionkey").cast("long").alias("owner_id"), st.alias("status"),
                    (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
                     + F.make_dt_interval(F.col("n_nationkey").cast("int"))).alias("uploaded_at"),
                    F.when(st == "failed", F.concat(F.lit('{"error": "Row '), F.col("n_nationkey").cast("string"),
                                                     F.lit(': bad value"}'))).alias("validation_errors"))


_DATASETS_SQL = """
  datasets AS (SELECT CAST(n_nationkey AS BIGINT) AS dataset_id, lower(n_name) || '.csv' AS filename,
                 CAST(n_regionkey AS BIGINT) AS owner_id,
                 CASE WHEN n_regionkey = 0 THEN 'processing' WHEN n_regionkey = 1 THEN 'failed' ELSE 'ready' END AS status,
                 TIMESTAMP '2024-01-01 00:00:00' + to_days(n_nationkey) AS uploaded_at,
                 CASE WHEN n_regionkey = 1 THEN '{"error": "Row ' || n_nationkey || ': bad value"}' END AS validation_errors
               FROM nation)"""


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP request log from events (path, status, latency, headers)."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    status = (F.when(F.col("event_type") == "error", 500 + k % 4)
              .when(F.col("event_type") == "signup", 400 + k % 5).otherwise(200))
    path = F.concat(F.lit("/api/"), F.col("event_type"), F.lit("/"), F.col("user_id").cast("string"))
    xff = F.when(k % 3 == 0, F.concat(F.lit(" 10.0."), F.col("user_id").cast("string"), F.lit("."),
                                      k.cast("string"), F.lit(" , 172.16.0.1")))
    host = F.when(k % 2 == 0, F.concat(F.lit("192.168."), F.col("user_id").cast("string"), F.lit(".1")))
    return ev.select("event_id", F.col("user_id").alias("client"), F.col("ts"),
                     path.alias("path"), status.cast("int").alias("status_code"),
                     (F.col("value") * 100).alias("response_ms"), xff.alias("x_forwarded_for"), host.alias("host"))


_REQUEST_LOG_SQL = """
  request_log AS (SELECT event_id, user_id AS client, ts,
      '/api/' || event_type || '/' || user_id AS path,
      CAST(CASE WHEN event_type = 'error' THEN 500 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 4
                WHEN event_type = 'signup' THEN 400 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 5
                ELSE 200 END AS INTEGER) AS status_code,
      value * 100 AS response_ms,
      CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 = 0
           THEN ' 10.0.' || user_id || '.' || json_extract_string(props, '$.k') || ' , 172.16.0.1' END AS x_forwarded_for,
      CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 THEN '192.168.' || user_id || '.1' END AS host
    FROM events)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"),
                    F.col("c_mktsegment").alias("team"),
                    F.when(F.col("c_acctbal") > 9990, "Admin").otherwise("Analyst").alias("role"),
                    (F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
                     + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("c_custkey").cast("decimal(18,6)"))).alias("created_at"))


_USERS_SQL = """
  users AS (SELECT c_custkey AS user_id, c_name AS name, c_mktsegment AS team,
              CASE WHEN c_acctbal > 9990 THEN 'Admin' ELSE 'Analyst' END AS role,
              TIMESTAMP '2020-01-01 00:00:00' + to_seconds(c_custkey) AS created_at FROM customer)"""

FIXTURE_SQL.update({
    "versions": (_VERSIONS_SQL, ("jobs",)),
    "datasets": (_DATASETS_SQL, ()),
    "request_log": (_REQUEST_LOG_SQL, ()),
    "users": (_USERS_SQL, ()),
})
