"""Validation and typing queries over the raw (all-string) churn fixture."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.stats import r
from tidemark.operators import validate as v
from tidemark.operators.quality import NUMERIC_TEXT
from tidemark.plans.catalog import register
from tidemark.roles import CSV_TO_TYPED, FIXTURE, TENURE_MAX, VALIDATION_MESSAGE_LIMIT
from tidemark.session import stored
from tidemark.sources.fixtures import RAW_COLUMNS, churn_raw

SCORE_COLS = [c for c in RAW_COLUMNS if c not in ("customerID", "Churn")]


def _domains():
    from tidemark.roles import CSV_DOMAINS, CSV_TO_TYPED
    out = {}
    for name in CSV_DOMAINS:
        if name in RAW_COLUMNS:
            t = CSV_TO_TYPED[name]
            out[name] = list(FIXTURE.domains[t]) if t in FIXTURE.domains else list(CSV_DOMAINS[name])
    return out


def _rules_sql(src="churn_raw", id_col="customerID", charges_max=None, cols=RAW_COLUMNS):
    parts = []
    n = 0

    def add(col, cond, msg):
        nonlocal n
        n += 1
        parts.append(f"SELECT row_no, {n} AS rule_no, '{col}' AS \"column\", 'Row ' || row_no || ': ' || {msg} AS message "
                     f"FROM {src} WHERE {cond}")
    if id_col in cols:
        add(id_col, f"trim(coalesce(\"{id_col}\", '')) = ''", f"'{id_col} is empty'")
    for name, allowed in _domains().items():
        if name not in cols:
            continue
        lst = ", ".join("'" + a + "'" for a in allowed)
        exp = ", ".join(sorted(allowed))
        add(name, f"coalesce(trim(\"{name}\"), '') <> '' AND trim(\"{name}\") NOT IN ({lst})",
            f"'{name} has invalid value ''' || trim(\"{name}\") || ''' (expected one of: {exp})'")
    t = "trim(\"SeniorCitizen\")"
    add("SeniorCitizen", f"coalesce({t}, '') <> '' AND {t} NOT IN ('0', '1')",
        f"'SeniorCitizen must be 0 or 1, got ''' || {t} || ''''")
    t = "trim(tenure)"
    isint = f"regexp_matches({t}, '{v.INT_TEXT}')"
    iv = f"CAST(replace({t}, '_', '') AS BIGINT)"
    add("tenure", f"coalesce({t}, '') <> '' AND {isint} AND ({iv} < 0 OR {iv} > {TENURE_MAX})",
        f"'tenure must be between 0 and {TENURE_MAX}, got ' || {iv}")
    add("tenure", f"coalesce({t}, '') <> '' AND NOT {isint}", f"'tenure must be an integer, got ''' || {t} || ''''")
    for name in ("MonthlyCharges", "TotalCharges"):
        t = f"trim(\"{name}\")"
        num = f"regexp_matches(lower({t}), '{NUMERIC_TEXT}')"
        fv = f"CAST(replace({t}, '_', '') AS DOUBLE)"
        if name == "MonthlyCharges":
            add(name, f"coalesce({t}, '') <> '' AND {num} AND {fv} < 0",
                f"'MonthlyCharges must be positive, got ' || CAST({fv} AS VARCHAR)")
            add(name, f"coalesce({t}, '') <> '' AND NOT {num}", f"'MonthlyCharges must be a number, got ''' || {t} || ''''")
        else:
            add(name, f"coalesce({t}, '') <> '' AND NOT {num}",
                f"'TotalCharges must be a number or empty, got ''' || \"{name}\" || ''''")
        if charges_max is not None:
            add(name, f"coalesce({t}, '') <> '' AND {num} AND {fv} > {charges_max}",
                f"'{name} must be at most {charges_max:g}, got ' || {t}")
    return " UNION ALL ".join(parts)


@register("v2_v7_validation_errors", _rules_sql(), ("churn_raw",))
def v2_7(spark, sf_dir):
    raw = churn_raw(spark, sf_dir)
    return v.validation_errors(raw, _domains())


@register("v8_first_errors", f"""
WITH _e AS ({_rules_sql()}),
_h AS (SELECT * FROM _e ORDER BY row_no, rule_no LIMIT {VALIDATION_MESSAGE_LIMIT}),
_c AS (SELECT CASE WHEN count(*) >= {VALIDATION_MESSAGE_LIMIT} THEN max(row_no) END AS cut FROM _h)
SELECT row_no, rule_no, message FROM _e, _c WHERE cut IS NULL OR row_no <= cut
UNION ALL
SELECT cut, {1 << 20}, '{v.OMITTED}' FROM _c WHERE (SELECT count(*) FROM _e) >= {VALIDATION_MESSAGE_LIMIT}""",
          ("churn_raw",))
def v8(spark, sf_dir):
    return v.first_errors(v2_7(spark, sf_dir))


@register("v8_error_totals", f"""
WITH _e AS ({_rules_sql()})
SELECT (SELECT count(*) FROM churn_raw) AS row_count, (SELECT count(*) FROM _e) AS error_count,
       (SELECT count(DISTINCT row_no) FROM _e) AS rows_with_errors""", ("churn_raw",))
def v8t(spark, sf_dir):
    raw = churn_raw(spark, sf_dir)
    return v.error_totals(v.validation_errors(raw, _domains()), raw)


@register("v9_non_empty", "SELECT count(*) AS row_count, count(*) = 0 AS is_empty FROM churn_raw", ("churn_raw",))
def v9(spark, sf_dir):
    return v.non_empty(churn_raw(spark, sf_dir))


#: Faults of scoring rows by row number: (modulus, column, value).
SCORING_FAULTS = [(37, "gender", "female"), (41, "Partner", " Yes"), (43, "PaperlessBilling", ""), (47, "SeniorCitizen", "2"), (53, "tenure", "73"),
                  (59, "tenure", "12.5"), (61, "MonthlyCharges", "-1"), (67, "MonthlyCharges", "1000000.01"), (71, "TotalCharges", "-0.5"),
                  (73, "TotalCharges", "n/a"), (79, "PhoneService", "no"), (83, "SeniorCitizen", "x")]


def scoring_input(spark, sf_dir):
    """The scoring columns of the raw rows with a fault for every rule of the scoring schema."""
    raw = churn_raw(spark, sf_dir).select("row_no", *SCORE_COLS)
    for mod, column, value in SCORING_FAULTS:
        raw = raw.withColumn(column, F.when(F.col("row_no") % mod == 0, F.lit(value)).otherwise(F.col(column)))
    return raw


def scoring_domains():
    return {k: x for k, x in _domains().items() if k in SCORE_COLS}


def _scoring_ctes() -> str:
    """CTEs _sin (the faulty rows) and _bad (the broken rules)."""
    columns = {c: f'"{c}"' for c in SCORE_COLS}
    for mod, column, value in SCORING_FAULTS:
        columns[column] = f"CASE WHEN row_no % {mod} = 0 THEN '{value}' ELSE {columns[column]} END"
    parts, n = [], 0

    def add(name, cond, message):
        nonlocal n
        n += 1
        text = f"'Row ' || row_no || ': {name} {message}'" if message == "is required" else \
            f"'Row ' || row_no || ': {name} {message}; got ' || chr(39) || \"{name}\" || chr(39)"
        parts.append(f"SELECT row_no, {n} AS rule_no, '{name}' AS \"column\", {text} AS message FROM _sin WHERE {cond}")
    for name in [*scoring_domains(), "SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]:
        c = f'"{name}"'
        given = f"trim(coalesce({c}, '')) <> ''"
        add(name, f"NOT ({given})", "is required")
        if name in scoring_domains():
            allowed = scoring_domains()[name]
            listed = ", ".join("'" + a + "'" for a in allowed)
            add(name, f"{given} AND {c} NOT IN ({listed})", f"must be one of: {', '.join(sorted(allowed))}")
        elif name in ("SeniorCitizen", "tenure"):
            top = 1 if name == "SeniorCitizen" else TENURE_MAX
            whole = f"regexp_matches({c}, '{v.INT_TEXT}')"
            add(name, f"{given} AND NOT {whole}", "must be a whole number")
            add(name, f"{given} AND {whole} AND NOT coalesce(TRY_CAST(replace(trim({c}), '_', '') AS BIGINT) BETWEEN 0 AND {top}, false)",
                f"must be between 0 and {top}")
        else:
            num = f"regexp_matches(lower(trim({c})), '{NUMERIC_TEXT}')"
            x = f"TRY_CAST(replace(trim({c}), '_', '') AS DOUBLE)"
            add(name, f"{given} AND NOT {num}", "must be a number")
            add(name, f"{given} AND {num} AND ({x} < 0 OR isnan({x}))", "must be non-negative")
            add(name, f"{given} AND {num} AND {x} > 1000000 AND NOT isnan({x})", "exceeds reasonable maximum (1,000,000)")
    faulty = ", ".join(f"{e} AS \"{c}\"" for c, e in columns.items())
    return f"_sin AS (SELECT row_no, {faulty} FROM churn_raw), _bad AS ({' UNION ALL '.join(parts)})"


@register("v10_scoring_row_rules", f"WITH {_scoring_ctes()} SELECT * FROM _bad", ("churn_raw",))
def v10(spark, sf_dir):
    """Rows with a fault for every rule, checked by the scoring schema."""
    return v.scoring_errors(scoring_input(spark, sf_dir), scoring_domains())


@register("v11_scoring_missing", " UNION ALL ".join(
    f"SELECT row_no, '{c}' AS \"column\", 'Missing value in column: {c}' AS message FROM churn_raw "
    f"WHERE coalesce(\"{c}\", '') = ''" for c in SCORE_COLS), ("churn_raw",))
def v11(spark, sf_dir):
    return v.missing_cells(churn_raw(spark, sf_dir), SCORE_COLS)


@register("v12_duplicate_ids", """
WITH _d AS (SELECT row_no, trim("customerID") AS id FROM churn_raw WHERE trim("customerID") <> ''),
_f AS (SELECT id, min(row_no) AS first_row FROM _d GROUP BY id)
SELECT row_no, id, first_row FROM _d JOIN _f USING (id) WHERE row_no > first_row""", ("churn_raw",))
def v12(spark, sf_dir):
    return v.duplicate_ids(churn_raw(spark, sf_dir))


def _typed_sql():
    from tidemark.roles import CSV_TO_TYPED
    out = ["row_no"]
    for name in RAW_COLUMNS:
        t = CSV_TO_TYPED[name]
        c = f"\"{name}\""
        if name in ("tenure", "SeniorCitizen"):
            e = f"CASE WHEN regexp_matches(trim({c}), '{v.INT_TEXT}') THEN TRY_CAST(replace(trim({c}), '_', '') AS INTEGER) END"
        elif name in ("MonthlyCharges", "TotalCharges"):
            e = (f"CASE WHEN trim({c}) = '' OR NOT regexp_matches(lower(trim({c})), '{NUMERIC_TEXT}') THEN NULL "
                 f"ELSE CAST(replace(trim({c}), '_', '') AS DOUBLE) END")
            e = f"round({e}, 6)"
        elif name == "Churn":
            e = f"CASE WHEN trim({c}) = '' THEN NULL ELSE trim({c}) = 'Yes' END"
        elif name == "customerID":
            e = f"trim({c})"
        else:
            e = f"CASE WHEN {c} = '' THEN NULL ELSE {c} END"
        out.append(f"{e} AS {t}")
    return "SELECT " + ", ".join(out) + " FROM churn_raw"


@register("t1_typed_projection", _typed_sql(), ("churn_raw",))
def t1(spark, sf_dir):
    t = v.typed_projection(churn_raw(spark, sf_dir))
    return t.withColumns({c: r(c) for c in ("monthly_charges", "total_charges")})


@register("t2_t3_parse_total_label", """
SELECT row_no, CASE WHEN trim("TotalCharges") = '' THEN NULL ELSE round(CAST(trim("TotalCharges") AS DOUBLE), 6) END AS total_charges,
       CASE WHEN trim("Churn") = '' THEN NULL ELSE trim("Churn") = 'Yes' END AS churn
FROM churn_raw""", ("churn_raw",))
def t2_3(spark, sf_dir):
    raw = churn_raw(spark, sf_dir)
    return raw.select("row_no", r(v.parse_double(F.col("TotalCharges"))).alias("total_charges"),
                      v.parse_label(F.col("Churn")).alias("churn"))


@register("t4_encrypt_roundtrip", """
SELECT row_no, CASE WHEN regexp_matches("customerID", '[^\\s]') THEN "customerID" END AS customer_id,
       CASE WHEN regexp_matches("customerID", '[^\\s]') THEN 12 + strlen("customerID") + 16 END AS cipher_bytes FROM churn_raw""",
          ("churn_raw",))
def t4(spark, sf_dir):
    """Ids encrypted under a key of this run, blank ones left null, then decrypted again."""
    key = v.new_key()
    enc = stored(churn_raw(spark, sf_dir).select("row_no", v.encrypt_optional(F.col("customerID"), key).alias("ct")))
    return enc.select("row_no", v.decrypt_optional(F.col("ct"), key).alias("customer_id"), F.length("ct").alias("cipher_bytes"))


@register("t5_rename_for_scoring", "SELECT " + ", ".join(
    f"\"{c}\" AS {CSV_TO_TYPED[c]}" for c in SCORE_COLS) + " FROM churn_raw",
          ("churn_raw",))
def t5(spark, sf_dir):
    return v.rename_for_scoring(churn_raw(spark, sf_dir), SCORE_COLS)


@register("t6_recode_values", """
SELECT row_no, CASE WHEN "Contract" = 'Lifetime' THEN 'Two year' ELSE "Contract" END AS contract FROM churn_raw""",
          ("churn_raw",))
def t6(spark, sf_dir):
    raw = churn_raw(spark, sf_dir)
    return raw.select("row_no", v.recode(F.col("Contract"), "Lifetime", "Two year").alias("contract"))
