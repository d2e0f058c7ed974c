"""Validation rules (V1..V13) and typed projection (T1..T6) over a raw,
all-string customer table with a ``row_no`` column (file line number).

Rules are columns: each row yields an array of (rule_no, column, message)
structs, compacted and exploded, so validating is one projection and needs
no shuffle; only duplicate-id detection (V12) aggregates.
"""
from __future__ import annotations

import base64
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quality import is_numeric_text
from tidemark.roles import (CSV_DOMAINS, CSV_TO_TYPED, REQUIRED_CSV_COLUMNS,
                            SCORING_CHARGES_MAX, TENURE_MAX, VALIDATION_MESSAGE_LIMIT, Roles)

# Fixed value: Python int() spelling.
INT_TEXT = r"^\s*[+-]?\d+(_\d+)*\s*$"
OMITTED = "... (additional validation errors omitted)"


def required_columns(df: DataFrame, required=REQUIRED_CSV_COLUMNS) -> DataFrame:
    """V1: sorted missing header names (schema metadata only)."""
    missing = sorted(set(required) - set(df.columns))
    return df.sparkSession.createDataFrame([(m,) for m in missing], "missing_column string")


def csv_domains(raw: DataFrame, roles: Roles | None = None) -> dict:
    """Domains keyed by CSV column name for the columns present in ``raw``.
    With ``roles`` the typed-domain sets are used (fixture data), else the
    reference CSV sets."""
    out = {}
    for name in CSV_DOMAINS:                      # reference rule order
        if name not in raw.columns:
            continue
        if roles is not None and CSV_TO_TYPED[name] in roles.domains:
            out[name] = list(roles.domains[CSV_TO_TYPED[name]])
        else:
            out[name] = list(CSV_DOMAINS[name])
    return out


def _msg(row: Column, *parts) -> Column:
    return F.concat(F.lit("Row "), row.cast("string"), F.lit(": "), *parts)


def _int_value(c: Column) -> Column:
    """Integer text as a number; null when it has too many digits for a long."""
    return F.regexp_replace(F.trim(c), "_", "").try_cast("long")


def _rule(no: int, column: str, cond: Column, message: Column) -> Column:
    return F.when(cond, F.struct(F.lit(no).alias("rule_no"), F.lit(column).alias("column"),
                                 message.alias("message")))


def row_rules(raw: DataFrame, domains: dict, id_col: str | None = "customerID",
              tenure_max: int = TENURE_MAX, charges_max: float | None = None) -> list:
    """Rule columns in the order the reference checks them within a row."""
    row = F.col("row_no")
    rules = []
    n = 0
    if id_col and id_col in raw.columns:
        n += 1
        rules.append(_rule(n, id_col, F.trim(F.coalesce(F.col(id_col), F.lit(""))) == "",
                           _msg(row, F.lit(f"{id_col} is empty"))))
    for name, allowed in domains.items():
        v = F.trim(F.col(name))
        n += 1
        rules.append(_rule(n, name, (F.coalesce(v, F.lit("")) != "") & ~v.isin(allowed),
                           _msg(row, F.lit(f"{name} has invalid value '"), v,
                                F.lit(f"' (expected one of: {', '.join(sorted(allowed))})"))))
    if "SeniorCitizen" in raw.columns:
        v = F.trim(F.col("SeniorCitizen"))
        n += 1
        rules.append(_rule(n, "SeniorCitizen", (F.coalesce(v, F.lit("")) != "") & ~v.isin("0", "1"),
                           _msg(row, F.lit("SeniorCitizen must be 0 or 1, got '"), v, F.lit("'"))))
    if "tenure" in raw.columns:
        v = F.trim(F.col("tenure"))
        present = F.coalesce(v, F.lit("")) != ""
        ok_int = v.rlike(INT_TEXT)
        iv = _int_value(v)
        n += 1
        rules.append(_rule(n, "tenure", present & ok_int & (iv.isNull() | (iv < 0) | (iv > tenure_max)),
                           _msg(row, F.lit(f"tenure must be between 0 and {tenure_max}, got "),
                                F.coalesce(iv.cast("string"), v))))
        n += 1
        rules.append(_rule(n, "tenure", present & ~ok_int,
                           _msg(row, F.lit("tenure must be an integer, got '"), v, F.lit("'"))))
    for name in ("MonthlyCharges", "TotalCharges"):
        if name not in raw.columns:
            continue
        v = F.trim(F.col(name))
        present = F.coalesce(v, F.lit("")) != ""
        num = is_numeric_text(v)
        fv = F.regexp_replace(v, "_", "").cast("double")
        if name == "MonthlyCharges":
            n += 1
            rules.append(_rule(n, name, present & num & (fv < 0),
                               _msg(row, F.lit("MonthlyCharges must be positive, got "), fv.cast("string"))))
            n += 1
            rules.append(_rule(n, name, present & ~num,
                               _msg(row, F.lit("MonthlyCharges must be a number, got '"), v, F.lit("'"))))
        else:
            n += 1
            rules.append(_rule(n, name, present & ~num,
                               _msg(row, F.lit("TotalCharges must be a number or empty, got '"),
                                    F.col(name), F.lit("'"))))
        if charges_max is not None:
            n += 1
            rules.append(_rule(n, name, present & num & (fv > charges_max),
                               _msg(row, F.lit(f"{name} must be at most {charges_max:g}, got "), v)))
    return rules


def validation_errors(raw: DataFrame, domains: dict, **kw) -> DataFrame:
    """V2..V7 (and V10 with ``charges_max``): one row per failed rule."""
    rules = row_rules(raw, domains, **kw)
    return (raw.select("row_no", F.explode(F.array_compact(F.array(*rules))).alias("e"))
            .select("row_no", "e.rule_no", "e.column", "e.message"))


def scoring_rules(raw: DataFrame, domains: dict, tenure_max: int = TENURE_MAX, charges_max: float = SCORING_CHARGES_MAX) -> list:
    """The scoring schema's rules, stricter than the upload's: every field is
    needed, texts must equal an allowed value as they stand (no trimming), the
    flag is 0 or 1, tenure a whole number in range, both charges numbers from 0 to the maximum."""
    row, rules = F.col("row_no"), []

    def add(name, cond, message):
        parts = [F.lit(f"{name} {message}")] if message == "is required" else [F.lit(f"{name} {message}; got '"), F.col(name), F.lit("'")]
        rules.append(_rule(len(rules) + 1, name, cond, _msg(row, *parts)))

    for name in [*domains, "SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]:
        if name not in raw.columns:
            add(name, F.lit(True), "is required")
            continue
        v = F.col(name)
        given = F.trim(F.coalesce(v, F.lit(""))) != ""
        add(name, ~given, "is required")
        if name in domains:
            add(name, given & ~v.isin(domains[name]), f"must be one of: {', '.join(sorted(domains[name]))}")
        elif name in ("SeniorCitizen", "tenure"):
            top = 1 if name == "SeniorCitizen" else tenure_max
            n = _int_value(v)
            add(name, given & ~v.rlike(INT_TEXT), "must be a whole number")
            add(name, given & v.rlike(INT_TEXT) & (n.isNull() | (n < 0) | (n > top)), f"must be between 0 and {top}")
        else:
            num = is_numeric_text(F.trim(v))
            x = F.regexp_replace(F.trim(v), "_", "").try_cast("double")
            add(name, given & ~num, "must be a number")
            add(name, given & num & ((x < 0) | F.isnan(x)), "must be non-negative")
            add(name, given & num & (x > charges_max) & ~F.isnan(x), f"exceeds reasonable maximum ({charges_max:,.0f})")
    return rules


def scoring_errors(raw: DataFrame, domains: dict) -> DataFrame:
    """One row per broken scoring rule."""
    return (raw.select("row_no", F.explode(F.array_compact(F.array(*scoring_rules(raw, domains)))).alias("e"))
            .select("row_no", "e.rule_no", "e.column", "e.message"))


def first_errors(errors: DataFrame, limit: int = VALIDATION_MESSAGE_LIMIT) -> DataFrame:
    """V8: the messages the reference would report: rows in file order until
    at least ``limit`` messages are collected (the crossing row is kept
    whole), then the "omitted" marker.  Only a top-``limit`` is sorted."""
    head = errors.orderBy("row_no", "rule_no").limit(limit)
    cut = head.select(F.when(F.count(F.lit(1)) >= limit, F.max("row_no"))).scalar()
    kept = errors.where(cut.isNull() | (F.col("row_no") <= cut))
    kept = kept.select("row_no", "rule_no", "message")
    marker = (errors.agg(F.count(F.lit(1)).alias("n"), F.max("row_no").alias("m"))
              .where(F.col("n") >= limit)
              .select(cut.alias("row_no"), F.lit(1 << 20).alias("rule_no"), F.lit(OMITTED).alias("message")))
    return kept.unionByName(marker)


def error_totals(errors: DataFrame, raw: DataFrame) -> DataFrame:
    """Exact totals (the reference stops early; these do not)."""
    return raw.select(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        errors.select(F.count(F.lit(1))).scalar().alias("error_count"),
        errors.select(F.count_distinct("row_no")).scalar().alias("rows_with_errors"))


def non_empty(raw: DataFrame) -> DataFrame:
    """V9: zero data rows fails the file."""
    return raw.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "is_empty", F.col("row_count") == 0)


def duplicate_ids(raw: DataFrame, id_col: str = "customerID") -> DataFrame:
    """Every later occurrence of a trimmed id.  First occurrence by a
    grouped min (map-side combine), only of ids that repeat, then a join back:
    its one row per id lets AQE split the rows of a hot id."""
    k = F.trim(F.col(id_col))
    d = raw.select("row_no", k.alias("id")).where(F.col("id") != "")
    first = d.groupBy("id").agg(F.min("row_no").alias("first_row"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").drop("n")
    return (d.join(first, "id").where(F.col("row_no") > F.col("first_row"))
            .select("row_no", "id", "first_row"))


def parse_double(c: Column) -> Column:
    """Blank, unparsable or not-a-number to null, else the number."""
    t = F.trim(c)
    x = F.regexp_replace(t, "_", "").try_cast("double")
    return F.when(t.isNull() | (t == "") | ~is_numeric_text(t) | F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def parse_int(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike(INT_TEXT), F.regexp_replace(t, "_", "").try_cast("int"))


def parse_label(c: Column) -> Column:
    """T3: 'Yes' true, other non-empty false, empty null."""
    t = F.trim(c)
    return F.when(t.isNull() | (t == ""), F.lit(None).cast("boolean")).otherwise(t == "Yes")


def typed_projection(raw: DataFrame) -> DataFrame:
    """CSV strings to typed snake_case columns.  Categoricals are stored
    untrimmed (as the reference does); numerics: empty to null."""
    out = []
    for name in raw.columns:
        if name == "row_no":
            out.append(F.col(name))
            continue
        typed = CSV_TO_TYPED.get(name, name)
        c = F.col(name)
        if name in ("tenure",):
            e = parse_int(c)
        elif name == "SeniorCitizen":
            e = parse_int(c)
        elif name in ("MonthlyCharges", "TotalCharges"):
            e = parse_double(c)
        elif name == "Churn":
            e = parse_label(c)
        elif name == "customerID":
            e = F.trim(c)
        else:
            e = F.when(c == "", F.lit(None).cast("string")).otherwise(c)
        out.append(e.alias(typed))
    return raw.select(*out)


def rename_for_scoring(df: DataFrame, required=None) -> DataFrame:
    """T5: CSV names to training names; extras ignored, missing ones fail."""
    req = required or [c for c in REQUIRED_CSV_COLUMNS if c not in ("customerID", "Churn")]
    present = [c for c in req if c in df.columns]
    missing = sorted(set(req) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return df.select(*[F.col(c).alias(CSV_TO_TYPED[c]) for c in present])


def recode(c: Column, old: str, new: str) -> Column:
    """Rewrite one stored code to another."""
    return F.when(c == old, F.lit(new)).otherwise(c)


def missing_cells(raw: DataFrame, cols) -> DataFrame:
    """One failure record per empty or null required cell; white space is a value."""
    recs = [F.when(F.coalesce(F.col(c), F.lit("")) == "",
                   F.struct(F.lit(c).alias("column"),
                            F.lit(f"Missing value in column: {c}").alias("message")))
            for c in cols]
    return (raw.select("row_no", F.explode(F.array_compact(F.array(*recs))).alias("e"))
            .select("row_no", "e.column", "e.message"))


KEY_BYTES, NONCE_BYTES, LEAST_STORED = 32, 12, 13       # fixed values: AES-256, GCM nonce, least stored length


def new_key() -> str:
    """T4: a random key as base64 text."""
    return base64.b64encode(os.urandom(KEY_BYTES)).decode()


def _key(key: str) -> Column:
    try:
        raw = base64.b64decode(key, validate=True)
    except ValueError as e:
        raise ValueError(f"Invalid encryption key: {e}") from e
    if len(raw) != KEY_BYTES:
        raise ValueError("Invalid encryption key: Encryption key must be 32 bytes (256 bits)")
    return F.unhex(F.lit(raw.hex()))


def encrypt(text: Column, key: str) -> Column:
    """T4: AES-256-GCM of UTF-8 text as nonce + ciphertext + tag, a new random nonce per row.
    A null or empty text fails the query.  The key becomes a literal of the plan: keep plans out of logs."""
    k = _key(key)
    return F.when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit("Cannot encrypt empty string")).cast("binary")).otherwise(
        F.aes_encrypt(text, k, F.lit("GCM")))


def decrypt(stored: Column, key: str) -> Column:
    """T4: the text of a stored value; null, short or tampered values fail the query."""
    k = _key(key)
    return F.when(F.coalesce(F.length(stored), F.lit(0)) < LEAST_STORED, F.raise_error(F.lit("Invalid encrypted data")).cast("string")).otherwise(
        F.aes_decrypt(stored, k, F.lit("GCM")).cast("string"))


def encrypt_optional(text: Column, key: str) -> Column:
    """T4: as :func:`encrypt`, null for null, empty and blank texts."""
    return F.when(text.rlike(r"(?U)[^\s]"), encrypt(text, key))


def decrypt_optional(stored: Column, key: str) -> Column:
    """T4: as :func:`decrypt`, null for null and empty values."""
    return F.when(F.length(stored) > 0, decrypt(stored, key))
