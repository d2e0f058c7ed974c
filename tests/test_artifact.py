"""Saved models, the scoring schema, reading marks."""
import pytest

from pyspark.sql import functions as F
from tidemark.operators import artifact as A
from tidemark.operators import models as M
from tidemark.operators import ops as O
from tidemark.operators import prep
from tidemark.operators import validate as V
from tidemark.roles import CSV_DOMAINS, Roles


def test_artefact_round_trip_and_refusal(spark, tmp_path):
    roles = Roles(id="id", binary=("b",), multi=("c",), numeric=("x",), flag=("f",), label="y", domains={"c": ("k'1", "k2")}, time=None)
    rows = [(i, "Yes" if i % 3 else "No", ["k'1", "k2"][i % 2], float(i % 7) if i % 5 else None, i % 2, i % 4 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, b string, c string, x double, f int, y boolean")
    m, enc = prep.fit(df, roles)
    nb = M.fit_naive_bayes(prep.transform(enc, m, keep=("label",)), m.feature_columns)
    path = str(tmp_path / "model")
    A.save(spark, path, m, nb)
    loaded, back = A.load(spark, path)
    assert loaded == m and back == nb
    A.save(spark, path, m)                                       # replaced; a configuration without a model
    assert A.load(spark, path) == (m, None)
    broken = str(tmp_path / "broken")
    spark.read.parquet(path).where("NOT (stage = 'scale' AND key = 'mean')").write.parquet(broken)
    with pytest.raises(ValueError, match="scaler values"):
        A.load(spark, broken)
    empty = A.missing_parts(spark.createDataFrame([], A.SCHEMA)).first()
    assert (empty.config_complete, empty.missing) == (False, "feature order,scaler,encodings")


def test_rows_without_expected_columns_score(spark):
    roles = Roles(id="id", binary=("b",), multi=("c",), numeric=("x",), flag=("f",), label="y")
    df = spark.createDataFrame([(i, "Yes" if i % 3 else "No", "uvw"[i % 3], float(i), i % 2, i % 4 == 0) for i in range(40)],
                               "id int, b string, c string, x double, f int, y boolean")
    m, _ = prep.fit(df, roles)
    full = prep.apply_to_new_rows(df, m, keep=("id",)).orderBy("id").collect()
    bare = prep.apply_to_new_rows(df.drop("b", "c"), m, keep=("id",)).orderBy("id").collect()
    for a, b in zip(full, bare):
        assert a.x == b.x and a.f == b.f
        assert b.b == pytest.approx(-m.means["b"] / m.scales["b"]) and b.c_u == pytest.approx(-m.means["c_u"] / m.scales["c_u"])


def test_scoring_schema_rules(spark):
    good = {c: list(v)[0] for c, v in CSV_DOMAINS.items()} | {"SeniorCitizen": "0", "tenure": "72", "MonthlyCharges": "0", "TotalCharges": "1000000"}
    faults = [("gender", "male"), ("Partner", " Yes"), ("Contract", ""), ("SeniorCitizen", "2"), ("SeniorCitizen", "yes"), ("tenure", "73"), ("tenure", "-1"),
              ("tenure", "1.5"), ("tenure", "9" * 30), ("MonthlyCharges", "-0.01"), ("MonthlyCharges", "abc"), ("TotalCharges", "1000000.01"),
              ("TotalCharges", " "), ("TotalCharges", "nan"), ("TotalCharges", None)]
    rows = [good] + [good | {c: v} for c, v in faults]
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], "row_no int, " + ", ".join(f"`{c}` string" for c in good))
    found = V.scoring_errors(df, {c: list(v) for c, v in CSV_DOMAINS.items()}).collect()
    assert {(r.row_no, r.column) for r in found} == {(i + 1, c) for i, (c, _) in enumerate(faults)} and len(found) == len(faults)
    assert {r.row_no: r.message for r in found}[2].endswith("got ' Yes'")
    lacking = V.scoring_errors(df.where("row_no = 0").drop("tenure"), {c: list(v) for c, v in CSV_DOMAINS.items()}).collect()
    assert [r.message for r in lacking] == ["Row 0: tenure is required"]
    assert V.scoring_errors(df.limit(0), {}).count() == 0


def test_marking_notifications(spark):
    notes = spark.createDataFrame([(1, 7, False), (2, 7, True), (3, 7, False), (4, 8, False), (5, 8, False), (6, None, False)],
                                  "notification_id long, user_id long, is_read boolean")
    asked = spark.createDataFrame([(7, None), (7, None), (8, 4), (8, 1), (9, 5)], "user_id long, notification_id long")
    got = {r.notification_id: (r.is_read, r.marked) for r in O.mark_read(notes, asked).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (True, True), 4: (True, True), 5: (False, False), 6: (False, False)}
    assert O.mark_read(notes, asked.limit(0)).where("marked").count() == 0


def test_thresholds_are_stored_and_used(spark):
    versions = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "version_id long")
    asked = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 1.01), (4, None), (9, 0.3)], "version_id long, threshold double")
    stored = O.set_thresholds(versions, asked)
    got = {r.version_id: (r.classification_threshold, r.refused is not None) for r in stored.collect()}
    assert got == {1: (0.0, False), 2: (1.0, False), 3: (0.5, True), 4: (0.5, True), 5: (0.5, False)}
    assert [r.version_id for r in O.unknown_versions(versions, asked).collect()] == [9]
    again = O.set_thresholds(stored.drop("refused"), asked.where("version_id = 1").withColumn("threshold", F.lit(-1.0)))
    assert again.where("version_id = 1").first().classification_threshold == 0.0                     # refused: kept
    scored = spark.createDataFrame([(1, 0.0), (2, 0.99), (3, 0.5), (7, 0.6), (None, 0.4)], "version_id long, probability double")
    assert {r.version_id: r.prediction for r in O.decide(scored, stored).collect()} == {1: True, 2: False, 3: True, 7: True, None: False}


def test_report_lists(spark):
    reports = spark.createDataFrame([(1, 7, "2024-01-01"), (2, 7, "2024-01-03"), (3, None, "2024-01-02"), (4, 7, "2024-01-03")],
                                    "report_id long, owner_id long, generated_at string").withColumn("generated_at", F.col("generated_at").cast("timestamp"))
    order = lambda df: [r.report_id for r in df.orderBy("position").collect()]
    assert order(O.list_reports(reports, 7)) == [4, 2, 1] and order(O.list_reports(reports, 7, "Admin")) == [4, 2, 3, 1]
    assert order(O.list_reports(reports, 8)) == []
    assert sorted((r.owner_id or 0, r.report_id, r.position) for r in O.list_reports(reports).collect()) == [(0, 3, 1), (7, 1, 3), (7, 2, 2), (7, 4, 1)]
