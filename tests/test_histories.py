"""Owner lists, histories, cascades, encryption and first rows of a stream on small frames."""
import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import ops, score, validate
from tidemark.session import ensure_checkpoint_dir
from tidemark.streaming import streams as S

DAY = dt.datetime(2024, 1, 1)


def test_datasets_newest_first_with_ties_nulls_and_owners(spark):
    d = spark.createDataFrame([(1, 7, DAY), (2, 7, DAY), (3, None, DAY + dt.timedelta(1)), (4, 8, None)],
                              "dataset_id long, owner_id long, uploaded_at timestamp")
    everyone = {r.dataset_id: (r.position, r.total) for r in ops.list_datasets(d).collect()}
    assert everyone == {4: (1, 4), 3: (2, 4), 2: (3, 4), 1: (4, 4)}
    assert {r.dataset_id: (r.position, r.total) for r in ops.list_datasets(d, owner_id=7).collect()} == {2: (1, 2), 1: (2, 2)}
    own = {r.dataset_id: (r.position, r.total) for r in ops.list_datasets(d, per_owner=True).collect()}
    assert own == {2: (1, 2), 1: (2, 2), 3: (1, 1), 4: (1, 1)}
    assert ops.list_datasets(d.limit(0)).count() == 0


def test_owner_pages_and_history(spark):
    rows = [(i, 1 if i < 5 else None, "a" if i % 2 else None, DAY + dt.timedelta(0, i // 3)) for i in range(8)]
    p = spark.createDataFrame(rows, "prediction_id long, owner_id long, batch_id string, created_at timestamp")
    got = {r.prediction_id: (r.rank, r.page, r.total, r.total_pages) for r in score.owned_pages(p, 2, by_batch=False).collect()}
    assert got == {0: (1, 1, 5, 3), 1: (2, 1, 5, 3), 2: (3, 2, 5, 3), 3: (4, 2, 5, 3), 4: (5, 3, 5, 3),
                   5: (1, 1, 3, 2), 6: (2, 1, 3, 2), 7: (3, 2, 3, 2)}
    assert [r.prediction_id for r in score.owned_pages(p, 2, page=2).where("owner_id = 1 AND batch_id IS NULL").collect()] == [4]
    for size, page in ((0, None), (101, None), (5, 0)):
        with pytest.raises(ValueError):
            score.owned_pages(p, size, page=page)


def test_cascade_history_and_bulk_clear(spark):
    parent = spark.createDataFrame([(1,), (1,), (None,)], "dataset_id long")
    child = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, None)], "job_id long, dataset_id long")
    row = ops.cascade_counts(parent, {"jobs": child, "none": child.limit(0)}, "dataset_id").collect()
    assert {r.table_name: (r.deleted, r.kept) for r in row} == {"jobs": (2, 2), "none": (0, 0)}
    metrics = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, None)], "event_id long, job_id long")
    left, deleted = ops.delete_history(metrics, spark.createDataFrame([(10,), (10,), (12,), (None,)], "job_id long"))
    assert sorted(r.event_id for r in left.collect()) == [3, 4]
    assert {r.job_id: r.deleted_count for r in deleted.collect()} == {10: 2, 12: 0}
    path = S.scratch(spark, "clear")
    child.write.parquet(path)
    assert [tuple(r) for r in ops.bulk_clear(spark, {"jobs": path}).collect()] == [("jobs", 4, 0)]
    assert [tuple(r) for r in ops.bulk_clear(spark, {"jobs": path}).collect()] == [("jobs", 0, 0)]
    assert spark.read.parquet(path).schema.names == child.columns


def test_encryption(spark):
    key = validate.new_key()
    texts = ["0002-ABCD", "für 𝔘", "", "  \t", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    enc = d.select("i", validate.encrypt_optional(F.col("t"), key).alias("c"))
    out = {r.i: (r.n, r.back) for r in enc.select("i", F.length("c").alias("n"), validate.decrypt_optional(F.col("c"), key).alias("back")).collect()}
    assert out == {0: (37, texts[0]), 1: (28 + len(texts[1].encode()), texts[1]), 2: (None, None), 3: (None, None), 4: (None, None)}
    one, two = (r.c for r in spark.createDataFrame([("same",), ("same",)], "t string").select(
        validate.encrypt(F.col("t"), key).alias("c")).collect())
    assert one != two                                               # a nonce per row
    for bad in (d.where("i = 2").select(validate.encrypt(F.col("t"), key)),
                spark.createDataFrame([(bytearray(b"short"),)], "c binary").select(validate.decrypt(F.col("c"), key)),
                spark.createDataFrame([(bytearray(two[:-1]) + bytes([two[-1] ^ 1]),)], "c binary").select(validate.decrypt(F.col("c"), key))):
        with pytest.raises(PySparkException):
            bad.collect()
    for wrong in ("c2hvcnQ=", "not base64!"):
        with pytest.raises(ValueError):
            validate.encrypt(F.col("t"), wrong)


def feed(spark, src, rows):
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(src)


def kept(spark, src, out, ck, **options):
    stream = S.file_stream(spark, src, "user_id long, event_id long, ts timestamp")
    d = S.first_rows_stream(stream, "user_id", "ts", "event_id", **options)
    S.run_available(d.writeStream.outputMode("append").format("parquet").option("path", out), ck)
    return sorted(((r.user_id, r.event_id) for r in spark.read.parquet(out).collect()), key=str)


def test_first_rows_survive_a_restart(spark):
    ensure_checkpoint_dir(spark)
    src, out, ck = (S.scratch(spark, f"first-{x}") for x in ("src", "out", "ck"))
    feed(spark, src, [(1, 12, DAY), (1, 11, DAY), (2, 13, DAY), (None, 14, DAY), (3, 15, None)])
    assert kept(spark, src, out, ck) == [(1, 11), (2, 13), (3, 15), (None, 14)]
    feed(spark, src, [(1, 21, DAY - dt.timedelta(1)), (4, 22, DAY), (None, 23, DAY)])
    assert kept(spark, src, out, ck) == [(1, 11), (2, 13), (3, 15), (4, 22), (None, 14)]


def test_first_rows_forget_after_the_horizon(spark):
    src, out, ck = (S.scratch(spark, f"horizon-{x}") for x in ("src", "out", "ck"))
    for day, event in ((0, 1), (0.5, 2), (9, 3), (20, 4)):
        feed(spark, src, [(1 if event != 3 else 2, event, DAY + dt.timedelta(day))])
        got = kept(spark, src, out, ck, horizon="1 day")
    assert got == [(1, 1), (1, 4), (2, 3)]
