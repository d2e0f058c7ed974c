"""Hashes of files of any size and form."""
import gzip
import hashlib

import numpy as np

from tidemark.sources import io


def test_hashes_of_odd_files_match_their_bytes(spark, tmp_path):
    mark, rng = b"\xef\xbb\xbf", np.random.default_rng(1)
    bodies = {"mark": mark, "end": b"\n", "ends": b"\r\n\n\r", "plain": b"a\nb", "closed": b"a\nb\n", "marked": mark + b"a\nb",
              "marked_closed": mark + mark + b"a\n", "bytes": rng.integers(0, 256, 300_000, np.uint8).tobytes(), "zeros": bytes(100_000),
              "packed.gz": gzip.compress(b"a\nb" * 99), "with space %20": b"x\n", "copy": b"a\nb"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")                 # splits inside lines
    try:
        got = {r.file_name: (r.sha256, r.length) for r in io.content_hashes(spark, f"{tmp_path}/*").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {n: (hashlib.sha256(b).hexdigest(), len(b)) for n, b in bodies.items()}


def test_no_row_holds_a_whole_file(spark, tmp_path):
    """A file larger than a row may be: the whole-file reader refuses it."""
    body = np.random.default_rng(2).integers(0, 256, 400_000, np.uint8).tobytes()
    (tmp_path / "large").write_bytes(body)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100000")
    try:
        got = io.content_hashes(spark, f"{tmp_path}/*").collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [r.sha256 for r in got] == [hashlib.sha256(body).hexdigest()]
