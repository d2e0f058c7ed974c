"""File sources and sinks (S1..S9)."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATASET_REUSE_STATUSES = ("processing", "ready")   # fixed value: reusable uploads
#: Bytes of a file that one row holds while it is hashed.
PIECE = 8_192
#: Names that the text reader would unpack.
PACKED = ("gz", "deflate", "bz2", "lz4", "snappy", "zst")
_PIECES = "file string, size long, start long, number long, piece binary"


def csv_scan(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Header CSV, UTF-8, every column a string (no inference, no size
    cap).  Files are split over tasks; ``multi_line`` lets quoted fields span
    lines, at one task per file."""
    return (spark.read.option("header", True).option("multiLine", multi_line).option("encoding", "UTF-8")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .option("mode", "FAILFAST").csv(path))


def score_csv_scan(spark: SparkSession, path: str, required) -> DataFrame:
    """Type-inferred CSV; rows empty in every required column dropped.
    (Inference reads the file twice; for large inputs pass a schema.)"""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df.dropna(how="all", subset=[c for c in required if c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True).option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def records_sink(df: DataFrame, path: str, partition_col: str) -> None:
    """Typed rows appended as parquet partitioned by dataset."""
    df.write.mode("append").partitionBy(partition_col).parquet(path)


def all_or_nothing(df: DataFrame, errors: DataFrame, path: str, partition_col: str) -> DataFrame:
    """Write only when validation found nothing; the dataset's
    partitions are replaced as a whole (dynamic partition overwrite), so a
    rerun never leaves half a load behind.  Returns one status row."""
    n_err = errors.select(F.count(F.lit(1))).first()[0]
    spark = df.sparkSession
    if n_err == 0:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_col).parquet(path)
        written = spark.read.parquet(path).count()
        status = "ready"
    else:
        written, status = 0, "failed"
    return spark.createDataFrame([(status, int(n_err), int(written))],
                                 "status string, error_count long, rows_written long")


def to_payload(df: DataFrame, col: str) -> DataFrame:
    """Nested column to a JSON text column (as stored)."""
    return df.withColumn(col, F.to_json(col))


def from_payload(df: DataFrame, col: str, ddl: str) -> DataFrame:
    return df.withColumn(col, F.from_json(col, ddl))


def _pieces(batches):
    """Lines (file, size, start, line) as numbered pieces of the files' bytes, each line with its line end."""
    number = 0
    for b in batches:
        if not b.num_rows:
            continue
        whole = pc.binary_join_element_wise(b.column("line"), pa.scalar(b""), pa.scalar(b"\n"))
        ends, data = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset:whole.offset + b.num_rows + 1], whole.buffers()[2]
        file, start = pc.dictionary_encode(b.column("file")).indices.to_numpy(), b.column("start").to_numpy()
        cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            at, end = int(ends[lo]), int(ends[hi])
            while at < end:
                part = [data[i:min(end, i + PIECE)].to_pybytes() for i in range(at, min(end, at + 1_024 * PIECE), PIECE)]
                n = len(part)
                own = [pa.array([b.column(c)[lo].as_py()] * n, t) for c, t in (("file", pa.string()), ("size", pa.int64()), ("start", pa.int64()))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(range(number, number + n), pa.int64()), pa.array(part, pa.binary())],
                                                 names=["file", "size", "start", "number", "piece"])
                at, number = at + n * PIECE, number + n


def _digests(batches):
    """Ordered pieces to (file, sha256).  The text reader leaves out a byte order mark at the start and does not tell
    whether the last line had an end: the file's size does."""
    mark, file, size, told, last, plain, marked = b"\xef\xbb\xbf", None, 0, 0, b"", None, None

    def done():
        if size - told not in (-1, 0, 2, 3):
            raise ValueError(f"{told} bytes read of {size} in {file}")
        h = marked if size - told > 0 else plain
        if size - told in (0, 3):
            h.update(last)
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([h.hexdigest()])], names=["file", "sha256"])

    for b in batches:
        names, sizes, pieces = b.column("file").to_pylist(), b.column("size").to_pylist(), b.column("piece")
        for i, name in enumerate(names):
            if name != file:
                if file is not None:
                    yield done()
                file, size, told, last, plain, marked = name, sizes[i], 0, b"", hashlib.sha256(), hashlib.sha256(mark)
            piece = pieces[i].as_py()
            for h in (plain, marked):
                h.update(last)
                h.update(memoryview(piece)[:-1])
            told, last = told + len(piece), piece[-1:]
    if file is not None:
        yield done()


def content_hashes(spark: SparkSession, glob: str) -> DataFrame:
    """SHA-256 of each file's bytes; a later upload with the same hash
    reuses the newest earlier one.

    Files are read as lines of bytes by as many tasks as they have splits, and hashed piece by piece in order
    of place: no row holds more than a line, whatever the size of a file.  The hash itself is sequential, so a file's
    pieces meet in one task, a batch at a time.  Names the reader would unpack (``PACKED``) are read as whole rows."""
    at = F.col("_metadata.file_path").alias("file")
    files = spark.read.format("binaryFile").load(glob).select("path", "length", "modificationTime", at)
    lines = spark.read.option("lineSep", "\n").text(glob).where(~F.col("_metadata.file_path").rlike(rf"\.({'|'.join(PACKED)})$")).select(
        at, F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    pieces = lines.mapInArrow(_pieces, _PIECES).repartition("file").sortWithinPartitions("file", "start", "number")
    packed = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(PACKED)}}}").load(glob)
    hashes = pieces.mapInArrow(_digests, "file string, sha256 string").unionByName(packed.select(at, F.sha2("content", 256).alias("sha256")))
    bare = F.sha2(F.when(F.col("length") == 3, F.lit(b"\xef\xbb\xbf")), 256)      # a mark alone has no line
    return files.join(hashes, "file", "left").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
                                                     F.coalesce("sha256", bare).alias("sha256"), F.col("length"),
                                                     F.col("modificationTime").alias("uploaded_at"))


def reuse_by_hash(uploads: DataFrame, datasets: DataFrame) -> DataFrame:
    """For each upload, the newest dataset with the same hash whose
    status is processing or ready (grouped max_by, no window)."""
    usable = datasets.where(F.col("status").isin(*DATASET_REUSE_STATUSES))
    newest = usable.groupBy("sha256").agg(F.max_by("dataset_id", F.struct("uploaded_at", "dataset_id"))
                                          .alias("reuse_dataset_id"))
    return uploads.join(newest, "sha256", "left")


def dataset_scan(records: DataFrame, datasets: DataFrame, dataset_ids=None) -> DataFrame:
    """S3: rows of datasets whose status is ready (semi join, so a record is
    never duplicated), optionally restricted to some dataset ids, which a
    ``partitionBy('dataset_id')`` layout turns into partition pruning."""
    ready = datasets.where(F.col("status") == "ready").select("dataset_id")
    if dataset_ids is not None:
        ids = list(dataset_ids)
        records = records.where(F.col("dataset_id").isin(ids))
        ready = ready.where(F.col("dataset_id").isin(ids))
    return records.join(ready, "dataset_id", "left_semi")
