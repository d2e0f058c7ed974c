"""Session construction and lineage helpers."""
from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "tidemark", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    On a cluster pass ``master=None`` and let spark-submit decide; the
    shuffle partition count then stays whatever the cluster config says.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf["spark.driver.memory"] = os.environ.get("TIDEMARK_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``.  Where it is unset a
    local session (tests) gets a scratch folder; a cluster session raises, as
    a driver-local folder would be invisible to the executors."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
        configured = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives the
    loss of executors, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_STORED: list = []


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    read it back: cuts the lineage, is columnar and compressed, and later jobs
    read only the columns they need.  The folders go when the driver exits,
    or earlier through :func:`release`."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _STORED:
        atexit.register(release, spark)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables (all of this driver's when no path is given)."""
    sc = spark.sparkContext
    if getattr(sc, "_jsc", None) is None:
        return
    for path in paths or list(_STORED):
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
        if path in _STORED:
            _STORED.remove(path)
