"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Defaults a job of this library wants; anything the cluster already set wins.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # numpy kernels run inside many concurrent Python workers: one BLAS thread each
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.MKL_NUM_THREADS": "1",
}


def get_session(app_name: str = "doppel", master: str | None = None,
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE and skew-join handling switched on."""
    for var in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(var, "1")  # local mode: workers inherit the driver's environment
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    checkpoint_dir(spark)
    ship_package(spark)
    bound_batches(spark)
    return spark


#: Bytes after which an Arrow batch for a Python worker is closed, where the session has Spark's default of 64 MB.
BATCH_BYTES = 4 << 20
_BATCH_KEY, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864", "67108864b", "64m", "64mb")


def bound_batches(spark: SparkSession) -> None:
    """Have Arrow batches closed at ``BATCH_BYTES``; a size that the caller set is kept.

    The executor and its worker both hold a batch several times over, and a pair of packed blocks is a row
    of some 10 MB: by Spark's default several of them would travel together.
    """
    if str(spark.conf.get(_BATCH_KEY, _SPARKS_OWN[0])).lower() in _SPARKS_OWN:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``doppel`` importable in executor Python workers (``addPyFile`` of a zip)."""
    import zipfile

    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="doppel-py-"), "doppel.zip")
    with zipfile.ZipFile(out, "w") as zf:
        for root, _dirs, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(id(sc))


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only when none is configured.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS / object store); it is used
    as is.  Only in local mode with nothing configured (unit tests, a laptop) a local temporary
    folder is set; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="doppel-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


_KEPT: list[DataFrame] = []


#: Rows of a cached batch.  Spark writes cached batches with Java's serialization, which holds on to the last 100
#: objects written; batches of up to 4 MB (Spark's 10,000 rows of vectors) would take most of an executor's heap.
CACHED_ROWS = 256
_CACHED_KEY = "spark.sql.inMemoryColumnarStorage.batchSize"


def cached(df: DataFrame) -> DataFrame:
    """Persist ``df`` in memory as objects, on disk where that is short, in small batches."""
    conf = df.sparkSession.conf
    before = conf.get(_CACHED_KEY)
    conf.set(_CACHED_KEY, str(min(int(before), CACHED_ROWS)))
    try:
        return df.persist(StorageLevel.MEMORY_AND_DISK_DESER)
    finally:
        conf.set(_CACHED_KEY, before)


def keep(df: DataFrame) -> DataFrame:
    """Persist an intermediate result of the library until ``release``."""
    _KEPT.append(cached(df))
    return df


def drop_kept(df: DataFrame) -> None:
    """Unpersist one result of ``keep`` that nothing reads any more."""
    _KEPT[:] = [x for x in _KEPT if x is not df]
    df.unpersist()


def release() -> None:
    """Unpersist what ``keep`` persisted and nothing else; results that still need it recompute."""
    while _KEPT:
        df = _KEPT.pop()
        if df.sparkSession.sparkContext._jsc is not None:  # its session may have been stopped
            df.unpersist()
