"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.session import checkpoint_dir, ship_package

#: White space of the word definition: space, tab, LF, VT, FF, CR.  ``bytes.split()`` cuts at the
#: same six characters.
WORD_RE = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch where the session has Spark's default of 10,000: whole texts are large.
_BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000")


def prepare(spark: SparkSession) -> SparkSession:
    """Set the checkpoint folder if the session has none and ship the package to the workers.

    Arrow batches that have Spark's default length are made shorter, so that a Python worker holds
    some megabytes of text at a time; a length that the caller set is kept.
    """
    key, default, rows = _BATCH
    if spark.conf.get(key) == default:
        spark.conf.set(key, rows)
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


#: Bytes of an Arrow batch beyond which it is closed, whatever its rows.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def bounded_batches(spark: SparkSession, size: int):
    """Within it, Arrow batches for Python workers have about ``size`` bytes at most, or as few as the session sets.

    For what is run there, not for plans that are only made there.  A number of rows does not bound a batch
    of whole texts or long arrays, which the executor and the worker hold several times over.
    """
    before = spark.conf.get(_BATCH_BYTES, None)
    if before is None or not before.isdigit() or not 0 < int(before) <= size:
        spark.conf.set(_BATCH_BYTES, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_BYTES)
        else:
            spark.conf.set(_BATCH_BYTES, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_names(columns: list[str], *names: str) -> list[str]:
    """``names``, each lengthened until no column (in any case) has it: for an operator's inner columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bytes of a table, as Spark measures it once written, up to which it is sent to every task.
SMALL_BYTES = 32 << 20


def beside(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, marked for broadcast if what was written is small.

    Beyond the bound Spark chooses the join, and adaptive execution may split its hot keys.
    """
    spark = df.sparkSession
    path = scratch(spark, "beside")
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    df = spark.read.parquet(path)
    return F.broadcast(df) if size <= SMALL_BYTES else df


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared checkpoint folder for a written table."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of this job's own that ``scratch`` named."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered_index(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``idx``: the position (from 0) of each row in the order given.

    The rows are range-partitioned and sorted, then cut from their lineage, so the positions stay
    put if a task is run again.  Only one count per partition reaches the driver.
    """
    parts = shuffle_partitions(df.sparkSession)
    out = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
             .withColumn("_mid", F.monotonically_increasing_id()).checkpoint())
    part = F.shiftright("_mid", 33)
    before, starts = 0, {}
    for pid, n in sorted((r[0], r[1]) for r in out.groupBy(part.alias("p")).count().collect()):
        starts[pid] = before
        before += n
    if not starts:
        return out.withColumn("idx", F.lit(0).cast("long")).drop("_mid")
    offsets = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])
    low = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn("idx", (offsets[part] + low).cast("long")).drop("_mid")
