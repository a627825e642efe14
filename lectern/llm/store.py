"""Intermediate tables and files in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a folder of our own under a local master, which has one machine only; on a cluster an error, as no
    folder is known to be shared.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local-cluster") and context.master.startswith("local"):
        folder = f"file:///tmp/checkpoints/lectern-{os.getuid()}"
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


_work: ContextVar[str | None] = ContextVar("work", default=None)


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own for one run of one operator."""
    return f"{_work.get() or shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def workspace(spark: SparkSession, label: str) -> Iterator[str]:
    """All paths that are made inside lie under one folder, which goes at the end; results must be written elsewhere before."""
    path = scratch(spark, label)
    before = _work.set(path)
    try:
        yield path
    finally:
        _work.reset(before)
        dropped(spark, path)


#: Bytes of an Arrow batch, about, where the session does not say otherwise; Spark's own default is 64 MB, held by JVM and worker at once.
BATCH_BYTES, BATCH_SETTING = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of about ``BATCH_BYTES``; a value that the session has set stays."""
    if spark.conf.get(BATCH_SETTING, "67108864b") == "67108864b":
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


#: Spark removes the shuffle files of a query as it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Share of the driver's heap in use above which it is collected between queries. What lives there is far less; the rest is of queries that have ended.
HEAP_SHARE = 0.3


def relieved(spark: SparkSession) -> None:
    """The driver lets go of plans, task records and broadcasts of queries that have ended; left alone, a JVM may first grow to its whole heap."""
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() - runtime.freeMemory() > HEAP_SHARE * runtime.maxMemory():
        jvm.java.lang.System.gc()


def trimmed() -> None:
    """The C library gives the memory that Python has freed back to the system; other libraries than glibc are left as they are."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it again: lineage ends, lost executors cost nothing, and the write's shuffle files go with it."""
    spark = df.sparkSession
    was = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, was)
    relieved(spark)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
