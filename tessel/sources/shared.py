"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from . import filesystem


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a new local one where that is unset and all tasks run in this process, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = getattr(spark, "_tessel_shared", None)
    if own is None:
        own = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark._tessel_shared = own
    return own


#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES, _UNBOUNDED = 8 << 20, str(2**31 - 1)


def bound_batches(spark: SparkSession) -> None:
    """Limits Arrow batches by bytes, where the session leaves that open: a row may be a block of vectors or a long text."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, _UNBOUNDED) == _UNBOUNDED:
        spark.conf.set(name, str(BATCH_BYTES))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
#: Codec of tables of texts: two thirds of the bytes of Spark's own choice.
TEXTS = "zstd"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it is done, not when the driver happens to collect its garbage: for writes, whose plans nothing runs again.

    The setting is the session's and is put back; while another thread is inside, it stays.
    """
    with _lock:
        inside, before = getattr(spark, "_tessel_inside", (0, spark.conf.get(_CLEANUP, "false")))
        spark._tessel_inside = (inside + 1, before)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            inside, before = spark._tessel_inside
            spark._tessel_inside = (inside - 1, before)
            if inside == 1:
                spark.conf.set(_CLEANUP, before)
                del spark._tessel_inside


def keep(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it: cuts the lineage, survives lost executors. codec: of the files, else the session's."""
    return keep_parts(lambda _: df, 1, codec)


def keep_parts(made: Callable[[int], DataFrame], n: int, codec: str | None = None) -> DataFrame:
    """The rows of made(0) to made(n - 1) as one table, written one after the other, so that only one of them at a time has shuffle files."""
    path = None
    for i in range(n):
        df = made(i)
        spark = df.sparkSession
        path = path or f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        with shuffles_end(spark):
            df.write.options(**{"compression": codec} if codec else {}).mode("append" if i else "error").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessel_kept = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables that keep() or with_ids() wrote and that nothing reads any more."""
    for df in tables:
        filesystem.remove(df.sparkSession, df._tessel_kept)
