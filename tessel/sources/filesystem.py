"""Small files of a store's log, through the file system that Spark's own paths name.

Spark's readers and writers have no create-if-absent, which a log of versions needs, so this module alone goes through the JVM
(`_jvm`): it lists a folder, reads and writes a small file, removes a folder. Nothing here touches rows.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder, none if it isn't there."""
    p, fs = _system(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def read(spark: SparkSession, path: str) -> str:
    p, fs = _system(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _system(spark, path)
    fs.delete(p, True)


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with this text, whole from its first moment; False, and nothing made, if there is one of its name.

    The text is written under a name of its own and then given the right one: on local folders by a hard link, elsewhere by a rename that
    doesn't overwrite. Both are single steps of the file system (a rename is on HDFS; a store without one can't take a log of versions).
    """
    p, fs = _system(spark, path)
    fs.mkdirs(p.getParent())
    own = spark._jvm.org.apache.hadoop.fs.Path(p.getParent().getParent(), f".{uuid.uuid4().hex}")
    stream = fs.create(own, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda x: unquote(urlparse(x.toUri().toString()).path)
            try:
                os.link(local(own), local(p))
            except FileExistsError:
                return False
            return True
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
        try:
            context.rename(own, p, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:  # py4j wraps what the file system says
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True
    finally:
        fs.delete(own, False)
