"""Text files in, documents out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from tessel.functions.text import safe_path

from .shared import keep
from .snapshots import Store

SUFFIXES = (".txt", ".md")
FILE = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def as_documents(files: DataFrame) -> DataFrame:
    """doc_name, content, doc_size, doc_type of files (path, content) with a known suffix (in this case); text that isn't UTF-8 fails."""
    known = F.lit(False)
    for s in SUFFIXES:
        known = known | F.col("path").endswith(s)
    text = F.decode("content", "UTF-8")
    name = F.try_url_decode(F.regexp_extract("path", r"([^/]+)$", 1))
    return files.where(known).select(name.alias("doc_name"), text.alias("content"), F.length(text).alias("doc_size"), _type(F.col("path")).alias("doc_type"))


def _type(path: Column) -> Column:
    return F.when(path.endswith(".md"), "text/markdown").otherwise("text/plain")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return as_documents(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def with_paths(documents: DataFrame) -> DataFrame:
    """documents (id, doc_name, …) with the path that each is filed under."""
    return documents.withColumn("path", safe_path("id", "doc_name"))


def changed(current: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths that are new or have other content, paths that are gone), by content hash; both empty means nothing to commit."""
    mark = lambda df: df.select("path", F.sha2("content", 256).alias("hash"))
    new, old = mark(current), mark(before)
    return current.join(new.join(old, ["path", "hash"], "left_anti").select("path"), "path", "left_semi"), old.join(new, "path", "left_anti").select("path")


#: The log of files, what is written or gone in each version, and of the versions.
TABLES = {"files": "path string, content string, gone boolean, version long", "commits": "version long, message string, n_changed long, n_gone long"}


def rows_of(changed_documents: DataFrame, gone_documents: DataFrame | None, message: str, version: int) -> dict[str, DataFrame]:
    """Rows to add to files and commits for documents (id, doc_name, content) that are new or have changed, and for those that are gone."""
    mark = F.lit(version).cast("long").alias("version")
    rows = with_paths(changed_documents).select("path", "content", F.lit(False).alias("gone"), mark)
    if gone_documents is not None:
        rows = rows.unionByName(with_paths(gone_documents).select("path", F.lit(None).cast("string").alias("content"), F.lit(True).alias("gone"), mark))
    rows = keep(rows)
    line = rows.agg(F.count(F.when(~F.col("gone"), 1)).alias("n_changed"), F.count(F.when(F.col("gone"), 1)).alias("n_gone"))
    return {"files": rows, "commits": line.select(mark, F.lit(message).alias("message"), "n_changed", "n_gone")}


def tree(store: Store, version: int | None = None) -> DataFrame:
    """path, content of the files of a version: of each path what was written last, if that isn't its removal."""
    log = store.read("files", version)
    last = log.groupBy("path").agg(F.max_by(F.struct("content", "gone"), "version").alias("last"))
    return last.where("not last.gone").select("path", "last.content")


def commit(store: Store, documents: DataFrame, message: str, at: int | None = None) -> int | None:
    """The files of documents as a new version, with a line in the log (version, message, n_changed, n_gone); None where no file has changed.

    Only files with another content and marks of those that are gone are written, and one line: both tables grow by what has changed.
    """
    version, tables = store.manifest()
    now = keep(with_paths(documents).select("path", "content"))
    before = tree(store) if "files" in tables else now.limit(0)
    new, gone = changed(now, before)
    mark = F.lit(version + 1).cast("long").alias("version")
    rows = keep(new.select("path", "content", F.lit(False).alias("gone"), mark).unionByName(gone.select("path", F.lit(None).cast("string").alias("content"), F.lit(True).alias("gone"), mark)))
    counts = {r["gone"]: r["count"] for r in rows.groupBy("gone").count().collect()}
    if not counts:
        return None
    line = store.spark.createDataFrame([(version + 1, message, counts.get(False, 0), counts.get(True, 0))], "version long, message string, n_changed long, n_gone long")
    return store.publish({"files": rows, "commits": line}, at=version if at is None else at, add=True)


def write_documents(documents: DataFrame, folder: str) -> None:
    """One row a file, with its path, as a table partitioned by nothing: a reader can lay files out from it."""
    with_paths(documents).select("path", "content").write.mode("overwrite").parquet(folder)
