"""Files that arrive in a folder, ingested as they come: an extension beside the batch plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessel.sources.files import FILE, as_documents


def document_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """doc_name, content, doc_size, doc_type of new files."""
    files = spark.readStream.schema(FILE).format("binaryFile").option("maxFilesPerTrigger", max_files).load(folder)
    return as_documents(files)


def ingest_stream(stream: DataFrame, ingest: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ingest(documents, batch id) for each batch; all that is there is taken, then the query ends."""
    return stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
