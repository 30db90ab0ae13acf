"""Columns computed from a text column in Arrow batches, beside the columns that are there."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

Work = Callable[[pa.Array], list]
#: Bytes of an Arrow batch on its way to Python, and of text whose results are held at once.
BATCH_BYTES, SLICE_BYTES = 8 << 20, 4 << 20
_UNBOUNDED = str(2**31 - 1)


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Limits Arrow batches by bytes, where the session leaves that open or has more: rows may hold long texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, _UNBOUNDED)
    if now == _UNBOUNDED or now == str(BATCH_BYTES) and size < BATCH_BYTES:
        spark.conf.set(name, str(size))


def release() -> None:
    """Gives freed memory back to the system, as a Python worker outlives its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, text: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of batch with about size bytes of its column text."""
    column = batch.column(text)
    rows = max(1, int(batch.num_rows * size / max(1, column.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def add_columns(df: DataFrame, text_col: str, fields: list[tuple[str, DataType]], make: Callable[[], Work]) -> DataFrame:
    """df with fields added; a column of df that has the name of one is replaced.

    make() is called once a task and returns a function from the text column of a batch to the
    new columns, as Arrow arrays or lists.
    """
    new = {n.lower() for n, _ in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    names = [f.name for f in kept]
    types = [to_arrow_type(t) for _, t in fields]
    source = df.select(*[f"`{n}`" for n in names], df[text_col].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for some in slices(batch, len(names)):
                made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(work(some.column(len(names))), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(names)], *made], names=[*names, *[n for n, _ in fields]])
        release()

    bound_batches(df.sparkSession)
    schema = StructType([*kept, *[StructField(n, t) for n, t in fields]])
    return source.mapInArrow(run, schema)


def keep_where(docs: DataFrame, run: Callable[[DataFrame], DataFrame], made: list[str], condition: Column) -> DataFrame:
    """Rows of docs for which condition holds on run(docs), with the columns of docs as they were, even those named as one that run makes."""
    clash = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c.lower() in made}
    out = run(docs.withColumnsRenamed(clash)).where(condition)
    return out.select(*[out[clash.get(c, c)].alias(c) for c in docs.columns])
