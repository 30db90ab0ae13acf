"""Approximate vector search: short codes of all vectors, the best of them compared exactly.

Centroids are fitted by k-means on a bounded sample; each vector is in the list of its nearest centroid, and what is left of it is kept in
four bits a value with one scale. A search scores the codes, an eighth of the vectors' bytes, of the lists nearest to each query, and reads the vectors
of the best candidates only. The index is a table by tenant, in each sorted by list; insertions are new files of it, deletions marks that hide older rows.
Lengths are taken out first, so near means a large cosine. Vectors without a value, which no search finds, are in the list NO_LIST.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tessel.functions import vector as v
from tessel.sources.shared import bound_batches, keep, shared_folder

from .blocks import nearest
from .search import DEFAULT_K, ranked

#: The most lists: centroids go to the tasks. Without a number there is one for each PER_LIST vectors.
MOST_LISTS, PER_LIST = 4096, 256
#: Vectors, in expectation, that centroids are fitted on.
SAMPLE = 100_000
#: Candidates that are compared exactly, for each of the k hits.
RERANK = 8
ITERATIONS, SEED, NO_LIST = 10, 7, -1
#: Centroids that have all moved less are final. Products with centroids that are made at once.
MOVED, TILE = 1e-4, 1 << 20
#: Bytes of candidates, with their queries, that go to all tasks; more are dealt with the vectors.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class VectorIndex:
    path: str
    schema: StructType
    centroids: np.ndarray
    session: object

    @property
    def rows(self) -> DataFrame:
        """The vectors with their lists and codes, without those that were deleted."""
        rows = self.session.read.schema(self.schema).parquet(f"{self.path}/rows")
        gone = self.session.read.schema("chunk_id long, __until long").parquet(f"{self.path}/gone")
        last = gone.groupBy("chunk_id").agg(F.max("__until").alias("__until"))
        hidden = (rows["chunk_id"] == last["chunk_id"]) & (rows["__batch"] <= last["__until"])
        return rows.join(last, hidden, "left_anti")


def _unit(embedding: Column) -> Column:
    """Of length 1, or 0 if all places are."""
    values, length = embedding.cast("array<double>"), v.norm(embedding)
    return F.when(length > 0, F.transform(values, lambda x: x / length)).otherwise(values)


def _places(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half, step = (centroids**2).sum(axis=1) / 2, max(1, TILE // max(1, len(centroids)))
    places = [np.argmin(half - rows[a : a + step] @ centroids.T, axis=1) for a in range(0, len(rows), step)]
    return np.concatenate(places) if places else np.empty(0, np.int64)


def encode(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(lists, codes, scales) of unit vectors: two values a byte, each in 16 steps of the vector's own scale around its centroid."""
    lists = _places(rows, centroids)
    left = rows - centroids[lists]
    scale = np.maximum(np.abs(left).max(axis=1, initial=0), 1e-12) / 7.5
    steps = np.clip(np.round(left / scale[:, None] + 7.5), 0, 15).astype(np.uint8)
    if steps.shape[1] % 2:
        steps = np.pad(steps, ((0, 0), (0, 1)))
    packed = (steps[:, ::2] << 4) | steps[:, 1::2]
    return lists, [p.tobytes() for p in packed], scale


def decode(lists: np.ndarray, codes: list[bytes], scales: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    packed = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    steps = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(codes), -1)[:, : centroids.shape[1]]
    return centroids[lists] + (steps - 7.5) * scales[:, None]


def _coded(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors with list, code, scale and __batch, the time from which they are there."""
    schema = StructType([*vectors.schema.fields, *StructType.fromDDL("list int, code binary, scale float, __batch long").fields])
    now = time.time_ns()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            valued = f["embedding"].map(lambda e: e is not None and len(centroids) > 0).to_numpy(bool)
            lists, codes, scales = np.full(len(f), NO_LIST, np.int32), [None] * len(f), np.zeros(len(f), np.float32)
            if valued.any():
                rows = np.stack(f["embedding"][valued].to_numpy()).astype(np.float64)
                rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
                own, made, scale = encode(rows, centroids)
                lists[valued], scales[valued] = own, scale
                for i, c in zip(np.flatnonzero(valued).tolist(), made, strict=True):
                    codes[i] = c
            yield f.assign(list=lists, code=codes, scale=scales, __batch=now)

    return vectors.mapInPandas(run, schema)


def _write(vectors: DataFrame, centroids: np.ndarray, path: str) -> StructType:
    made = _coded(vectors, centroids)
    # large tenants are split over files and small ones share tasks, by AQE
    made.hint("rebalance", "tenant_id").sortWithinPartitions("tenant_id", "list").write.mode("append").partitionBy("tenant_id").parquet(f"{path}/rows")
    return made.schema


def _fitted(points: DataFrame, lists: int) -> np.ndarray:
    """The centroids of points (place, unit) by k-means, from the points of the least places. The means are made by tasks; the driver gets no more than the centroids."""
    last = points.select("place").orderBy("place").limit(lists).agg(F.max("place")).first()[0]
    first = points.where(F.col("place") <= last).orderBy("place").limit(lists).collect() if last is not None else []
    if not first:
        return np.empty((0, 0))
    centroids = np.unique(np.array([r["unit"] for r in first], np.float64), axis=0)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch["unit"].flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(_places(rows, centroids), pa.int32()), batch["unit"]], ["list", "unit"])

    for _ in range(ITERATIONS):
        means = points.select("unit").mapInArrow(listed, "list int, unit array<double>").groupBy("list").agg(Summarizer.mean(array_to_vector("unit")).alias("mean"))
        moved = centroids.copy()
        for r in means.collect():
            moved[r["list"]] = r["mean"].toArray()
        still = ((moved - centroids) ** 2).sum(axis=1).max() <= MOVED**2
        centroids = moved
        if still:
            break
    return centroids


def build(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, path: str | None = None) -> VectorIndex:
    """The index of vectors (chunk_id, tenant_id, embedding and others), written to path or a new folder in the shared one."""
    if lists is not None and not 1 <= lists <= MOST_LISTS:
        raise ValueError(f"lists must be 1 to {MOST_LISTS}")
    spark = vectors.sparkSession
    bound_batches(spark)
    path = path or f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    valued = vectors.where(F.col("embedding").isNotNull())
    n = valued.count()
    lists = lists or min(MOST_LISTS, max(1, n // PER_LIST))
    chosen = valued.where(F.xxhash64("chunk_id") / F.lit(2.0**64) + 0.5 <= min(1.0, sample / max(1, n)))  # the same rows at each reading
    finite = chosen.where(v.norm(F.col("embedding")) < float("inf"))
    centroids = _fitted(keep(finite.select(F.xxhash64("chunk_id", F.lit(SEED)).alias("place"), _unit(F.col("embedding")).alias("unit"))), lists)
    schema = _write(vectors, centroids, path)
    spark.createDataFrame([], "chunk_id long, __until long").write.parquet(f"{path}/gone")
    return VectorIndex(path, schema, centroids, spark)


def delete(index: VectorIndex, keys: DataFrame) -> None:
    """Hides the rows of these ids (chunk_id) that are there now."""
    keys.select("chunk_id", F.lit(time.time_ns()).alias("__until")).write.mode("append").parquet(f"{index.path}/gone")


def insert(index: VectorIndex, vectors: DataFrame) -> None:
    """Adds vectors of the index's columns under its centroids; rows of an id that is there take its place."""
    vectors = keep(vectors.select(*[f.name for f in index.schema.fields if f.name not in ("list", "code", "scale", "__batch")]))
    delete(index, vectors)
    _write(vectors, index.centroids, index.path)


def search_index(index: VectorIndex, queries: DataFrame, k: int = DEFAULT_K, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """As batch_search, for queries (query_id, tenant_id, query): of the probes lists nearest to a query, or of all, the rerank * k rows
    whose codes are best, compared by their vectors. Vectors without a value aren't found."""
    queries = queries.where(F.col("query").isNotNull())
    if not len(index.centroids):
        return ranked(queries.select("query_id", F.lit(0).cast("long").alias("chunk_id"), F.lit(0.0).alias("similarity")).limit(0), k)
    centroids, on = index.centroids, ("tenant_id",)
    rows = index.rows.where(F.col("list") != NO_LIST)
    asked = queries
    if probes is not None and probes < len(centroids):
        half = (centroids**2).sum(axis=1) / 2

        def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                q = np.stack(frame["query"].to_numpy()).astype(np.float64) if len(frame) else np.empty((0, centroids.shape[1]))
                q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
                yield frame.assign(lists=np.argsort(half - q @ centroids.T, axis=1, kind="stable")[:, :probes].astype(np.int32).tolist())

        schema = StructType([*queries.schema.fields, StructField("lists", ArrayType(IntegerType()))])
        asked, on = keep(queries.mapInPandas(near, schema).withColumn("list", F.explode("lists")).drop("lists")), ("tenant_id", "list")
        rows = rows.where(F.col("list").isin([r[0] for r in asked.select("list").distinct().collect()]))  # at most MOST_LISTS

    def vectors_of(row: dict) -> np.ndarray:
        codes, scales = row["code"].to_pylist(), row["scale"].to_numpy(zero_copy_only=False).astype(np.float64)
        lists = np.full(len(codes), row["list"]) if isinstance(row["list"], int) else row["list"].to_numpy(zero_copy_only=False)
        return decode(lists, codes, scales, centroids)

    values = ("code", "scale") if "list" in on else ("list", "code", "scale")
    found = keep(nearest(asked, rows, rerank * k, on, values, vectors_of, width=centroids.shape[1]).select("query_id", "chunk_id"))
    # the size of a column of arrays is guessed far too low, so the side that is broadcast is named here
    small = found.count() * (centroids.shape[1] * 8 + 24) <= BROADCAST_BYTES
    of = found.join(queries.select("query_id", "tenant_id", "query"), "query_id").hint("broadcast" if small else "merge")
    scored = index.rows.select("chunk_id", "tenant_id", "embedding").join(of, ["chunk_id", "tenant_id"])
    return ranked(scored.select("query_id", "chunk_id", v.cosine(F.col("embedding"), F.col("query")).alias("similarity")), k)
