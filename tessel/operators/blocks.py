"""The nearest of many vectors to many queries, by blocks of both.

Blocks of vectors and of queries that share a key, such as their tenant, are multiplied as matrices in Arrow batches: products of
single precision find the few candidates of each query, which are compared in double precision. Where the queries are small, all vectors are read
once, in packed blocks, and blocks of queries are broadcast. Else both are dealt to a grid of cells of each key, as many as its rows ask for, so that a
task holds one bounded cell of vectors and of queries, and a key with most rows is no hot task; the products of all pairs are what such a search takes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from tessel.sources.shared import bound_batches, keep

#: Rows of a block of vectors and of queries; rows that a task packs at once.
VECTORS, QUERIES, HELD = 2048, 512, 1 << 15
#: Bytes of queries that go to all tasks; values of the vectors and of the queries of a cell beyond that.
BROADCAST_BYTES, CELL_VECTORS, CELL_QUERIES = 64 << 20, 1 << 22, 1 << 20
#: The most tasks of a search by cells; a task takes its cells one after the other.
MOST_TASKS = 4096
#: Products that are made at once, and candidates that are compared at once.
TILE, COMPARED = 1 << 21, 1 << 15

#: Makes vectors of a block's values, which are Arrow arrays, or one value where it is part of the key.
Decode = Callable[[dict], np.ndarray]


def _one_list(values: pa.Array, kind: pa.DataType) -> pa.Array:
    """An array of one list, of all values."""
    values = values.cast(kind.value_type) if values.type != kind.value_type else values
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values, type=kind)


def _pack(rows: DataFrame, on: tuple[str, ...], values: list[str], size: int, mark: str) -> DataFrame:
    """A row of on, mark (a number of the block) and arrays of values for each run of at most size rows of one key."""
    fields = [rows.schema[c] for c in on]
    schema = StructType([*fields, StructField(mark, rows.sparkSession.range(0).schema["id"].dataType), *[StructField(c, ArrayType(rows.schema[c].dataType)) for c in values]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held, count = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n
            table = pa.Table.from_batches(held).combine_chunks()
            keys = list(zip(*[table[c].to_pylist() for c in on], strict=True))
            places: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                places.setdefault(k, []).append(i)
            for key, at in places.items():
                for a in range(0, len(at), size):
                    some = table.take(pa.array(at[a : a + size]))
                    lists = [_one_list(some[c].combine_chunks(), arrow.field(c).type) for c in values]
                    yield pa.RecordBatch.from_arrays([*[pa.array([k], arrow.field(c).type) for k, c in zip(key, on, strict=True)], pa.array([(part << 32) + n], pa.int64()), *lists], schema=arrow)
                    n += 1

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= HELD:
                yield from flush()
                held, count = [], 0
        if held:
            yield from flush()

    return rows.select(*on, *values).mapInArrow(run, schema)


def vectors_of(row: dict) -> np.ndarray:
    """The vectors of a block as they are; null vectors and values are NaN."""
    lists = row["embedding"]
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    widths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    width = int(widths.max(initial=0))
    other = valid & (widths != width)
    if other.any():
        raise ValueError(f"expected {width} values, got {widths[other][0]}")
    out = np.full((len(lists), width), np.nan)
    if width:
        out[valid] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and which have a length; the others are zeros."""
    lengths = np.sqrt(np.square(rows).sum(axis=1))
    valid = np.isfinite(lengths) & (lengths > 0)
    return np.where(valid[:, None], rows / np.where(valid, lengths, 1)[:, None], 0.0), valid


class _Block:
    """Vectors by their ids, as units; of equal vectors, and of those without a cosine, only the k of the least ids, as no others can matter."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        unit, valid = _units(vectors[order])
        self.first, self.null = ids[:k], ids[~valid][:k]
        ids, unit = ids[valid], unit[valid]
        if len(ids) > k:
            _, same = np.unique(np.ascontiguousarray(unit).view(f"V{unit.shape[1] * unit.itemsize}").ravel(), return_inverse=True)
            by_vector = np.argsort(same, kind="stable")
            sizes = np.bincount(same)
            place = np.empty(len(ids), np.int64)
            place[by_vector] = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            ids, unit = ids[place < k], unit[place < k]
        self.ids, self.unit, self.single = ids, unit, unit.astype(np.float32)


#: The hits of queries: their places, ids and cosines, which are -inf where there is none.
Hits = tuple[np.ndarray, np.ndarray, np.ndarray]


def _top(hits: list[Hits], k: int) -> Hits:
    """The k best of each query; ties: the lesser id."""
    place, ids, scores = (np.concatenate(x) for x in zip(*hits, strict=True))
    order = np.lexsort((ids, -scores, place))
    place, ids, scores = place[order], ids[order], scores[order]
    begins = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.empty(0, np.int64)
    rank = np.arange(len(place)) - np.repeat(begins, np.diff(np.r_[begins, len(place)]))
    return place[rank < k], ids[rank < k], scores[rank < k]


def _floors(hits: Hits, n: int, k: int) -> np.ndarray:
    """The cosine of the k-th hit of each of n queries, -inf where there are fewer."""
    place, _, scores = hits
    least, count = np.full(n, np.inf), np.bincount(place, minlength=n)
    np.minimum.at(least, place, scores)
    return np.where(count >= k, least, -np.inf)


def _best_of(block: _Block, queries: np.ndarray, k: int, before: Hits | None = None) -> Hits:
    """The k best of each query of a block and of the hits before.

    A product of single precision is off by less than half of near, so whatever reaches the k-th by double precision passes.
    Sums of the candidates don't depend on the block.
    """
    asked, known = _units(queries)
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    n, best = len(asked), before if before is not None else none
    places = np.flatnonzero(known)
    single, near = asked.astype(np.float32), np.float32(2 * (asked.shape[1] + 8) * 2.0**-24)
    floors = _floors(best, n, k)
    rows = max(1, min(len(block.ids), VECTORS))
    step = max(1, TILE // rows)
    made = [best]
    for a in range(0, len(places), step):
        mine = places[a : a + step]
        own, floor, hits = single[mine], floors[mine], none
        for b in range(0, len(block.ids), rows):
            products = own @ block.single[b : b + rows].T
            least = floor.astype(np.float32) - near
            fresh = np.flatnonzero(np.isneginf(floor))
            width = min(k, products.shape[1])
            if len(fresh):
                least[fresh] = np.partition(products[fresh], -width, axis=1)[:, -width] - near
            found = np.flatnonzero(products >= least[:, None])
            if not len(found):
                continue
            q, v = np.divmod(found, products.shape[1])
            v += b
            scores = np.empty(len(found))
            for c in range(0, len(found), COMPARED):
                scores[c : c + COMPARED] = (block.unit[v[c : c + COMPARED]] * asked[mine[q[c : c + COMPARED]]]).sum(axis=1)
            hits = _top([hits, (q, block.ids[v], scores)], k)
            floor = np.maximum(floor, _floors(hits, len(mine), k))
        made.append((mine[hits[0]], hits[1], hits[2]))
    # vectors without a cosine come last, and all do for a query that has none
    short = np.flatnonzero(known & np.isneginf(floors)) if len(block.null) else none[0]
    for at, ids in ((short, block.null), (np.flatnonzero(~known), block.first)):
        made.append((np.repeat(at, len(ids)), np.tile(ids, len(at)), np.full(len(at) * len(ids), -np.inf)))
    return _top(made, k)


def _same_width(vectors: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both; without any values they are NaN in the width of the other."""
    if vectors.shape[1] and asked.shape[1] and vectors.shape[1] != asked.shape[1]:
        raise ValueError(f"expected {vectors.shape[1]} values, got {asked.shape[1]}")
    wide = max(vectors.shape[1], asked.shape[1], 1)
    return tuple(x if x.shape[1] else np.full((len(x), wide), np.nan) for x in (vectors, asked))


def _copied(values: pa.Array) -> pa.Array:
    """The values alone: a part of a batch would keep all of its batch, with the vectors."""
    return values.take(pa.array(np.arange(len(values))))


def _by_broadcast(queries: DataFrame, rows: DataFrame, k: int, on: tuple[str, ...], values: tuple[str, ...], decode: Decode, schema: StructType) -> DataFrame:
    packed = _pack(rows, on, ["chunk_id", *values], VECTORS, "__v")
    asked = _pack(queries, on, ["query_id", "query"], QUERIES, "__q")
    arrow, names = to_arrow_schema(schema), [*values, *on]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[pa.Array, Hits]] = {}
        held, mark, block, vectors = 0, None, None, None

        def emit() -> Iterator[pa.RecordBatch]:
            for own, hits in best.values():
                yield _batch(own, hits, arrow)
            best.clear()

        for batch in batches:
            columns = {c: batch.column(c) for c in ("__v", "__q", "chunk_id", "query_id", "query", *names)}
            for i in range(batch.num_rows):
                row = {c: x[i].values if c not in on and c[:2] != "__" else x[i].as_py() for c, x in columns.items()}
                if row["__v"] != mark:
                    mark, vectors, block = row["__v"], decode({n: row[n] for n in names}), None
                width = vectors.shape[1]
                vectors, asked_ = _same_width(vectors, vectors_of({"embedding": row["query"]}))
                if block is None or vectors.shape[1] != width:
                    block = _Block(row["chunk_id"].to_numpy(), vectors, k)
                own, before = best.get(row["__q"]) or (_copied(row["query_id"]), None)
                hits = _best_of(block, asked_, k, before)
                held += len(hits[0]) - (len(before[0]) if before is not None else 0)
                best[row["__q"]] = (own, hits)
            if held > 1 << 22:
                yield from emit()
                held = 0
        yield from emit()

    return packed.join(F.broadcast(asked), list(on)).mapInArrow(run, schema)


def _batch(own: pa.Array, hits: Hits, arrow: pa.Schema) -> pa.RecordBatch:
    place, ids, scores = hits
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64(), mask=~np.isfinite(scores)), own.take(pa.array(place)).cast(arrow.field("query_id").type)], schema=arrow)


def _by_cells(queries: DataFrame, rows: DataFrame, k: int, on: tuple[str, ...], values: tuple[str, ...], decode: Decode, schema: StructType) -> DataFrame:
    """Rows of a key go to parts by their id, and so do its queries; each pair of parts is a cell, so a row is there once for each part of the queries."""
    keys, cell = list(on), [*on, "__part", "__of"]
    width = F.greatest(F.coalesce(F.max(F.size("query")), F.lit(1)), F.lit(1))
    parts = lambda most, n: F.ceil(F.col(n) * F.col("__width") / most).cast("int")
    sizes = queries.groupBy(*keys).agg(F.count("*").alias("__n"), width.alias("__width")).join(rows.groupBy(*keys).agg(F.count("*").alias("__m")), keys)
    grid = keep(sizes.select(*keys, parts(CELL_QUERIES, "__n").alias("__n"), parts(CELL_VECTORS, "__m").alias("__m")))
    tasks = max(1, grid.agg(F.coalesce(F.sum(F.col("__n") * F.col("__m")), F.lit(0))).first()[0])
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    # a task takes a cell or a few; their number is given, as AQE would join cells by their bytes, which are few
    asked = queries.join(grid, keys).select(*keys, of("query_id", "__n").alias("__of"), each("__m").alias("__part"), "query_id", "query").repartition(min(tasks, MOST_TASKS), *cell)
    # under other names, as both may come from one table
    other = [f"__key{i}" for i in range(len(cell))]
    dealt = rows.join(grid, keys).select(*keys, of("chunk_id", "__m").alias("__part"), each("__n").alias("__of"), "chunk_id", *[v for v in values if v not in on]).withColumnsRenamed(dict(zip(cell, other, strict=True))).repartition(min(tasks, MOST_TASKS), *other)
    arrow = to_arrow_schema(schema)

    def run(key: tuple, asked_: pa.Table, rows_: pa.Table) -> pa.Table:
        if not asked_.num_rows or not rows_.num_rows:
            return arrow.empty_table()
        whole = lambda t, c: pa.concat_arrays(t[c].chunks)
        row = {c: whole(rows_, c) for c in values if c not in on} | {c: key[i].as_py() for i, c in enumerate(on)}
        vectors, own = _same_width(decode(row), vectors_of({"embedding": whole(asked_, "query")}))
        block = _Block(whole(rows_, "chunk_id").to_numpy(), vectors, k)
        return pa.Table.from_batches([_batch(whole(asked_, "query_id"), _best_of(block, own, k), arrow)])

    return asked.groupBy(*cell).cogroup(dealt.groupBy(*other)).applyInArrow(run, schema)


def nearest(queries: DataFrame, rows: DataFrame, k: int, on: tuple[str, ...] = ("tenant_id",), values: tuple[str, ...] = ("embedding",), decode: Decode = vectors_of, n_queries: int | None = None, width: int = 64) -> DataFrame:
    """query_id, chunk_id, similarity, rank: for each of the queries (query_id, on, query) the k rows (chunk_id, on, values) of its key with the largest cosine.

    Ties: the lesser chunk id. Rows and queries without a cosine, as of a null or zero vector, come last with a null. decode makes vectors of
    a block's values. A query may be there under several keys. n_queries and width tell whether the queries are small; the first is counted if not given.
    """
    bound_batches(rows.sparkSession)
    schema = StructType.fromDDL("chunk_id long, similarity double").add("query_id", queries.schema["query_id"].dataType)
    small = (n_queries if n_queries is not None else queries.count()) * width * 8 <= BROADCAST_BYTES
    found = (_by_broadcast if small else _by_cells)(queries, rows, k, on, values, decode, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "chunk_id", "similarity", "rank")
